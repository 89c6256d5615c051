from pyspark.sql import functions as F

from verdigris.streaming.windows import windowed_confusion


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = spark.range(200).select(
        F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("ts"), (F.col("id") % 10 / 10).alias("pred"), (F.col("id") % 2).cast("int").alias("label")
    )
    rows.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in windowed_confusion(rows).collect()}
    stream = windowed_confusion(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    closed = {tuple(r) for r in spark.sql("select * from counts").collect()}
    assert closed and closed <= batch
