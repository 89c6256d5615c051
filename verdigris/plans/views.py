"""Scored rows made from the driver's tables, in Spark and in SQL alike.

documents joined to labels are predictions: quality is the label, lang the condition,
source the generator.  lineitem is a large set of predictions with many equal scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

CONDITIONS = ("de", "es", "fr")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = d.join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(
        "doc_id", F.concat_ws("/", F.lit("root"), "source", F.when(F.col("quality") == 1, "fake").otherwise("real"), F.concat(F.col("doc_id").cast("string"), F.lit(".jpg"))).alias("image_path"),
        ((F.col("doc_id") * 7919 % 1000).cast("double") / F.lit(1000.0)).alias("pred"), F.col("quality").alias("label"),
        F.col("lang").alias("condition"), F.col("source").alias("generator"), F.when(F.col("toxic") == 1, "set_b").otherwise("set_a").alias("source_dataset"),
        F.col("n_chars"),
    )


PRED = """pred AS (
  SELECT d.doc_id, concat_ws('/', 'root', source, CASE WHEN quality = 1 THEN 'fake' ELSE 'real' END, d.doc_id || '.jpg') AS image_path,
         (d.doc_id * 7919 % 1000)::DOUBLE / 1000::DOUBLE AS pred, quality AS label, lang AS condition, source AS generator,
         CASE WHEN toxic = 1 THEN 'set_b' ELSE 'set_a' END AS source_dataset, n_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_discount", "l_quantity", "l_returnflag", "l_linestatus")
    return rows.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("image_path"),
        (F.col("l_quantity") / 50.0).alias("pred"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.col("l_linestatus").alias("condition"), F.concat(F.lit("g"), (F.col("l_suppkey") % 7).cast("string")).alias("generator"),
        "l_orderkey", "l_discount",
    )


SALES = """sales AS (
  SELECT l_orderkey || '-' || l_linenumber AS image_path, l_quantity / 50::DOUBLE AS pred, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
         l_linestatus AS condition, 'g' || (l_suppkey % 7) AS generator, l_orderkey, l_discount FROM lineitem)"""


def metric_sql(rows: str, keys: str = "", threshold: float = 0.5, extra: str = "") -> str:
    """SELECT of all metrics of `rows` by `keys` (a column list)."""
    k = f"{keys}, " if keys else ""
    over = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    t = f"{threshold}::DOUBLE"
    return f"""
SELECT {k}{extra}count(*) AS n, count_if(label = 0) AS n_real, count_if(label = 1) AS n_fake, {t} AS threshold,
       round((count_if(pred >= {t} AND label = 1) + count_if(pred < {t} AND label = 0)) / greatest(1, count(*))::DOUBLE, 8) AS acc,
       round((sum(CASE WHEN label = 1 THEN r - (eq - 1) / 2.0::DOUBLE END) - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0::DOUBLE)
             / nullif(count_if(label = 1)::DOUBLE * count_if(label = 0), 0), 8) AS auroc,
       round(count_if(pred >= {t} AND label = 1) / greatest(1, count_if(pred >= {t}))::DOUBLE, 8) AS precision_fake,
       round(count_if(pred >= {t} AND label = 1) / greatest(1, count_if(label = 1))::DOUBLE, 8) AS recall_fake,
       round(count_if(pred >= {t} AND label = 0) / greatest(1, count_if(label = 0))::DOUBLE, 8) AS fpr,
       count_if(pred >= {t} AND label = 1) AS tp, count_if(pred >= {t} AND label = 0) AS fp,
       count_if(pred < {t} AND label = 0) AS tn, count_if(pred < {t} AND label = 1) AS fn,
       round(sum(pred) / count(*), 8) AS mean_pred
FROM (SELECT *, count(*) OVER ({over}ORDER BY pred RANGE UNBOUNDED PRECEDING)::DOUBLE AS r, count(*) OVER ({over + ',' if over else 'PARTITION BY '}pred) AS eq FROM {rows})
{group}"""
