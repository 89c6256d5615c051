"""Streaming extensions: windowed confusion counts and mergeable score histograms over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_confusion(rows: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "1 day", threshold: float = 0.5, keys: tuple[str, ...] = ()) -> DataFrame:
    """Confusion counts of each window (and key) of scored events; works on batches and on streams.

    Event time without a zone is read as UTC, since a watermark needs a timestamp.
    """
    hit = F.col("pred") >= F.lit(float(threshold))
    timed = rows.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    counts = {
        "tp": F.count_if(hit & (F.col("label") == 1)), "fp": F.count_if(hit & (F.col("label") == 0)),
        "tn": F.count_if(~hit & (F.col("label") == 0)), "fn": F.count_if(~hit & (F.col("label") == 1)),
    }
    out = timed.groupBy(F.window("at", width), *keys).agg(*[v.alias(k) for k, v in counts.items()])
    return out.select(F.col("window.start").alias("window_start"), *keys, *counts)


def windowed_histogram(rows: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "1 day", slots: int = 100) -> DataFrame:
    """Positives and negatives by window and score slot; histograms of windows can be added up before an AUROC is taken."""
    slot = F.least(F.floor(F.col("pred") * slots), F.lit(slots - 1)).cast("int").alias("slot")
    timed = rows.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    out = timed.groupBy(F.window("at", width), slot).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    return out.select(F.col("window.start").alias("window_start"), "slot", "pos", "neg")


def first_seen(rows: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each key that arrives inside the watermark."""
    return rows.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])
