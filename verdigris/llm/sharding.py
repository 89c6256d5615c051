"""Balanced shards by global prefix sums of sizes, in DataFrame operations only.

Rows have one order: by the md5 of their text, then by doc_id, so that equal texts stand
together.  Ranges of that order are dealt to partitions; each partition's bytes and rows
are summed, the sums of the partitions before it are added up, and a running sum inside
the partition gives each row its place on one line of bytes from 0 to the total.  The line
is cut at equal targets, and what lies between two cuts is a shard: contiguous in the order.

A cut comes to the nearest end of a document, so that no shard is further from its equal
share than the size of the largest document.  Where it would part equal texts, it goes to
the end of that group, if this is at most half of the largest document away; a larger group
is parted, since else its shards would not be near equal.

No task holds a key: a text that a third of all rows share is spread over ranges, as the
row's own number ends the order.  What comes to the driver is one row a cut.

Edge cases: a null text is an empty one, and every row has one byte more than its text; a
null doc_id comes last among equal texts; equal rows are rows of their own (which of them
is first does not show); fewer rows than shards leave shards empty; an empty table gives no
rows; columns of any name are carried in `keep`; texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, saved, table

SHARDS = 16
LAW = "bytes"


def ordered(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, digest and row (a number of its own) of docs; `document` has the columns to keep."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest"),
        F.monotonically_increasing_id().alias("row"), *([F.struct(*[docs[c] for c in keep]).alias("document")] if keep else []),
    )


def placed(rows: DataFrame) -> DataFrame:
    """rows with `start` and `end` on the line of bytes, and `place` among all rows (from 0)."""
    order = [F.col("digest"), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranged = saved(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    # One row a partition, whatever the number of documents.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    totals = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    inside = W.partitionBy("part").orderBy(*order)
    end = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0))
    place = F.col("n_before") + F.row_number().over(inside) - 1
    met = ranged.join(F.broadcast(totals), "part").withColumns({"end": end, "place": place})
    out = saved(met.withColumn("start", F.col("end") - F.col("size")).drop("part", "bytes_before", "n_before"), "placed")
    drop(ranged)
    return out


def _divided(x: Column, by: int) -> Column:
    """x div by, exactly."""
    return F.call_function("div", x, F.lit(by).cast("decimal(38,0)"))


def cuts(rows: DataFrame, shards: int = SHARDS) -> list[int]:
    """Where the shards after the first begin on the line of bytes (rows: placed)."""
    whole = rows.agg(F.max("end").alias("bytes"), F.max("size").alias("largest")).first()
    if not whole["bytes"]:
        return []
    total, largest = whole["bytes"], whole["largest"]
    # Target k is at k * total / shards; the document that holds it has start <= target < end.
    wide = lambda x: x.cast("decimal(38,0)") * shards
    first = F.greatest(_divided(wide(F.col("start")) + (total - 1), total), F.lit(1).cast("long"))
    last = F.least(_divided(wide(F.col("end")) - 1, total), F.lit(shards - 1).cast("long"))
    hits = rows.withColumns({"first": first, "last": last}).where("first <= last")
    hits = saved(hits.select("digest", "start", "end", F.explode(F.sequence("first", "last")).alias("k")), "hits")
    groups = rows.join(F.broadcast(hits.select("digest").distinct()), "digest").groupBy("digest").agg(F.min("start").alias("group_start"), F.max("end").alias("group_end"))
    found = hits.join(groups, "digest").collect()
    drop(hits)
    out = []
    for x in sorted(found, key=lambda x: x["k"]):
        near = lambda at: abs(at * shards - x["k"] * total)  # noqa: B023, E731
        group = min(x["group_start"], x["group_end"], key=near)
        out.append(group if 2 * near(group) <= largest * shards else min(x["start"], x["end"], key=near))
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (0, 1, ... in each shard) of every row; `document` has the columns `keep`."""
    rows = placed(ordered(docs, keep))
    at = cuts(rows, shards)
    shard = F.lit(0) if not at else F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in at]), lambda x: x <= F.col("start")))
    rows = rows.withColumn("shard", shard)
    # One row a shard.
    first = rows.groupBy("shard").agg(F.min("place").alias("first_place"))
    rows = rows.join(F.broadcast(first), "shard")
    kept = ["document"] if keep else []
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first_place")).cast("long").alias("slot"), *kept)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """docs as Parquet, one folder (shard=N) a shard."""
    sharded(docs, shards, docs.columns).select("document.*", F.col("shard").alias("shard_")).write.partitionBy("shard_").parquet(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = f"""
WITH bits AS (SELECT [list_reduce([x::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) for x in range(256)] AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) + 1 AS size FROM documents),
r AS (
  SELECT doc_id, size, md5(text) AS digest,
         xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || x)::BIGINT for x in regexp_extract_all(h, '..')]), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS crc,
         row_number() OVER (ORDER BY md5(text), doc_id NULLS LAST) AS place
  FROM d, bits),
p AS (SELECT *, (sum(size) OVER (ORDER BY place) - size)::BIGINT AS a, (sum(size) OVER (ORDER BY place))::BIGINT AS b FROM r),
n AS (SELECT sum(size)::BIGINT AS total, max(size) AS largest FROM p),
g AS (SELECT digest, min(a) AS ga, max(b) AS gb FROM p GROUP BY digest),
k AS (
  SELECT *, CASE WHEN abs(ga * {SHARDS} - k * total) <= abs(gb * {SHARDS} - k * total) THEN ga ELSE gb END AS near
  FROM (SELECT unnest(range(1, {SHARDS})) AS k), n, p JOIN g USING (digest) WHERE k * total >= a * {SHARDS} AND k * total < b * {SHARDS}),
c AS (
  SELECT CASE WHEN 2 * abs(near * {SHARDS} - k * total) <= largest * {SHARDS} THEN near
              WHEN abs(a * {SHARDS} - k * total) <= abs(b * {SHARDS} - k * total) THEN a ELSE b END AS cut FROM k),
s AS (SELECT *, (SELECT count(*) FROM c WHERE cut <= a)::INT AS shard FROM p)
SELECT doc_id, size, crc AS text_crc32, '{LAW}' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INT AS grown_shard FROM s
"""
