"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Each source gets a target: its weight's share of the total, but at most `max_epochs`
times its size.  Sources above that are clamped and the excess goes to the others in
proportion to their weights, until none is above.  A source's documents are then taken
`floor(target / size)` times each, and once more for a seeded sample of them that holds
the fraction that is left.

The sample takes documents in the order of md5(seed, doc_id) as long as half of the
next one still fits.  A hot source is never ordered in one task: its documents are
summed by the leading digits of that digest, and only the group where the fraction
ends is ordered.

Edge cases: null or empty texts have size 0 and are taken 0 words; a null source is a
source of its own, last in order; a source of size 0 has target 0; an empty table gives
no rows; documents of equal digest (repeated doc_ids) are taken together or not at all;
other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, table

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
MAX_EPOCHS = 3
#: Hexadecimal digits of the digest by which a source's documents are grouped before the last group is ordered.
DIGITS = 3
MAX_ROUNDS = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sizes: DataFrame) -> DataFrame:
    """Adds `place`: 0, 1, ... by source in code point order, null last.

    Sources are ordered within ranges, and the ranges' counts are added up, so that no
    task sees more sources than a range holds.
    """
    ranges = saved(
        sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "ranges"
    )
    before = ranges.groupBy("range").agg(F.count("*").alias("n"))
    before = before.select("range", F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    inside = F.row_number().over(W.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    return ranges.join(F.broadcast(before), "range").select(
        "source", "source_size", (inside - 1 + F.coalesce("before", F.lit(0))).alias("place")
    )


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size and weight -> also `target`.

    The level (words for a unit of weight) rises monotonically as sources are clamped;
    each round is one aggregation, and it ends when no further source is above its cap.
    Only the level, a scalar, comes to the driver.
    """
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    total, level = None, 0.0
    for _ in range(MAX_ROUNDS):
        clamped = F.lit(level) * F.col("weight") >= cap
        x = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(clamped, cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(clamped, 0.0).otherwise(F.col("weight").cast("double"))).alias("open"),
        ).first()
        total = float(x["total"] or 0)
        if not total or not x["open"]:
            break
        risen = (total - x["held"]) / x["open"]
        if risen <= level:
            break
        level = risen
    else:
        raise RuntimeError(f"the level still rises after {MAX_ROUNDS} rounds")
    return sources.withColumn("target", F.when(F.lit(level) * F.col("weight") >= cap, cap).otherwise(F.lit(level) * F.col("weight")))


def repetitions(docs: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """docs (doc_id, source, size) with targets -> also source_size, target and `times`, how often each is taken."""
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.withColumn("digest", digest).withColumn("part", F.substring("digest", 1, DIGITS))
    epochs = F.col("target") / F.col("source_size")
    whole = F.when(F.col("source_size") > 0, F.floor(epochs)).otherwise(0)
    shares = targets.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    up_to = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    parts = parts.withColumn("part_end", F.sum("part_size").over(up_to))
    parts = parts.join(shares, parts["source"].eqNullSafe(shares["source"])).select(
        parts["source"], "part", F.col("part_end") - F.col("part_size"), "part_end", "source_size", "target", "whole", "left"
    ).toDF("source", "part", "part_start", "part_end", "source_size", "target", "whole", "left")
    # Of each source: the first group that reaches the fraction is ordered; groups before it are taken whole.
    last = F.min(F.when(F.col("part_end") >= F.col("left"), F.col("part"))).over(W.partitionBy("source"))
    parts = parts.withColumn("last", last)
    joined = rows.join(parts, rows["source"].eqNullSafe(parts["source"]) & (rows["part"] == parts["part"])).select(
        *[rows[c] for c in rows.columns], "part_start", "source_size", "target", "whole", "left", "last"
    )
    edge = (F.col("part") == F.col("last")) & (F.col("left") > 0)
    by_digest = W.partitionBy("source").orderBy("digest").rangeBetween(W.unboundedPreceding, 0)
    ends = joined.where(edge).groupBy("source", "digest").agg(
        F.sum("size").alias("n"), F.first("part_start").alias("part_start"), F.first("left").alias("left")
    )
    reach = F.col("part_start") + F.sum("n").over(by_digest) - F.col("n") / 2
    ends = ends.select("source", "digest", (reach <= F.col("left")).alias("fits"))
    e = ends.select(F.col("source").alias("e_source"), F.col("digest").alias("e_digest"), "fits")
    out = joined.join(e, joined["source"].eqNullSafe(e["e_source"]) & (joined["digest"] == e["e_digest"]), "left")
    before = (F.col("left") > 0) & (F.col("last").isNull() | (F.col("part") < F.col("last")))
    extra = F.when(before | F.coalesce("fits", F.lit(False)), 1).otherwise(0)
    return out.withColumn("times", (F.col("whole") + extra).cast("int")).drop(
        "e_source", "e_digest", "fits", "digest", "part", "part_start", "whole", "left", "last"
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, times of each document; weights repeat over the sources in order."""
    sized = saved(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = saved(ranked(sizes).withColumn("weight", cycle), "sources")
    return repetitions(sized, water_fill(sources, max_epochs).select("source", "source_size", "target"), seed)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs (rows of one source and doc_id alike)."""
    taken = mix(docs, **options).groupBy("source", "doc_id").agg(F.max("times").alias("times")).where("times > 0")
    taken = taken.select(F.col("source").alias("taken_source"), F.col("doc_id").alias("taken_id"), F.col("times").alias("taken_times"))
    rows = docs.join(taken, docs["doc_id"].eqNullSafe(taken["taken_id"]) & docs["source"].eqNullSafe(taken["taken_source"]))
    copies = F.explode(F.sequence(F.lit(1), F.col("taken_times")))
    return rows.select(*[docs[c] for c in docs.columns], copies.alias("taken_copy")).drop("taken_copy")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source", "times")


ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat('{SEED}:', coalesce(doc_id::VARCHAR, 'null'))) AS digest FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
fill AS (
  SELECT 0 AS k, -1.0::DOUBLE AS was, 0.0::DOUBLE AS level
  UNION ALL
  SELECT k + 1, level,
         coalesce((SELECT (sum(source_size) - sum(CASE WHEN level * weight >= 3.0 * source_size THEN 3.0 * source_size ELSE 0 END))::DOUBLE
                          / nullif(sum(CASE WHEN level * weight >= 3.0 * source_size THEN 0 ELSE weight END), 0) FROM s), level)
  FROM fill WHERE level > was AND k < 1000),
t AS (
  SELECT s.*, least(3.0::DOUBLE * source_size, (SELECT max(level) FROM fill) * weight) AS target FROM s),
e AS (
  SELECT d.doc_id, d.source, size, digest, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         sum(size) OVER (PARTITION BY d.source ORDER BY digest RANGE UNBOUNDED PRECEDING) AS reach,
         sum(size) OVER (PARTITION BY d.source, digest) AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (
  SELECT *, (whole + CASE WHEN target - whole * source_size > 0 AND reach - n / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END)::INT AS times FROM e)
SELECT doc_id, size, source_size, target, (size * times)::BIGINT AS taken, source, times FROM r
"""
