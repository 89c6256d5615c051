"""Removal of lines that spread over many sites, in DataFrame operations only.

Lines are counted by hash first, and the occurrences of those that occur as often as
the threshold asks for sites are kept.  Each such line's sites are gathered in a
HyperLogLog sketch by line hash; sketches merge in the aggregation, so that a line of any
number of occurrences costs one small row a task.  Lines whose estimate is near the
threshold, within the sketch's error, get an exact distinct count.  Of a line that reaches
the threshold, the first occurrence (by doc_id, then place) stays and all others go, so
that nothing is lost altogether.

The threshold is MIN_SITES sites: what a few sites share is left whole, since that is what
copies and quotations of whole documents look like, which near-duplicate search handles.

Lines are parted by 0x0A; lines of fewer than `min_words` words never go.  A site is a
document's source; null is a site of its own.

Edge cases: a null text stays null and has no lines; an empty text has one line without
words; repeated rows (same doc_id and text) are treated alike; a null doc_id counts as
the first; an empty table gives no rows; other columns are carried through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table, without
from .mixing import n_words

MIN_SITES = 5
MIN_WORDS = 3
#: Sketches of 2**LOG_K registers have a relative standard error of 1.04 / 2**(LOG_K / 2).
LOG_K = 12
#: Standard errors around the threshold within which the sketch does not decide.
BAND = 5
#: Lines that are broadcast (16 bytes, or 44 with their first occurrence); more are joined in SALTS parts.
BROADCAST_LINES = 500_000
SALTS = 16


def _keys(line: Column) -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2")]


def occurrences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_key, place, site and key of each line that may go."""
    site = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_key"), site.alias("site"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return lines.where(n_words(F.col("line")) >= min_words).select("doc_id", "text_key", "place", "site", *_keys(F.col("line")))


def _met(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """rows joined with `lines` (k1, k2, ..., one row a line; saved, so that counting them is cheap).

    Up to BROADCAST_LINES lines are broadcast; more are met in SALTS parts each, so that the
    rows of a hot line are spread.
    """
    if lines.count() <= BROADCAST_LINES:
        return rows.join(F.broadcast(lines), ["k1", "k2"])
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key", "place"), F.lit(SALTS)).cast("int"))
    lines = lines.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(lines, ["k1", "k2", "salt"]).drop("salt")


def repeated_lines(lines: DataFrame, at_least: int) -> DataFrame:
    """The occurrences of lines that occur that often: no other line can be on that many sites."""
    often = lines.groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") >= at_least).select("k1", "k2")
    return _met(lines, saved(often, "often"))


def spread_lines(hits: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """k1, k2 of the lines on at least `min_sites` sites, and their first occurrence."""
    margin = BAND * 1.04 / 2 ** (LOG_K / 2) * min_sites
    first = F.min(F.struct("doc_id", "text_key", "place")).alias("first")
    sketched = hits.groupBy("k1", "k2").agg(F.hll_sketch_agg(F.xxhash64("site"), LOG_K).alias("sketch"), first)
    sketched = sketched.select("k1", "k2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    sketched = saved(sketched.where(F.col("sites") >= min_sites - margin), "sketched")
    near = F.col("sites") <= min_sites + margin
    # A hot line is one row a site before its sites are counted.
    sites = _met(hits.select("k1", "k2", "site", "doc_id", "text_key", "place"), saved(sketched.where(near).select("k1", "k2"), "near"))
    exact = sites.select("k1", "k2", "site").distinct().groupBy("k1", "k2").agg(F.count("*").alias("n_sites")).where(F.col("n_sites") >= min_sites)
    return sketched.where(~near).select("k1", "k2", "first").unionByName(sketched.where(near).join(exact, ["k1", "k2"]).select("k1", "k2", "first"))


def removals(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_key and the places of the lines that go."""
    hits = saved(repeated_lines(occurrences(docs, min_words), min_sites), "hits")
    hit = _met(hits, saved(spread_lines(hits, min_sites), "spread"))
    hit = hit.where(~F.struct("doc_id", "text_key", "place").eqNullSafe(F.col("first")))
    return hit.groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("gone"))


def without_spread_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, n_lines: str = "n_lines", n_removed: str = "n_removed"
) -> DataFrame:
    """docs with their text cut, and n_lines, n_removed (long); columns that already have these names are replaced."""
    gone = removals(docs, min_sites, min_words).select(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key"), "gone")
    rows = docs.join(gone, docs["doc_id"].eqNullSafe(gone["g_id"]) & (F.xxhash64(docs["text"]) == gone["g_key"]), "left")
    lines = F.split(docs["text"], "\n")
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(gone["gone"], i)), "\n")
    text = F.when(gone["gone"].isNull(), docs["text"]).otherwise(left)
    return rows.select(
        *[text.alias("text") if c == "text" else docs[c] for c in without(docs, n_lines, n_removed)],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(n_lines),
        F.coalesce(F.size(gone["gone"]), F.lit(0)).cast("long").alias(n_removed),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_spread_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


ORACLE = rf"""
WITH docs AS (SELECT doc_id, source, text, row_number() OVER () AS r FROM documents),
lines AS (
  SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place
  FROM docs WHERE text IS NOT NULL),
spread AS (
  SELECT line, min((doc_id, r, place)) AS first FROM lines
  WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {MIN_WORDS}
  GROUP BY line HAVING count(DISTINCT coalesce('s' || source, 'n')) >= {MIN_SITES}),
cut AS (
  SELECT r, string_agg(l.line, chr(10) ORDER BY place) FILTER (WHERE s.line IS NULL OR (doc_id, r, place) = first) AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE s.line IS NOT NULL AND (doc_id, r, place) <> first) AS n_removed
  FROM lines l LEFT JOIN spread s ON l.line = s.line GROUP BY r)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.text, '') END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM docs d LEFT JOIN cut c USING (r)
"""
