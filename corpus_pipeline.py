"""The corpus pipeline: quality rules, line dedup, near-duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs.  All but the last return the columns of documents,
further columns included, whatever their names are.

Edge cases, in every stage: an empty table gives an empty table; null and repeated doc_ids
and wholly equal rows are rows of their own; what each stage makes of them, and of null and
empty texts, its docstring says.  Texts of any length are handled whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.llm import bpe, lines, mixing, neardup, quality
from verdigris.llm.common import fresh, saved, table

POLICY = "prose-1"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of POLICY rejects.  Null and empty texts have too few words: they go."""
    packed = docs.select("text", F.struct(*[docs[c] for c in docs.columns]).alias("document"))
    kept = quality.ledger(packed, keep=("document",)).where(quality.passes(POLICY))
    return kept.select("document.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that spread over sites; n_chars follows the text; a document left without words goes.

    Null and empty texts lose nothing and stay; rows of one doc_id and text are cut alike, and a
    line's first occurrence stays in all of them.
    """
    removed = fresh(docs, "n_removed")
    cut = lines.without_spread_lines(docs, n_lines=fresh(docs, "n_lines"), n_removed=removed)
    emptied = (F.col(removed) > 0) & (mixing.n_words(F.col("text")) == 0)
    n_chars = F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.where(~emptied).withColumn("n_chars", n_chars).select(docs.columns)


def _names(docs: DataFrame) -> Column:
    """A long that stands for a row's doc_id and text."""
    known = [F.col("doc_id"), F.col("doc_id").isNull(), F.col("text")]
    name, other = F.xxhash64(*known), F.xxhash64(F.lit(1), *known)
    met = docs.select(name.alias("name"), other.alias("other")).groupBy("name").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a <> b")
    # About n * n / 2**65 of n rows: none of a million, some hundreds of 10**11.
    twice = [r["name"] for r in met.select("name").collect()]
    return F.when(name.isin(twice), other).otherwise(name) if twice else name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: its smallest doc_id, null last.

    A row is named by a hash of its doc_id and text, so that of rows with equal or null doc_ids
    and equal texts one stays (the one of the smallest hash of all columns), and rows with
    equal doc_ids and different texts are told apart.  Names have 64 bits; different rows that
    meet in one (a second hash tells) are few, and are named by that second hash.  Null and
    empty texts and texts without words are near to nothing and stay.
    """
    row, place = fresh(docs, "row"), fresh(docs, "place")
    name = _names(docs)
    found = neardup.near_duplicates(docs.select(name.alias("doc_id"), "text"))
    groups = found.select(F.col("doc_id").alias("name"), "component_id").distinct()
    ids = docs.select(name.alias("name"), F.col("doc_id").alias("own_id")).distinct()
    first = F.min(F.struct(F.col("own_id").isNull().alias("no_id"), "own_id", "name")).alias("first")
    kept = groups.join(ids, "name").groupBy("component_id").agg(first)
    kept = saved(kept.select(F.col("first.name").alias("kept_name")), "kept")
    # The first of equal rows, found before the texts meet the kept names, so that a row repeated very often is one row a task.
    one = W.partitionBy(row).orderBy(F.xxhash64(*[docs[c] for c in docs.columns]))
    single = docs.withColumn(row, name).withColumn(place, F.row_number().over(one)).where(F.col(place) == 1)
    return single.join(kept, single[row] == kept["kept_name"], "left_semi").select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source.  Null and empty texts have no size: they come as often as the
    seeded sample takes them.  Rows of one source and doc_id are taken alike.
    """
    return mixing.mixed_documents(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and their number, and whether the ids decode to the text; null and empty texts have no ids."""
    path = public_tokenizers.path(bpe.VOCABULARY)
    ids = bpe.encode(docs.select("doc_id", "source", "text"), path, decodes="decodes")
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decodes")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_duplicates),
    ("source_mix", source_mix),
    ("byte_bpe", tokenized),
]

#: SQL cannot express byte-pair merges; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
