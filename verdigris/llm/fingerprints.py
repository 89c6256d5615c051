"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases, phrases into longer phrases, and so on.  On each level
runs of one symbol become one, then deterministic coin tossing gives each symbol a
label out of six by comparing it with its left neighbour, and a phrase begins wherever
the label is smaller than both neighbours'.  A phrase's name is a hash of its symbols.
Where a phrase begins depends on a few symbols around it only, so equal substrings have
equal phrases inside, at any offset.

A text's set is the names of its phrases on levels LEVELS.  The fingerprint is the SKETCH
smallest names of the set, in order, as 8 hexadecimal digits each; the likeness of two
fingerprints estimates the Jaccard similarity of the sets, and is exact for small sets.

Edge cases: a null text is empty; an empty text has the empty fingerprint, like 1 to
itself and 0 to all others; equal texts have equal fingerprints; rows are ordered by
doc_id (numbers by value, texts by their UTF-8 bytes), null first, and repeated doc_ids by a hash of the text; a single document is its own next;
an empty table gives no rows; other columns are not looked at; texts of any length are
parsed whole.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import NumericType

from .common import CHUNK, arrow_map, as_bytes, saved, table, without
from .ragged import BYTE_KEYS, U64, chunks, hashes_of_spans, mix

LEVELS = (2, 3)
SKETCH = 64
#: Bytes of text of one range of documents, about.
RANGE_BYTES = 128 << 20
#: Times its share of rows or bytes that a range of numbers may hold, and rows that count as a share at least.
UNEVEN, FAIR_ROWS = 6, 1000
_DE_BRUIJN = 0x03F79D71B4CB0A89
_PLACE = np.zeros(64, np.uint8)
_PLACE[[((_DE_BRUIJN << k) & 0xFFFFFFFFFFFFFFFF) >> 58 for k in range(64)]] = np.arange(64)


@cache
def _toss_table(size: int) -> np.ndarray:
    """Labels for pairs (symbol, left neighbour) of a small alphabet."""
    own, left = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    differ = own ^ left
    place = np.where(differ > 0, np.log2(np.maximum(differ & -differ, 1)).astype(np.int64), 0)
    return (2 * place + (own >> place & 1)).astype(np.uint8).ravel()


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A label below 6 for each symbol, unlike its neighbours'; `first` marks where texts begin."""
    left = np.empty_like(symbols)
    left[1:] = symbols[:-1]
    left[first] = symbols[first] ^ U64(1)
    differ = symbols ^ left
    lowest = differ & (~differ + U64(1))
    place = _PLACE[(lowest * U64(_DE_BRUIJN) >> U64(58)).astype(np.int64)]
    label = 2 * place + (symbols >> place.astype(U64) & U64(1)).astype(np.uint8)
    for size in (128, 16, 8):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[first] = label[first] ^ 1
        label = _toss_table(size)[label.astype(np.int64) * size + before]
    return label


def next_level(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each text, and their bounds."""
    if not len(symbols):
        return symbols, bounds
    filled = bounds[:-1][bounds[1:] > bounds[:-1]]
    fresh = np.ones(len(symbols), bool)
    fresh[1:] = symbols[1:] != symbols[:-1]
    fresh[filled] = True
    start = np.flatnonzero(fresh)
    length = np.diff(np.append(start, len(symbols)))
    runs = symbols[start]
    long = length > 1
    runs[long] = mix(runs[long] + length[long].astype(U64), 61)
    bounds = np.searchsorted(start, bounds)
    first = np.searchsorted(start, filled)
    label = _labels(runs, first)
    begins = np.zeros(len(runs), bool)
    begins[1:-1] = (label[1:-1] < label[:-2]) & (label[1:-1] < label[2:])
    begins[first] = True
    begins[(first - 1)[first > 0]] = False
    begins[first] = True
    start = np.flatnonzero(begins)
    names = hashes_of_spans(runs, start, np.append(start[1:], len(runs)), 62)
    return names, np.searchsorted(start, bounds)


def phrases(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols and bounds of level 0 (bytes), 1, 2, ..."""
    symbols = BYTE_KEYS[np.frombuffer(b"".join(texts), np.uint8)]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
    while True:
        yield symbols, bounds
        symbols, bounds = next_level(symbols, bounds)


def sketches(texts: list[bytes]) -> list[np.ndarray]:
    """The smallest names (32 bits) of each text's set, in order."""
    names, owners = [], []
    for level, (symbols, bounds) in enumerate(phrases(texts)):
        if level in LEVELS:
            names.append(mix(symbols, 70 + level) >> U64(32))
            owners.append(np.repeat(np.arange(len(texts)), np.diff(bounds)))
        if level >= max(LEVELS):
            break
    both = np.unique(np.concatenate(owners).astype(U64) << U64(32) | np.concatenate(names))
    bounds = np.searchsorted(both, np.arange(len(texts) + 1).astype(U64) << U64(32))
    low = (both & U64(0xFFFFFFFF)).astype(np.uint32)
    return [low[a : min(b, a + SKETCH)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def to_string(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of the smallest names of both sets together, the part that is in either."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    together = np.union1d(a, b)[:SKETCH]
    return float(np.isin(together, a, assume_unique=True)[np.isin(together, b, assume_unique=True)].sum() / len(together))


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and the fingerprint of each row's text; a kept column of the name `fingerprint` is replaced."""
    keep = tuple(without(docs.select(*keep), "fingerprint"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [to_string(s) for s in sketches([x or b"" for x in as_bytes(batch.column(0))])]
            return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.string())], [*keep, "fingerprint"])

        return each

    return arrow_map(docs.select(text, *keep), ", ".join([*fields, "fingerprint string"]), make)


def _place(docs: DataFrame) -> Column:
    """A double that never falls where doc_id rises: the number itself, or six bytes of a text behind the common prefix of all."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, NumericType):
        return F.col("doc_id").cast("double")
    name = F.col("doc_id").cast("string")
    least, most = docs.agg(F.min(name), F.max(name)).first()
    common = len(os.path.commonprefix([(least or "").encode(), (most or "").encode()]))
    six = F.substring(F.col("doc_id").cast("string").cast("binary"), common + 1, 6)
    return F.conv(F.rpad(F.hex(six), 12, "0"), 16, 10).cast("double")


def _numbered(docs: DataFrame, parts: int) -> DataFrame:
    """docs (at) with `part`, the range of `at` that they are in, of about equally many rows."""
    limits = docs.where("doc_id IS NOT NULL").approxQuantile("at", [k / (4 * parts) for k in range(1, 4 * parts)], 1 / (16 * parts))
    splits = [float("-inf"), *sorted(set(limits) or {0.0}), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="at", outputCol="range").transform(docs)
    return ranged.withColumn("part", F.col("range").cast("int"))


def in_order(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, text, part, edge: rows dealt to ranges of doc_id and ordered inside them.

    Each range ends with a copy (edge) of the next one's first document, the last range
    with the first of all.  There are as many ranges as the session has shuffle partitions,
    or one for RANGE_BYTES of text if that is more.  Where a range of numbers would hold
    UNEVEN times its share (ids that are null, repeated, or texts that differ late), rows are
    dealt to ranges of (doc_id, hash of the text, row) instead, which takes one more copy of
    the texts on disk.  One small row a range comes to the driver.
    """
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not parts:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / RANGE_BYTES))
    at = F.coalesce(_place(docs), F.lit(float("-inf"))).alias("at")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), at)
    ranged = _numbered(docs, parts)
    first = [F.max(F.col("doc_id").isNull()).alias("no_id"), F.min("doc_id").alias("doc_id"), F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")]
    heads = ranged.groupBy("part").agg(*first).orderBy("part").collect()
    fair = max(RANGE_BYTES // 4, n_bytes // parts), max(FAIR_ROWS, sum(h["n"] for h in heads) // parts)
    if any(h["bytes"] > UNEVEN * fair[0] or h["n"] > UNEVEN * fair[1] for h in heads):
        order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
        ranged = saved(docs.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
        heads = ranged.groupBy("part").agg(*first).orderBy("part").collect()
    # The first document of each range stands, once, behind the rows of the range before it.
    before = [(h["part"], None if h["no_id"] else h["doc_id"], heads[k - 1]["part"]) for k, h in enumerate(heads)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    edges = spark.createDataFrame(before, f"of int, head {kind}, before int")
    heading = (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head"))
    edges = ranged.join(F.broadcast(edges), heading).groupBy("before").agg(F.min_by(F.struct("doc_id", "text"), F.xxhash64("text")).alias("r"))
    edges = edges.select("r.doc_id", "r.text", F.col("before").alias("part"), F.lit(True).alias("edge"))
    rows = ranged.select("doc_id", "text", "part", F.lit(False).alias("edge")).unionByName(edges)
    return rows.repartition(parts, "part").sortWithinPartitions("part", "edge", "doc_id", F.xxhash64("text"), "text")


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like they are."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (doc_id, text, part, edge) in order; all but the last get a result unless they are edges."""
        texts = [r[1].decode("utf-8", "replace") for r in rows]
        pairs = [k for k in range(len(rows) - 1) if not rows[k][3]]
        # Behind a range's own rows stand its edges; the first of them is the next document.
        edited = []
        for k in pairs:
            half = len(texts[k]) // 2
            edited.append((texts[k][: len(texts[k]) - half] + texts[k + 1][:half]).encode())
        own, other = sketches([t.encode() for t in texts]), sketches(edited)
        cols = [
            pa.array([rows[k][0] for k in pairs], id_type),
            pa.array([len(texts[k]) for k in pairs], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
            pa.array([to_string(own[k]) for k in pairs], pa.string()),
            pa.array([to_string(o) for o in other], pa.string()),
            pa.array([likeness(own[k], o) for k, o in zip(pairs, other, strict=True)], pa.float64()),
            pa.array([likeness(own[k], own[k + 1]) for k in pairs], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            texts = as_bytes(batch.column(1))
            rows = list(zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            for a, b in chunks(texts, CHUNK // 2):
                held += rows[a:b]
                if len(held) > 1:
                    yield work(held)
                    held = held[-1:]

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs).mapInArrow(run, schema)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_next(table(spark, sf_dir, "documents"))
