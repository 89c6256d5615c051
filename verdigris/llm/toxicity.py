"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are present or absent: its words, neighbouring pairs, and pairs with
one or two words between, hashed to 2**BITS places.  Words are lower-cased runs of
letters, digits and bytes above 0x7F.  Training keeps a rate for each coordinate and
an L1 penalty that leaves most weights at zero, so that the model is a short list of
(place, weight) whose length is bounded by 2**BITS.

The model is fitted on a bounded sample: the first MAX_TRAIN labelled doc_ids in the order
of md5(seed, doc_id), one row each (that of the smallest text hash, where an id is repeated);
with fewer labelled ids, all of them.  Scoring covers every text.

Edge cases: null and empty texts have no features and get the score of the bias; without
labelled rows every score is 0.5; null labels are not learned from, and labels of any
number type or booleans count as whole numbers; rows of a null
doc_id are scored and not learned from; repeated rows are scored alike; other columns
are not looked at; texts of any length are scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, saved, table, without
from .ragged import FOLD_LOWER, U64, Words, mix

BITS = 20
#: Labelled rows that the model is fitted on, at most.
MAX_TRAIN = 16_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 1.0
SEED = "toxicity-1"
FOLDS = 5
BIAS = 0

_PARTS = bytearray(FOLD_LOWER)
for _b in range(0x80):
    if not chr(_b).isalnum():
        _PARTS[_b] = 0x20


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and place of each feature, with repeats; BIAS is not among them."""
    w = Words(texts, True, bytes(_PARTS))
    h, doc = w.hashes(21), w.doc
    docs, places = [doc], [h]
    for gap in (1, 2, 3):
        inside = doc[gap:] == doc[:-gap]
        docs.append(doc[gap:][inside])
        places.append(mix(mix(h[:-gap][inside], 30 + gap) + h[gap:][inside], 40))
    found = np.concatenate(places) >> U64(64 - BITS)
    return np.concatenate(docs), np.maximum(found, U64(BIAS + 1)).astype(np.int64)


def present(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without repeats, ordered by text."""
    both = np.unique(doc << BITS | place)
    return both >> BITS, both & ((1 << BITS) - 1)


def fit(rows: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights learned from (label, places) in the given order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at):
        own = z[at]
        shrunk = np.sign(own) * L1 - own
        return np.where(np.abs(own) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for label, places in rows:
            at = np.append(places, BIAS)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            before = n[at]
            n[at] = before + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(before)) / ALPHA * w
    w = weights(np.arange(1 << BITS))
    at = np.flatnonzero(w)
    return at, w[at]


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def sample(labels: DataFrame, n: int = MAX_TRAIN) -> DataFrame:
    """doc_id, label and digest of the labelled rows to learn from, one a doc_id, at most n."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("doc_id")) != 0)
    rows = rows.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    digest = F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string"))).alias("digest")
    return rows.select("doc_id", "label", digest).orderBy("digest").limit(n)


def training_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """text, digest and label of the chosen ids (at most MAX_TRAIN), one row each."""
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("digest", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "digest", "label")


def train(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """place and weight of the model, fitted in one task on the bounded sample."""
    chosen = saved(sample(labels), "labelled")
    rows = training_rows(docs, chosen)

    def make_features():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc, place = present(*features(as_bytes(batch.column(0))))
            offsets = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            values = pa.array(place, pa.int32())
            return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(pa.array(offsets), values)], ["digest", "label", "places"])

        return each

    def learn(batches):
        seen = []
        for batch in batches:
            labels_, lists = batch.column(1).to_pylist(), batch.column(2)
            flat, ends = lists.flatten().to_numpy().astype(np.int32), np.cumsum(lists.value_lengths().to_numpy())
            seen += list(zip(labels_, np.split(flat, ends[:-1]), strict=True)) if len(labels_) else []
        if seen:
            at, w = fit(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w)], ["place", "weight"])

    found = arrow_map(rows, "digest string, label int, places array<int>", make_features)
    return found.repartition(1).sortWithinPartitions("digest").mapInArrow(learn, "place int, weight double")


def score(docs: DataFrame, model: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and the score of each text; the model is broadcast, at most 2**BITS places. A kept column `score` is replaced."""
    keep = tuple(without(docs.select(*keep), "score"))
    got = model.toPandas()
    weights = np.zeros(1 << BITS, np.float32)
    weights[got["place"].to_numpy(np.int64)] = got["weight"].to_numpy(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(weights), weights[np.flatnonzero(weights)]))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]

    def make():
        dense = np.zeros(1 << BITS)
        dense[sent.value[0]] = sent.value[1]
        used = dense != 0

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc, place = features(as_bytes(batch.column(0)))
            hit = used[place]
            doc, place = present(doc[hit], place[hit])
            x = np.bincount(doc, dense[place], batch.num_rows) + dense[BIAS]
            return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(1 / (1 + np.exp(-x)))], [*keep, "score"])

        return each

    return arrow_map(docs.select(text, *keep), ", ".join([*fields, "score double"]), make)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = score(docs, train(docs, labels))
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
