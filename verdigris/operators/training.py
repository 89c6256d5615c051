"""Heads over vectors, trained by mini-batches: gradients from tasks, added up in a tree, Adam on the driver.

A head is one linear unit, or a hidden layer with GELU and dropout before it.  Rows are
dealt to batches by a hash of their id and written batch by batch, so a step reads its
own rows only; epochs take the batches in a seeded order.  In a step each task sums the
gradients of its rows over Arrow batches, a few tasks add up these sums, and the driver,
which holds the weights and nothing that grows with the rows, takes the step.

A row's dropout follows from its id, the epoch and the seed, so results do not depend on
the partitioning, but for the order of additions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from ..sources.image_files import opened
from ..sources.stores import Store, content_digest

#: Tasks that add up the other tasks' sums.
FAN_IN = 16
#: Rows of one file of a batch, about.
FILE_ROWS = 65_536
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


def erf(x: np.ndarray) -> np.ndarray:
    """The error function, to 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - tail * np.exp(-x * x))


def _uniform(rows: np.ndarray, units: int, seed: int) -> np.ndarray:
    """A number below 1 for each row (a 64-bit hash) and unit."""
    x = rows.view(np.uint64)[:, None] + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, units + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


@dataclass(frozen=True)
class Head:
    """kind `linear` or `mlp` (hidden units, GELU, dropout), over vectors of `width`."""

    width: int
    kind: str = "linear"
    hidden: int = 256
    dropout: float = 0.1

    def __post_init__(self) -> None:
        if self.kind not in ("linear", "mlp"):
            raise ValueError(f"unknown head {self.kind}")

    def shapes(self) -> list[tuple[int, ...]]:
        first = [(self.hidden, self.width), (self.hidden,)] if self.kind == "mlp" else []
        return [*first, (self.hidden if first else self.width,), ()]

    def parts(self, weights: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes()])
        return [x.reshape(s) for x, s in zip(np.split(weights, ends[:-1]), self.shapes(), strict=True)]

    def start(self, seed: int) -> np.ndarray:
        """Uniform within one over the root of the inputs, for weights and biases."""
        rng, out = np.random.default_rng(seed), []
        for k, shape in enumerate(self.shapes()):
            inputs = self.width if self.kind == "linear" or k < 2 else self.hidden
            out.append(rng.uniform(-1, 1, int(np.prod(shape))) / np.sqrt(inputs))
        return np.concatenate(out)

    def _middle(self, x: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h = x @ parts[0].T + parts[1]
        return h, 0.5 * (1 + erf(h / np.sqrt(2)))

    def logits(self, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
        parts = self.parts(weights)
        if self.kind == "mlp":
            h, share = self._middle(x, parts)
            x = h * share
        return x @ parts[-2] + parts[-1]

    def gradient(self, weights: np.ndarray, x: np.ndarray, y: np.ndarray, rows: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
        """Sums over rows of the gradient and of the loss (binary cross-entropy of logits)."""
        parts, used = self.parts(weights), x
        if self.kind == "mlp":
            h, share = self._middle(x, parts)
            keep = (_uniform(rows, self.hidden, seed) >= self.dropout) / (1 - self.dropout)
            used = h * share * keep
        z = used @ parts[-2] + parts[-1]
        loss = np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * y
        off = 1 / (1 + np.exp(-z)) - y
        out = [off @ used, off.sum(keepdims=True)]
        if self.kind == "mlp":
            slope = share + h * np.exp(-h * h / 2) / np.sqrt(2 * np.pi)
            back = np.outer(off, parts[-2]) * keep * slope
            out = [(back.T @ x).ravel(), back.sum(0), *out]
        return np.concatenate(out), float(loss.sum())


@dataclass
class State:
    """Weights and Adam's moments, how many steps and epochs were taken, and the best weights so far."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0
    epochs: int = 0
    best: np.ndarray = field(default_factory=lambda: np.zeros(0))
    best_accuracy: float = -1.0

    def step(self, gradient: np.ndarray, rate: float) -> None:
        self.steps += 1
        self.first = BETA1 * self.first + (1 - BETA1) * gradient
        self.second = BETA2 * self.second + (1 - BETA2) * gradient * gradient
        mean, spread = self.first / (1 - BETA1**self.steps), self.second / (1 - BETA2**self.steps)
        self.weights = self.weights - rate * mean / (np.sqrt(spread) + EPSILON)


def _vectors(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def gradient_sums(rows: DataFrame, head: Head, weights: np.ndarray, seed: int) -> tuple[np.ndarray, float, int]:
    """Sums of the gradient and the loss over rows (x, y, row), and how many rows there are."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = np.zeros(len(sent.value)), 0.0, 0
        for batch in batches:
            if batch.num_rows:
                x, y, row = _vectors(batch.column(0), batch.num_rows), batch.column(1).to_numpy().astype(np.float64), batch.column(2).to_numpy()
                own, own_loss = head.gradient(sent.value, x, y, row, seed)
                total, loss, n = total + own, loss + own_loss, n + batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([loss]), pa.array([n])], ["sums", "loss", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = np.zeros(len(sent.value)), 0.0, 0
        for batch in batches:
            for s, x, k in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                total, loss, n = total + np.frombuffer(s), loss + x, n + k
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([loss]), pa.array([n])], ["sums", "loss", "n"])

    schema = "sums binary, loss double, n bigint"
    sums = rows.select("x", "y", "row").mapInArrow(tasks, schema).where("n > 0").repartition(FAN_IN).mapInArrow(added, schema).where("n > 0")
    total, loss, n = np.zeros(len(weights)), 0.0, 0
    for r in sums.toArrow().to_pylist():
        total, loss, n = total + np.frombuffer(r["sums"]), loss + r["loss"], n + r["n"]
    sent.unpersist()
    return total, loss, n


def with_predictions(rows: DataFrame, head: Head, weights: np.ndarray, vector: str, name: str = "pred") -> DataFrame:
    """rows with the probability that the head gives their vector."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    at = rows.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = head.logits(weights, _vectors(batch.column(at), batch.num_rows)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-z)))], [*batch.schema.names, name])

    return rows.mapInArrow(run, f"{kinds}, `{name}` double")


def batched(train: DataFrame, vector: str, label: str, ident: str, batch: int, seed: int) -> tuple[DataFrame, int]:
    """x, y and row (a hash of the id) of the rows, written by their batch of about `batch` rows, and how many batches there are."""
    n = train.count()
    count = max(1, round(n / batch))
    row = F.xxhash64(F.lit(seed), F.col(ident))
    rows = train.select(F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"), row.alias("row"), F.pmod(row, F.lit(count)).cast("int").alias("batch"))
    spread = F.pmod(F.xxhash64("row"), F.lit(-(-batch // FILE_ROWS)))
    return written(rows.repartition("batch", spread).sortWithinPartitions("batch"), "batches", "batch"), count


def train_head(
    train: DataFrame, held: DataFrame, vector: str, label: str, ident: str, head: Head, epochs: int = 3, batch: int = 8192, rate: float = 1e-3, seed: int = 1,
    store: Store | None = None, fields: Mapping | None = None, told: Callable[[int, float, float], None] | None = None,
) -> State:
    """The state after `epochs`; its `best` weights are those of the first epoch with the highest held-out accuracy.

    With a store, the state is saved after each epoch under all that it depends on (`fields`,
    the head, the options, the rows), and training goes on from what is there.
    """
    state = State(head.start(seed), *(np.zeros(len(head.start(seed))) for _ in range(2)))
    known: dict = {}
    if store:
        known = dict(fields or {}) | {"head": repr(head), "batch": batch, "rate": rate, "seed": seed, "train": content_digest(train, [ident, vector, label]), "held": content_digest(held, [vector, label])}
        if (found := store.load(known)) is not None:
            state = State(**{k: v if v.ndim else v.item() for k, v in found.items()})
    if state.epochs >= epochs:
        return state
    rows, count = batched(train, vector, label, ident, batch, seed)
    for epoch in range(state.epochs, epochs):
        order, losses, seen = np.random.default_rng([seed, epoch]).permutation(count), 0.0, 0
        for b in order.tolist():
            total, loss, n = gradient_sums(rows.where(F.col("batch") == b), head, state.weights, seed + 1000 * epoch)
            if n:
                state.step(total / n, rate)
                losses, seen = losses + loss, seen + n
        right = (F.col("pred") >= 0.5).cast("int") == F.col(label).cast("int")
        accuracy = with_predictions(held.select(vector, label), head, state.weights, vector).agg(F.avg(right.cast("double"))).first()[0] or 0.0
        state.epochs = epoch + 1
        if accuracy > state.best_accuracy:
            state.best, state.best_accuracy = state.weights.copy(), accuracy
        if store:
            store.save(known, vars(state))
        if told:
            told(epoch + 1, losses / max(1, seen), accuracy)
    return state


def extracted(files: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], cache: str, model: str, batch: int = 64) -> DataFrame:
    """path and features of files (path, length, modificationTime, content), those of `cache` (Parquet) as they are, the others predicted and added to it.

    make_model: called once a worker; it gives a function from contents to vectors, which
    takes `batch` files at a time.  A file is known by its path, length and time, so files
    that are in the cache are not read.  Rows of another model do not count.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    spark, key = files.sparkSession, ["path", "length", "modificationTime"]
    schema = "path string, length bigint, modificationTime timestamp, model string, features array<float>"
    store, root = opened(cache)
    there = store.get_file_info(root).type != fs.FileType.NotFound
    known = (spark.read.schema(schema).parquet(cache) if there else spark.createDataFrame([], schema)).where(F.col("model") == model)
    missing = files.select(*key).join(known.select(*key), key, "left_anti")
    if not missing.isEmpty():
        predict = predict_batch_udf(make_model, return_type=ArrayType(FloatType()), batch_size=batch)
        todo = files.join(missing.select("path"), "path", "left_semi") if there else files
        todo.select(*key, F.lit(model).alias("model"), predict("content").alias("features")).write.mode("append").parquet(cache)
        known = spark.read.schema(schema).parquet(cache).where(F.col("model") == model)
    return files.select(*key).join(known, key).select("path", "features").dropDuplicates(["path"])
