"""Scoring: injected predictors, linear heads, fused scores, similarity to prototypes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import cosine, fused, sigmoid

Predictor = Callable[[DataFrame], DataFrame]


def stub(rows: DataFrame) -> DataFrame:
    """The score of a model that is not there."""
    return rows.withColumn("pred", F.lit(0.5))


def scored(rows: DataFrame, predictor: Predictor = stub, conditions: Sequence[str] = ("clean",)) -> DataFrame:
    """Rows under each condition, with the predictor's `pred`."""
    return predictor(rows.withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions]))))


def linear_score(vector: Column, weights: Sequence[float], bias: float = 0.0) -> Column:
    """Sigmoid of a linear head over an array column, as a native expression."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    z = F.aggregate(F.zip_with(vector, w, lambda x, y: x.cast("double") * y), F.lit(float(bias)), lambda a, x: a + x)
    return sigmoid(z)


def fused_score(rows: DataFrame, a: str, b: str, weight: float = 0.5) -> DataFrame:
    return rows.withColumn("pred", fused(F.col(a), F.col(b), weight))


def fit_linear_head(rows: DataFrame, vector: str, label: str, rounds: int = 50, regularisation: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic head (L-BFGS over the cluster)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector(F.col(vector)).alias("features"), F.col(label).cast("double").alias("label"))
    model = LogisticRegression(maxIter=rounds, regParam=regularisation).fit(data)
    return model.coefficients.toArray(), float(model.intercept)


def prototypes(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """label and its mean unit vector, as an array: one row a class.  Vectors are added up inside each task, whole; a zero vector counts for nothing."""
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    units = Normalizer(inputCol="v", outputCol="u").transform(rows.select(F.col(label).alias("proto"), array_to_vector(F.col(vector)).alias("v")))
    filled = F.aggregate(vector_to_array("u"), F.lit(0.0), lambda a, x: a + F.abs(x)) > 0
    return units.where(filled).groupBy("proto").agg(vector_to_array(Summarizer.mean(F.col("u"))).alias("mean"))


def nearest_prototypes(rows: DataFrame, protos: DataFrame, vector: str, ident: str) -> DataFrame:
    """ident, best prototype, its cosine and the margin to the second best, in one projection of rows.

    protos: a few classes, counted before they are sent; of equal cosines the smaller name is first.
    """
    if (n := protos.count()) > 10_000:
        raise ValueError(f"{n} prototypes are too many to send to every task")
    every = protos.agg(F.array_sort(F.collect_list(F.struct("proto", "mean"))).alias("protos"))  # one row
    scores = F.transform("protos", lambda p: F.struct((-cosine(F.col(vector), p["mean"])).alias("s"), p["proto"].alias("proto")))
    ranked = rows.select(ident, vector).crossJoin(F.broadcast(every)).select(ident, F.slice(F.array_sort(scores), 1, 2).alias("top"))
    first, second = F.get("top", 0), F.get("top", 1)
    return ranked.where(F.size("top") > 0).select(
        ident, first["proto"].alias("best"), (-first["s"]).alias("score"), (second["s"] - first["s"]).alias("margin")
    )


def style_similarity(rows: DataFrame, vector: str, photo: Sequence[float], style: Sequence[float]) -> DataFrame:
    """Adds photo_sim and style_sim (cosines to two given vectors) and `stylized`, whether the second is above the first."""
    to = lambda v: cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in v]))
    rows = rows.withColumns({"photo_sim": to(photo), "style_sim": to(style)})
    return rows.withColumn("stylized", F.coalesce(F.col("style_sim") > F.col("photo_sim"), F.lit(False)))


def fit_head_by_eval(
    train: DataFrame, held: DataFrame, vector: str, label: str, penalties: Sequence[float] = (1e-4, 1e-3, 1e-2, 1e-1), kind: str = "linear", hidden: int = 256, rounds: int = 100
) -> tuple[Callable[[DataFrame], DataFrame], float]:
    """The best head by AUROC on held-out rows, as a predictor that adds `pred`, and that AUROC.

    kind `linear`: one logistic head for each penalty, of which the best stays (the first of
    equals).  kind `mlp`: one hidden layer of `hidden` units.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from .metrics import auroc

    def quality(predictor: Callable[[DataFrame], DataFrame]) -> float:
        found = auroc(predictor(held).select("pred", F.col(label).alias("label"))).first()["auroc"]
        return float("nan") if found is None else float(found)

    def linear(penalty: float) -> Callable[[DataFrame], DataFrame]:
        weights, bias = fit_linear_head(train, vector, label, rounds, penalty)
        return lambda rows: rows.withColumn("pred", linear_score(F.col(vector), weights, bias))

    if kind == "linear":
        heads = [linear(p) for p in penalties]
    elif kind == "mlp":
        size = train.select(F.size(vector)).first()[0]
        data = train.select(array_to_vector(F.col(vector)).alias("features"), F.col(label).cast("double").alias("label"))
        model = MultilayerPerceptronClassifier(layers=[size, hidden, 2], maxIter=rounds, seed=1).fit(data)

        def perceptron(rows: DataFrame) -> DataFrame:
            made = model.transform(rows.withColumn("features", array_to_vector(F.col(vector))))
            return made.select(*rows.columns, vector_to_array("probability")[1].alias("pred"))

        heads = [perceptron]
    else:
        raise ValueError(f"unknown head {kind}")
    rated = [(quality(h), h) for h in heads]
    best = max(rated, key=lambda x: (x[0] == x[0], x[0]))
    return best[1], best[0]


#: Bytes of a stack (its floats stay in the processor's cache), and of all that wait for their stacks to fill: whatever the images' sizes, a task holds no more beside the images of one row.
STACK, WAITING = 1 << 16, 1 << 23


def _stacks(images: Iterable[tuple[np.ndarray, tuple]]) -> Iterator[tuple[list[int], np.ndarray, tuple]]:
    """(places, stack, key) of (image, key): images of one shape and one key are stacked, each under its place in `images`."""
    waiting: dict[tuple, list[tuple[int, np.ndarray]]] = {}
    held = 0
    for place, (img, key) in enumerate(images):
        waiting.setdefault((img.shape, key), []).append((place, img))
        held += img.nbytes
        full = [(img.shape, key)] if len(waiting[img.shape, key]) * img.nbytes >= STACK else list(waiting) if held >= WAITING else []
        for at in full:
            rows = waiting.pop(at)
            held -= sum(x.nbytes for _, x in rows)
            yield [k for k, _ in rows], np.stack([x for _, x in rows]), at[1]
    for (_, key), rows in waiting.items():
        yield [k for k, _ in rows], np.stack([x for _, x in rows]), key


def transformed(rows: DataFrame, apply: Callable[[np.ndarray, str, float, int], tuple[np.ndarray, Mapping[str, float]]]) -> DataFrame:
    """Images (row_id, pixels binary: height x width x 3 bytes, height, width, op, value, seed) after their operation, in Arrow batches."""

    def each(stack, op, value, seeds):
        return tuple(zip(*[apply(img, op, value, seed) for img, seed in zip(stack, seeds, strict=True)], strict=True))

    return transformed_stacks(rows, each)


def transformed_stacks(
    rows: DataFrame, apply: Callable[[np.ndarray, str, float, Sequence[int]], tuple[Sequence[np.ndarray], Sequence[Mapping[str, float]]]],
    measures: Mapping[str, tuple[str, pa.DataType, Callable[[np.ndarray], np.ndarray]]] | None = None,
) -> DataFrame:
    """As transformed, where `apply` takes images of one size under one operation as a stack, with one seed an image.

    measures: column -> (its type, in Arrow, function of the stack of results, one value an image).
    Where given, they come in place of the pixels, which then do not leave the task.
    """
    kinds = {n: (kind, arrow) for n, (kind, arrow, _) in measures.items()} if measures else {"pixels": ("binary", pa.binary())}
    schema = ", ".join(["row_id string, height int, width int", *(f"`{n}` {kind}" for n, (kind, _) in kinds.items()), "params map<string,double>"])
    names = ["row_id", "height", "width", *kinds, "params"]
    types = [pa.string(), pa.int32(), pa.int32(), *(arrow for _, arrow in kinds.values()), pa.map_(pa.string(), pa.float64())]

    def run(batches):
        for batch in batches:
            idents, contents, heights, widths, ops, values, seeds = (batch.column(k).to_pylist() for k in range(7))
            shaped = (np.frombuffer(c, np.uint8).reshape(h, w, 3) for c, h, w in zip(contents, heights, widths, strict=True))
            made: list = [None] * len(idents)
            for places, stack, (op, value) in _stacks(zip(shaped, zip(ops, values, strict=True), strict=True)):
                out, params = apply(stack, op, value, [seeds[k] for k in places])
                found = [f(out).tolist() for _, _, f in measures.values()] if measures else [[x.tobytes() for x in out]]
                for k, x, used, *own in zip(places, out, params, *found, strict=True):
                    made[k] = (idents[k], *x.shape[:2], *own, {n: float(v) for n, v in used.items()})
            columns = zip(*made, strict=True) if made else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return rows.select("row_id", "pixels", "height", "width", "op", "value", "seed").mapInArrow(run, schema)


def measured(rows: DataFrame, decode: Callable[[bytes], np.ndarray], path: str = "path", keep: Sequence[str] = ()) -> DataFrame:
    """path, width, height, phash and the low-level measures and slices of image files (path, content binary), and columns to keep; a file that is no image is an error.

    Images of one size are measured in stacks.
    """
    from ..functions import pixels

    probe = pixels.features(np.zeros((2, 2, 3), np.uint8))
    kinds = {int: (pa.int32(), "int"), float: (pa.float64(), "double"), str: (pa.string(), "string")}
    names = [path, "phash", *probe]
    held = dict(rows.dtypes)
    schema = ", ".join([f"`{path}` string", "phash string", *(f"{n} {kinds[type(v)][1]}" for n, v in probe.items()), *(f"`{c}` {held[c]}" for c in keep)])

    def run(batches):
        for batch in batches:
            paths = batch.column(0).to_pylist()
            found: list = [None] * len(paths)
            for places, stack, _ in _stacks((decode(c.as_py()), ()) for c in batch.column(1)):
                files = [paths[k] for k in places]
                measures = pixels.features_of_stack(stack, [f.rpartition(".")[2] for f in files])
                for k, name, phash, values in zip(places, files, pixels.perceptual_hashes(stack), measures, strict=True):
                    found[k] = {path: name, "phash": phash} | values
            types = [pa.string(), pa.string(), *(kinds[type(v)][0] for v in probe.values())]
            made = [pa.array([f[n] for f in found], t) for n, t in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[2:]], [*names, *keep])

    return rows.select(path, "content", *keep).mapInArrow(run, schema)


def thumbnails(rows: DataFrame, decode: Callable[[bytes], np.ndarray], side: int = 160, path: str = "path") -> DataFrame:
    """path and `thumb`: each image file (path, content), shrunk to `side` pixels at most, as PNG; null where it is no image."""
    from ..functions import pixels

    def made(content: bytes | None) -> bytes | None:
        try:
            return pixels.png_bytes(pixels.bounded(decode(content), side))
        except Exception:  # whatever a codec raises: the card says that there is no picture
            return None

    def run(batches):
        for batch in batches:
            thumbs = pa.array([made(c) for c in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), thumbs], [path, "thumb"])

    return rows.select(path, "content").mapInArrow(run, f"`{path}` string, thumb binary")
