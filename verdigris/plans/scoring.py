"""Queries that score rows and work on arrays."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import spread
from ..functions.values import entropy, fused, sigmoid
from ..operators import scoring
from ..streaming.windows import windowed_confusion, windowed_histogram
from .registry import query, rounded, table
from .views import PRED, predictions

_WEIGHTS = [round(((k * 37) % 21 - 10) / 10, 1) for k in range(64)]


@query(f"SELECT vec_id, label, round(1 / (1 + exp(-(list_dot_product(embedding::DOUBLE[], {_WEIGHTS}::DOUBLE[]) + 0.1::DOUBLE))), 6) AS pred FROM embeddings")
def linear_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear head over frozen vectors, as an expression."""
    rows = table(spark, sf_dir, "embeddings")
    return rounded(rows.select("vec_id", "label", scoring.linear_score(F.col("embedding"), _WEIGHTS, 0.1).alias("pred")), 6)


@query(
    f"""WITH {PRED}, f AS (SELECT doc_id, least(greatest(pred, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS p, least(greatest((doc_id % 97) / 97::DOUBLE, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS q FROM pred)
SELECT doc_id, round(1 / (1 + exp(-(0.6::DOUBLE * ln(p / (1 - p)) + 0.4::DOUBLE * ln(q / (1 - q))))), 8) AS pred FROM f"""
)
def fused_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores on the logit scale."""
    rows = predictions(spark, sf_dir).withColumn("other", (F.col("doc_id") % 97).cast("double") / F.lit(97.0))
    return rounded(rows.select("doc_id", fused(F.col("pred"), F.col("other"), 0.6).alias("pred")))


@query(f"WITH {PRED} SELECT doc_id, 0.5::DOUBLE AS pred, c AS condition FROM pred, (SELECT unnest(['clean', 'blur']) AS c)")
def stub_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An injected predictor under conditions."""
    return scoring.scored(predictions(spark, sf_dir).select("doc_id"), conditions=("clean", "blur")).select("doc_id", "pred", "condition")


_NEAREST = """WITH n AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings),
x AS (SELECT label, unnest(e) / norm AS v, unnest(range(64)) AS k FROM n), c AS (SELECT label, k, avg(v) AS m FROM x GROUP BY ALL),
p AS (SELECT label AS proto, list(m ORDER BY k) AS mean FROM c GROUP BY label),
s AS (SELECT vec_id, proto, list_dot_product(e, mean) / (norm * sqrt(list_dot_product(mean, mean))) AS s FROM n, p),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, proto) AS k FROM s)
SELECT vec_id, max(CASE WHEN k = 1 THEN proto END) AS best, round(max(CASE WHEN k = 1 THEN s END), 6) AS score,
       round(max(CASE WHEN k = 1 THEN s END) - max(CASE WHEN k = 2 THEN s END), 6) AS margin FROM r GROUP BY vec_id"""


@query(_NEAREST)
def nearest_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine to class means, best and margin."""
    rows = table(spark, sf_dir, "embeddings")
    protos = scoring.prototypes(rows, "embedding", "label")
    return rounded(scoring.nearest_prototypes(rows, protos, "embedding", "vec_id"), 6)


_PHOTO, _STYLE = [float(k % 5 - 2) for k in range(64)], [float(k % 7 - 3) for k in range(64)]


@query(
    f"""WITH s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {_PHOTO}::DOUBLE[]) AS p, list_cosine_similarity(embedding::DOUBLE[], {_STYLE}::DOUBLE[]) AS s FROM embeddings)
SELECT vec_id, round(p, 6) AS photo_sim, round(s, 6) AS style_sim, s > p AS stylized FROM s"""
)
def style_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines to a photo and a style vector, and which is nearer."""
    rows = scoring.style_similarity(table(spark, sf_dir, "embeddings"), "embedding", _PHOTO, _STYLE)
    return rounded(rows.select("vec_id", "photo_sim", "style_sim", "stylized"), 6)


@query(
    """WITH c AS (SELECT source, n_chars // 500 AS bin, count(*)::DOUBLE AS n FROM documents GROUP BY ALL), t AS (SELECT source, sum(n) AS total FROM c GROUP BY 1)
SELECT source, round(-sum(n / total * log2(n / total)), 8) AS entropy FROM c JOIN t USING (source) GROUP BY 1"""
)
def histogram_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of a histogram."""
    bins = table(spark, sf_dir, "documents").groupBy("source", F.floor(F.col("n_chars") / 500).alias("bin")).agg(F.count("*").cast("double").alias("n"))
    return rounded(bins.groupBy("source").agg(F.array_sort(F.collect_list("n")).alias("counts")).select("source", entropy(F.col("counts")).alias("entropy")))


@query("SELECT p_partkey, round(1 / (1 + exp(-(p_size - 25) / 10::DOUBLE)), 8) AS p FROM part")
def sigmoid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11."""
    return rounded(table(spark, sf_dir, "part").select("p_partkey", sigmoid((F.col("p_size") - 25) / F.lit(10.0)).alias("p")))


def trained_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic head fitted by L-BFGS, and its scores."""
    rows = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    weights, bias = scoring.fit_linear_head(rows, "embedding", "y")
    return rows.select("vec_id", "y", scoring.linear_score(F.col("embedding"), weights, bias).alias("pred"))


query()(trained_head)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", "ts", "event_type", ((F.col("event_id") * 31 % 100).cast("double") / F.lit(100.0)).alias("pred"), (F.col("user_id") % 2).cast("int").alias("label"))


_EVENTS = "WITH e AS (SELECT event_id, ts, event_type, (event_id * 31 % 100)::DOUBLE / 100::DOUBLE AS pred, (user_id % 2)::INT AS label FROM events)"


@query(
    f"""{_EVENTS} SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')::VARCHAR AS day, event_type, count_if(pred >= 0.5 AND label = 1) AS tp, count_if(pred >= 0.5 AND label = 0) AS fp,
  count_if(pred < 0.5 AND label = 0) AS tn, count_if(pred < 0.5 AND label = 1) AS fn FROM e GROUP BY ALL"""
)
def windowed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: confusion counts by day, the same code as for a stream."""
    rows = windowed_confusion(_events(spark, sf_dir), keys=("event_type",))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "tp", "fp", "tn", "fn")


@query(
    f"""{_EVENTS} SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')::VARCHAR AS day, least(floor(pred * 10), 9)::INT AS slot, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM e GROUP BY ALL"""
)
def windowed_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: mergeable score histograms by day."""
    rows = windowed_histogram(_events(spark, sf_dir), slots=10)
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("day"), "slot", "pos", "neg")


def _pixels(n: int) -> Column:
    """n bytes that count up by 7 + p_size; they come back after 256, so that no more are made."""
    period = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.lpad(F.hex((i * 7 + F.col("p_size") * i) % 256), 2, "0"))
    return F.unhex(F.left(F.repeat(F.array_join(period, ""), -(-n // 256)), F.lit(2 * n)))


def pixel_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small synthetic images under the settings that need no codec."""
    from ..functions import pixels
    from ..functions.values import seed56

    settings = [s for s in pixels.SETTINGS if s[1] != "jpeg"]
    items = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("item"), "p_size"), 2_000)
    dims = spark.createDataFrame([(k, op, float(v)) for k, op, _, v in settings], "transform_key string, op string, value double")
    rows = items.withColumn("pixels", _pixels(16 * 12 * 3)).crossJoin(F.broadcast(dims))
    rows = rows.select(
        F.concat_ws("|", "item", "transform_key").alias("row_id"), F.lit(16).alias("height"), F.lit(12).alias("width"), "pixels", "op", "value",
        seed56(F.col("item"), F.col("transform_key")).alias("seed"),
    )
    total = ("int", pa.int32(), lambda stack: stack.reshape(len(stack), -1).sum(1))
    return scoring.transformed_stacks(rows, pixels.apply_to_stack, {"total": total})


query()(pixel_transforms)


def pixel_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, perceptual hash, low-level measures and slices of small synthetic images, read from PPM bytes."""
    from ..functions import pixels

    content = F.concat(F.lit("P6\n24 18\n255\n").cast("binary"), _pixels(24 * 18 * 3))
    items = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), 5_000)
    rows = items.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".ppm")).alias("path"), content.alias("content"))
    return scoring.measured(rows, pixels.ppm_image)


query()(pixel_measures)
