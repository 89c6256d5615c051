"""Queries that write given tables as files and read them back by the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels
from ..functions.tables import shared_folder, spread, written
from ..functions.values import SEED_SALT
from ..operators import materialize, training
from ..schema import SOURCE, SOURCE_REQUIRED
from ..sources import readers, sinks
from .registry import query, rounded, table


@query(
    """SELECT doc_id, label, md5(image) AS image FROM (SELECT doc_id, (doc_id % 3)::INT AS label, text AS image, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE doc_id % 3 <> 2) WHERE k <= 300"""
)
def capped_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 rows of known labels of Parquet shards that hold the documents in order, by counts of shards and no sort."""
    rows = table(spark, sf_dir, "documents").select(F.struct("doc_id", "text").alias("image"), (F.col("doc_id") % 3).alias("label"))
    shards = written(rows.repartitionByRange(8, "image.doc_id").sortWithinPartitions("image.doc_id"), "shards")
    found = readers.shards(spark, shards.inputFiles()[0].rpartition("/")[0], cap=300)
    return found.select("image.doc_id", "label", F.md5(F.col("image.text")).alias("image"))


_SOURCES = """sources AS (
  SELECT sha1('part/' || p_partkey) AS image_id, 'parts/' || p_brand || '/' || p_partkey || '.jpg' AS path, (p_size % 2)::INT AS label, p_type AS source_dataset,
         CASE WHEN p_size % 2 = 1 THEN lower(p_brand) END AS generator, ['train', 'val', 'test', 'unseen'][p_size % 4 + 1] AS split, (p_size * 8)::INT AS width, (p_size + 7)::INT AS height
  FROM part)"""


def _sources(parts: DataFrame) -> DataFrame:
    """Records of a source manifest, one a part."""
    key, fake = F.col("p_partkey").cast("string"), F.col("p_size") % 2 == 1
    splits = F.array(*[F.lit(x) for x in ("train", "val", "test", "unseen")])
    rows = parts.withColumns(
        {
            "image_id": F.sha1(F.concat(F.lit("part/"), key)), "path": F.concat(F.lit("parts/"), "p_brand", F.lit("/"), key, F.lit(".jpg")),
            "label": F.col("p_size") % 2, "source_dataset": F.col("p_type"), "generator": F.when(fake, F.lower("p_brand")),
            "split": F.get(splits, (F.col("p_size") % 4).cast("int")), "width": F.col("p_size") * 8, "height": F.col("p_size") + 7,
        }
    )
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SOURCE.fields])


@query(f"WITH {_SOURCES} SELECT image_id, path, label, source_dataset, generator, split, width, height FROM sources")
def strict_manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source manifest as JSON lines, read back strictly."""
    path = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}.jsonl"
    sinks.json_lines(_sources(table(spark, sf_dir, "part")), path)
    return readers.strict_manifest(spark, path, SOURCE, SOURCE_REQUIRED).select("image_id", "path", "label", "source_dataset", "generator", "split", "width", "height")


_PLAIN = [s for s in pixels.SETTINGS if s[1] != "jitter"]
_DIMS = ", ".join(f"('{key}', '{op}', '{name}', {float(v)}::DOUBLE)" for key, op, name, v in _PLAIN)


@query(
    f"""WITH {_SOURCES}, s AS (SELECT * FROM (VALUES {_DIMS}) t(transform_key, transform, param, value))
SELECT image_id || '_' || transform_key AS row_id, path AS source_path, transform, param, value,
       ('0x' || substr(sha1(image_id || '|' || transform_key || '|{SEED_SALT}'), 1, 14))::BIGINT AS seed,
       '/out/' || transform_key || '/' || image_id[1:2] || '/' || image_id || CASE WHEN transform = 'jpeg' THEN '.jpg' ELSE '.png' END AS path,
       label, generator, split,
       CASE WHEN transform = 'crop' THEN greatest(1, round_even(width * value, 0)::INT) ELSE width END AS width,
       CASE WHEN transform = 'crop' THEN greatest(1, round_even(height * value, 0)::INT) ELSE height END AS height
FROM sources, s"""
)
def transform_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all parts under all settings whose parameters are fixed."""
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size"), 5_000)
    rows = materialize.manifest_rows(_sources(parts), _PLAIN, "/out", "path")
    param = F.explode("params").alias("param", "value")
    return rows.select("row_id", "source_path", "transform", param, "seed", "path", "label", "generator", "split", "width", "height")


@query(
    """SELECT 'root/' || source || '/' || doc_id || '.jpg' AS image_path, (doc_id * 7919 % 1000)::DOUBLE / 1000::DOUBLE AS pred, (doc_id % 2)::INT AS y, lang AS condition FROM documents"""
)
def prediction_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as files of one JSON array each, written and read back."""
    rows = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("root/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image_path"),
        ((F.col("doc_id") * 7919 % 1000).cast("double") / F.lit(1000.0)).alias("pred"), (F.col("doc_id") % 2).cast("int").alias("y"), F.col("lang").alias("condition"),
    )
    # An array is a file, of the documents of one thousand ids.
    arrays = rows.groupBy(F.floor(F.regexp_extract("image_path", r"(\d+)\.jpg$", 1).cast("long") / 1000)).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    folder = f"{shared_folder(spark)}/predictions-{uuid.uuid4().hex}"
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return readers.predictions(spark, folder).select("image_path", "pred", "y", "condition")


_HEAD, _EPOCHS, _RATE = training.Head(64), 4, 0.05


def _head_sql() -> str:
    start = "[" + ", ".join(repr(float(x)) for x in _HEAD.start(1)) + "]::DOUBLE[]"
    n = _HEAD.width + 1
    zero = f"[0.0 for i in range({n})]::DOUBLE[]"
    steps = [f"s0 AS (SELECT {start} AS w, {zero} AS m, {zero} AS v)"]
    for k in range(1, _EPOCHS + 1):
        moved = f"w[i] - {_RATE} * (m[i] / (1 - 0.9::DOUBLE ** {k})) / (sqrt(v[i] / (1 - 0.999::DOUBLE ** {k})) + 1e-8)"
        steps.append(f"""g{k} AS (
  SELECT list(g ORDER BY i) AS g FROM (
    SELECT i, sum((1 / (1 + exp(-list_dot_product(x, w))) - y) * x[i]) / count(*) AS g FROM e, s{k - 1}, range(1, {n + 1}) t(i) WHERE NOT held GROUP BY i))""")
        steps.append(f"""s{k} AS MATERIALIZED (
  SELECT [{moved} for i in range(1, {n + 1})] AS w, m, v FROM (
    SELECT w, [0.9::DOUBLE * m[i] + 0.1::DOUBLE * g[i] for i in range(1, {n + 1})] AS m, [0.999::DOUBLE * v[i] + 0.001::DOUBLE * g[i] * g[i] for i in range(1, {n + 1})] AS v FROM s{k - 1}, g{k}))""")
    rated = " UNION ALL ".join(f"SELECT {k} AS k, any_value(w) AS w, avg(((list_dot_product(x, w) >= 0)::INT = y)::INT) AS accuracy FROM e, s{k} WHERE held" for k in range(1, _EPOCHS + 1))
    return f"""
WITH e AS (SELECT vec_id, list_append(embedding::DOUBLE[], 1.0) AS x, (label < 5)::INT AS y, md5(vec_id::VARCHAR)[1:1] IN ('0', '1', '2', '3') AS held FROM embeddings),
{", ".join(steps)},
best AS (SELECT w FROM ({rated}) ORDER BY accuracy DESC, k LIMIT 1)
SELECT vec_id, held, round(1 / (1 + exp(-list_dot_product(x, w))), 8) AS pred FROM e, best"""


@query(_head_sql())
def adam_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear head trained by Adam, the best epoch by accuracy on held-out rows, and its scores of all rows."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding"), (F.col("label") < 5).cast("int").alias("y"), F.left(F.md5(F.col("vec_id").cast("string")), F.lit(1)).isin("0", "1", "2", "3").alias("held")
    )
    state = training.train_head(rows.where(~F.col("held")), rows.where("held"), "embedding", "y", "vec_id", _HEAD, epochs=_EPOCHS, batch=1_000_000, rate=_RATE, seed=1)
    return rounded(training.with_predictions(rows, _HEAD, state.best, "embedding").select("vec_id", "held", "pred"))
