"""Queries that join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import hashed_path, item_id, key_by_marker_priority, key_from_first_marker, without_suffix
from ..functions.values import error_type
from ..operators import joins
from .registry import query, table
from .views import PRED, predictions

#: All documents as predictions; those that have labels are in the index.
_INDEX = """WITH d AS (
  SELECT doc_id, concat_ws('/', 'root', source, CASE WHEN doc_id % 3 = 0 THEN 'fake' ELSE 'real' END, doc_id || '.jpg') AS image_path, (doc_id * 7919 % 1000)::DOUBLE / 1000::DOUBLE AS pred FROM documents),
l AS (SELECT 'root/' || source || '/' || doc_id || '.png' AS rel, quality AS y, doc_id AS o FROM documents JOIN labels USING (doc_id)),
i AS (SELECT key, arg_max(y, o) AS y, count(DISTINCT y) AS n_labels FROM (SELECT rel AS key, y, o FROM l UNION ALL SELECT regexp_replace(rel, '\\.[^./]+$', ''), y, o FROM l) GROUP BY key)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rel = F.concat(F.lit("root/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("rel")
    return joins.label_index(d.select(rel, F.col("quality").alias("y"), "doc_id"), "rel", "y", "doc_id")


@query(f"{_INDEX} SELECT key, y, n_labels FROM i")
def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label under its path with and without ending."""
    return _index(spark, sf_dir)


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    kind = F.when(F.col("doc_id") % 3 == 0, "fake").otherwise("real")
    path = F.concat_ws("/", F.lit("root"), "source", kind, F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")))
    pred = (F.col("doc_id") * 7919 % 1000).cast("double") / F.lit(1000.0)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), path.alias("image_path"), pred.alias("pred"))
    flat = F.regexp_replace("image_path", "/(fake|real)/", "/")
    return rows, [F.col("image_path"), flat, without_suffix(flat)]


@query(
    f"""{_INDEX}, c AS (SELECT doc_id, image_path, pred, regexp_replace(image_path, '/(fake|real)/', '/') AS flat FROM d)
SELECT doc_id AS row_id, pred, coalesce(a.y, b.y, d.y) AS y FROM c LEFT JOIN i a ON a.key = image_path LEFT JOIN i b ON b.key = flat
LEFT JOIN i d ON d.key = regexp_replace(flat, '\\.[^./]+$', '') WHERE coalesce(a.y, b.y, d.y) IS NOT NULL"""
)
def candidate_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate key that the index has."""
    rows, keys = _asked(spark, sf_dir)
    return joins.by_first_match(rows, _index(spark, sf_dir), keys).select("row_id", "pred", "y")


@query(
    f"""{_INDEX} SELECT doc_id AS row_id FROM d WHERE NOT EXISTS (
  SELECT 1 FROM i WHERE key IN (image_path, regexp_replace(image_path, '/(fake|real)/', '/'), regexp_replace(regexp_replace(image_path, '/(fake|real)/', '/'), '\\.[^./]+$', '')))"""
)
def unmatched_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that no candidate finds."""
    rows, keys = _asked(spark, sf_dir)
    return joins.unmatched(rows, _index(spark, sf_dir), keys).select("row_id")


@query(
    """WITH m AS (SELECT doc_id, arg_min(generator, ord) AS generator, arg_min(condition, ord) AS condition, arg_min(source_dataset, ord) AS source_dataset FROM (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS generator, lang AS condition, source AS source_dataset, 0 AS ord FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT vec_id, 'late', 'late', 'late', 1 FROM embeddings) GROUP BY doc_id),
p AS (SELECT doc_id, (doc_id * 7919 % 1000)::DOUBLE / 1000::DOUBLE AS pred, (doc_id % 2)::INT AS label FROM documents)
SELECT p.doc_id, CASE WHEN label = 0 AND coalesce(nullif(m.generator, ''), 'unknown') = 'unknown' THEN 'real' ELSE coalesce(nullif(m.generator, ''), 'unknown') END AS generator,
       coalesce(nullif(m.condition, ''), 'clean') AS condition, coalesce(nullif(m.source_dataset, ''), 'unknown') AS source_dataset,
       CASE WHEN pred >= 0.5 AND label = 1 THEN 'TP' WHEN pred >= 0.5 THEN 'FP' WHEN label = 0 THEN 'TN' ELSE 'FN' END AS error_type
FROM p LEFT JOIN m USING (doc_id)"""
)
def metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the first manifest that has the row, with defaults."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    first = d.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source")).alias("generator"), F.col("lang").alias("condition"),
        F.col("source").alias("source_dataset"), F.lit(0).alias("ord"),
    )
    late = F.lit("late")
    second = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), late.alias("generator"), late.alias("condition"), late.alias("source_dataset"), F.lit(1).alias("ord"))
    pred = (F.col("doc_id") * 7919 % 1000).cast("double") / F.lit(1000.0)
    rows = d.select("doc_id", pred.alias("pred"), (F.col("doc_id") % 2).cast("int").alias("label"))
    defaults = {"generator": "unknown", "condition": "clean", "source_dataset": "unknown"}
    joined = joins.with_metadata(rows, first.unionByName(second), "doc_id", "ord", defaults)
    return joined.select("doc_id", "generator", "condition", "source_dataset", "error_type")


@query(f"""WITH {PRED} SELECT doc_id, CASE WHEN pred >= 0.5 AND label = 1 THEN 'TP' WHEN pred >= 0.5 THEN 'FP' WHEN label = 0 THEN 'TN' ELSE 'FN' END AS error_type FROM pred""")
def self_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that carry their label are scored without a join."""
    return predictions(spark, sf_dir).select("doc_id", error_type(F.col("pred"), F.col("label")).alias("error_type"))


_HASHES = """WITH a AS (SELECT p_partkey AS image_id, substr(md5((p_partkey % 400)::VARCHAR), 1, 16) AS phash, p_size AS size FROM part),
b AS (SELECT s_suppkey AS image_id, substr(md5((s_suppkey * 3)::VARCHAR), 1, 16) AS phash FROM supplier)"""


def _hashes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    digest = lambda c: F.substring(F.md5(c.cast("string")), 1, 16).alias("phash")
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), digest(F.col("p_partkey") % 400), F.col("p_size").alias("size"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), digest(F.col("s_suppkey") * 3))
    return a, b


@query(f"{_HASHES} SELECT DISTINCT a.image_id AS id_a, b.image_id AS id_b FROM a JOIN b USING (phash)")
def equal_hash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5."""
    return joins.equal_hashes(*_hashes(spark, sf_dir))


@query(f"{_HASHES} SELECT image_id, size FROM a WHERE phash NOT IN (SELECT phash FROM b)")
def leak_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows without those whose hash a hold-out has."""
    a, b = _hashes(spark, sf_dir)
    return joins.without_leaks(a, joins.equal_hashes(a, b)).select("image_id", "size")


_BITS = """WITH a AS (SELECT c_custkey AS id, xor(('0x' || substr(md5((c_custkey % 300)::VARCHAR), 1, 15))::BIGINT, c_custkey % 16) AS hash FROM customer),
b AS (SELECT s_suppkey AS id, xor(('0x' || substr(md5((s_suppkey * 2)::VARCHAR), 1, 15))::BIGINT, s_suppkey % 32) AS hash FROM supplier)"""


@query(f"{_BITS} SELECT a.id AS id_a, b.id AS id_b, bit_count(xor(a.hash, b.hash))::INT AS distance FROM a JOIN b ON bit_count(xor(a.hash, b.hash)) <= 3")
def hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes within three bits, by bands."""
    def made(df: DataFrame, key: str, modulus: int | None, factor: int, flips: int) -> DataFrame:
        base = F.col(key) % modulus if modulus else F.col(key) * factor
        h = F.conv(F.substring(F.md5(base.cast("string")), 1, 15), 16, 10).cast("long")
        return df.select(F.col(key).alias("id"), h.bitwiseXOR(F.col(key) % flips).alias("hash"))

    a = made(table(spark, sf_dir, "customer"), "c_custkey", 300, 1, 16)
    b = made(table(spark, sf_dir, "supplier"), "s_suppkey", None, 2, 32)
    return joins.near_hashes(a, b, 3)


_SETTINGS = [("jpeg_q50", "jpeg", 50.0), ("blur_s10", "blur", 1.0), ("crop_p80", "crop", 0.8)]


@query(
    """WITH s AS (SELECT * FROM (VALUES ('jpeg_q50', 'jpeg', 50.0::DOUBLE), ('blur_s10', 'blur', 1.0::DOUBLE), ('crop_p80', 'crop', 0.8::DOUBLE)) x(transform_key, op, value))
SELECT p_partkey, transform_key, op, value, ('0x' || substr(sha1(p_partkey || '|' || transform_key || '|v2'), 1, 14))::BIGINT AS seed,
       sha1(p_partkey || '|' || transform_key || '|v2')[1:2] AS folder FROM part, s"""
)
def settings_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item under every setting, with its seed."""
    from ..functions.values import SEED_SALT, seed56

    settings = spark.createDataFrame(_SETTINGS, "transform_key string, op string, value double")
    rows = joins.times_settings(table(spark, sf_dir, "part").select("p_partkey"), settings)
    item = F.col("p_partkey").cast("string")
    folder = F.left(F.sha1(F.concat_ws("|", item, "transform_key", F.lit(SEED_SALT))), F.lit(2))
    return rows.select("p_partkey", "transform_key", "op", "value", seed56(item, F.col("transform_key")).alias("seed"), folder.alias("folder"))


@query(
    """WITH s AS (SELECT * FROM (VALUES ('jpeg_q50'), ('blur_s10'), ('crop_p80')) x(transform_key)), i AS (SELECT p_partkey, transform_key, sha1('part/' || p_partkey || ':' || p_size) AS item FROM part, s)
SELECT p_partkey, transform_key, '/out/' || transform_key || '/' || item[1:2] || '/' || item || '.jpg' AS path FROM i"""
)
def hashed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each item under each setting is written."""
    settings = spark.createDataFrame([(s[0],) for s in _SETTINGS], "transform_key string")
    rows = joins.times_settings(table(spark, sf_dir, "part").select("p_partkey", "p_size"), settings)
    item = item_id(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")), F.col("p_size"))
    return rows.select("p_partkey", "transform_key", hashed_path("/out", F.col("transform_key"), item, "jpg").alias("path"))


@query(
    "SELECT p_partkey, p_size, view FROM part, (SELECT unnest(['clean','jpeg','blur','resize','noise','jitter','crop']) AS view)"
)
def view_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row under seven views."""
    views = ("clean", "jpeg", "blur", "resize", "noise", "jitter", "crop")
    return joins.times_views(table(spark, sf_dir, "part").select("p_partkey", "p_size"), views)


@query("SELECT view, count(*) AS n, sum(p_size)::BIGINT AS total FROM part, (SELECT unnest(['clean','jpeg','blur','resize','noise','jitter','crop']) AS view) GROUP BY view")
def views_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven views of each row."""
    rows = joins.times_views(table(spark, sf_dir, "part").select("p_size"), ("clean", "jpeg", "blur", "resize", "noise", "jitter", "crop"))
    return rows.groupBy("view").agg(F.count("*").alias("n"), F.sum("p_size").cast("long").alias("total"))


_SKEWED = """WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN xor(1311768467294899695, c_custkey * 2654435761) ELSE ('0x' || substr(md5(c_custkey::VARCHAR), 1, 15))::BIGINT END AS hash FROM customer),
b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN xor(1311768467294899695, p_partkey * 2654435761) ELSE ('0x' || substr(md5(p_partkey::VARCHAR), 1, 15))::BIGINT END AS hash FROM part)"""


@query(f"{_SKEWED} SELECT a.id AS id_a, b.id AS id_b, bit_count(xor(a.hash, b.hash))::INT AS distance FROM a JOIN b ON bit_count(xor(a.hash, b.hash)) <= 4")
def hamming_join_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 where a fifth of all hashes agree in their upper bits: hot bands are cut again."""
    def made(df: DataFrame, key: str) -> DataFrame:
        near = F.lit(1311768467294899695).bitwiseXOR(F.col(key).cast("long") * F.lit(2654435761))
        far = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 15), 16, 10).cast("long")
        return df.select(F.col(key).cast("long").alias("id"), F.when(F.col(key) % 5 == 0, near).otherwise(far).alias("hash"))

    return joins.near_hashes(made(table(spark, sf_dir, "customer"), "c_custkey"), made(table(spark, sf_dir, "part"), "p_partkey"), 4, hot=500)


@query(
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority NOT LIKE '%URGENT%' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"""
)
def overlap_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti-join and substring filter."""
    held = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("name"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return joins.without_overlap(rows, held, F.col("o_custkey"), "name", F.col("o_orderpriority"), ["URGENT"]).select("o_orderkey", "o_custkey")


@query(
    f"""WITH {PRED} SELECT doc_id, regexp_extract(image_path, '(fake|real)/.*$') AS first_key,
  CASE WHEN image_path LIKE '%/real/%' THEN regexp_extract(image_path, 'real/.*$') ELSE regexp_extract(image_path, 'fake/.*$') END AS priority_key,
  regexp_replace(image_path, '\\.[^./]+$', '') AS stem FROM pred"""
)
def path_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that do not depend on the root."""
    path = F.col("image_path")
    return predictions(spark, sf_dir).select(
        "doc_id", key_from_first_marker(path, ("fake", "real", "FAKE", "REAL")).alias("first_key"),
        key_by_marker_priority(path, ("real", "fake", "REAL", "FAKE")).alias("priority_key"), without_suffix(path).alias("stem"),
    )


@query(
    """WITH f AS (SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS feature_version FROM documents)
SELECT d.doc_id, f.lang, f.doc_id IS NOT NULL AS cached FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id AND feature_version = 1"""
)
def feature_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features from a versioned cache; the rest is still to be computed."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    cache = d.withColumn("feature_version", F.when(F.col("lang") == "en", 1).otherwise(0))
    hit, miss = joins.attached(d.select("doc_id"), cache, "doc_id", 1)
    return hit.withColumn("cached", F.lit(True)).unionByName(miss.withColumn("lang", F.lit(None).cast("string")).withColumn("cached", F.lit(False)))
