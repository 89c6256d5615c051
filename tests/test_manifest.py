"""Manifests of many items: in order, with parameters from seeds, by tasks that are dealt by rows."""

import hashlib

from pyspark.sql import functions as F

from verdigris import plans
from verdigris.functions import pixels
from verdigris.functions.values import SEED_SALT
from verdigris.operators import materialize
from verdigris.schema import SOURCE

SETTINGS = [s for s in pixels.SETTINGS if s[0] in ("crop_p80", "jitter_p20", "blur_s10", "jpeg_q50")]


def seed(item: str, key: str) -> int:
    return int(hashlib.sha1(f"{item}|{key}|{SEED_SALT}".encode()).hexdigest()[:14], 16)


def test_rows_are_in_order_and_jitter_is_drawn(spark):
    items = spark.range(0, 50, 1, 3).select(F.col("id").cast("string").alias("image_id"), F.concat(F.lit("p/"), F.col("id") * 7 % 50).alias("path"), F.lit(11).alias("width"), F.lit(9).alias("height"))
    items = items.select(*[(F.col(f.name) if f.name in items.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SOURCE.fields], (-F.col("image_id").cast("int")).alias("place"))
    for order, by in (("path", lambda k: f"p/{k * 7 % 50}"), ("place", lambda k: -k)):
        got = materialize.manifest_rows(items, SETTINGS, "/out", order).collect()
        assert [r["row_id"] for r in got] == [f"{k}_{s[0]}" for s in SETTINGS for k in sorted(range(50), key=by)]
        for r in got:
            key, op, name, value = next(s for s in SETTINGS if s[0] == r["transform_key"])
            assert r["seed"] == seed(r["source_image_id"], key) and r["transform"] == op and r["source_path"].startswith("p/")
            assert r["params"] == (pixels.jitter_factors(r["seed"], value) if op == "jitter" else {name: value})
            assert (r["width"], r["height"]) == ((9, 7) if op == "crop" else (11, 9))
            assert r["path"] == f"/out/{key}/{r['source_image_id'][:2]}/{r['source_image_id']}.{'jpg' if op == 'jpeg' else 'png'}"
    assert materialize.manifest_rows(items, [s for s in SETTINGS if s[1] == "jitter"], "/out", "path").count() == 50


def test_transform_manifest_is_dealt_by_rows_and_reads_them_once(spark, tmp_path):
    spark.range(0, 12_000, 1, 1).selectExpr("id AS p_partkey", "'Brand#1' AS p_brand", "'T' AS p_type", "CAST(id % 50 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    rows = plans.QUERIES["transform_manifest"](spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(3)" in plan and "Union" not in plan and plan.count("FileScan") == 1
    # Seeds and paths are made in the ordered rows, and do not move with them.
    moved = plan.split("Exchange rangepartitioning")[1]
    assert SEED_SALT not in moved and "/out/" not in moved
    assert rows.count() == 12_000 * 13
