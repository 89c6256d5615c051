import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris import schema as S
from verdigris.functions import paths, values
from verdigris.operators import curation, joins, sampling, validate
from verdigris.sources import readers, sinks

ROW = {
    "image_id": "a", "path": "p.jpg", "label": 0, "source_dataset": "d", "generator": None, "split": "train", "width": 4, "height": 4,
    "family": None, "arch": None, "generation_type": None, "content_type": None, "original_format": ".JPEG", "phash": None, "source_id": None,
}


def rows_of(spark, *changes):
    return spark.createDataFrame([T.Row(**(ROW | c)) for c in changes], S.SOURCE)


@pytest.mark.parametrize(
    ("change", "text"),
    [
        ({"label": 2}, "label"), ({"split": "x"}, "split"), ({"path": ""}, "path"), ({"height": 0}, "height"), ({"generator": "sd"}, "generator"),
        ({"family": "gan"}, "family"), ({"phash": "12"}, "phash"), ({"label": 1, "content_type": "real"}, "content_type"),
        ({"label": 1, "family": "gan", "arch": "dit"}, "gan"),
    ],
)
def test_violations(spark, change, text):
    good, bad = validate.quarantined(rows_of(spark, {}, change))
    assert good.count() == 1
    assert any(text in v for v in bad.first()["violations"])
    with pytest.raises(Exception, match=text):
        validate.insisted(rows_of(spark, change)).collect()


def test_normal_form(spark):
    r = validate.normalized(rows_of(spark, {"generator": "real"})).first()
    assert (r["generator"], r["original_format"], r["content_type"]) == (None, "jpg", "real")


def test_trainable_keeps_null_content(spark):
    df = rows_of(spark, {}, {"label": 1, "content_type": "partial_manipulation"}, {"split": "val"})
    assert validate.trainable(df).count() == 1


def test_strict_lines(spark, tmp_path):
    good = {k: v for k, v in ROW.items() if v is not None}
    lines = [good, good | {"label": True}, good | {"label": 1.0}, good | {"odd": 1}, {k: v for k, v in good.items() if k != "split"}, [1]]
    path = tmp_path / "m.jsonl"
    path.write_text("\n\n".join(json.dumps(x) for x in lines))
    parsed = validate.parse_strict(readers.manifest_lines(spark, str(path)), S.SOURCE, S.SOURCE_REQUIRED)
    errors = [r["errors"] for r in parsed.orderBy("line").collect()]
    assert errors[0] == [] and all(errors[1:])
    with pytest.raises(Exception, match=r"m.jsonl:3"):
        path.write_text("\n\n".join(json.dumps(x) for x in lines[:2]))
        readers.strict_manifest(spark, str(path), S.SOURCE, S.SOURCE_REQUIRED).collect()


def test_keys(spark):
    df = spark.createDataFrame([("/x/fake/a/b.jpg",), ("y/real/b.png",), ("plain.jpg",)], "p string")
    got = df.select(paths.key_from_first_marker(F.col("p"), ("fake", "real")), paths.without_suffix(F.col("p")), paths.suffix(F.col("p"))).collect()
    assert [r[0] for r in got] == ["fake/a/b.jpg", "real/b.png", "plain.jpg"]
    assert [r[1] for r in got] == ["/x/fake/a/b", "y/real/b", "plain"]
    assert [r[2] for r in got] == [".jpg", ".png", ".jpg"]


def test_roles(spark):
    source, role = paths.split_role(F.col("s"), ["nano", "nano_banana"])
    df = spark.createDataFrame([("7_nano_banana",), ("7_nano",), ("7",)], "s string").select(source, role)
    assert [tuple(r) for r in df.collect()] == [("7", "nano_banana"), ("7", "nano"), ("7", None)]


def test_leaks_and_hamming(spark):
    a = spark.createDataFrame([(1, 15), (2, -1), (3, None)], "id long, hash long")
    b = spark.createDataFrame([(7, 14), (8, -4), (9, 0)], "id long, hash long")
    found = {(r["id_a"], r["id_b"], r["distance"]) for r in joins.near_hashes(a, b, 2).collect()}
    assert found == {(1, 7, 1), (2, 8, 2)}


def test_label_index_last_row_counts(spark):
    labels = spark.createDataFrame([("a.jpg", 0, 0), ("a.png", 1, 1)], "rel string, y int, at int")
    found = {r["key"]: (r["y"], r["n_labels"]) for r in joins.label_index(labels, "rel", "y", "at").collect()}
    assert found == {"a.jpg": (0, 1), "a.png": (1, 1), "a": (1, 2)}


def test_metadata_defaults(spark):
    scored = spark.createDataFrame([("a", 0.9, 0), ("b", 0.9, 1), ("c", 0.1, 1)], "k string, pred double, label int")
    meta = spark.createDataFrame([("a", "", "x", 0), ("b", "sd", "y", 0), ("b", "late", "z", 1)], "k string, generator string, condition string, o int")
    got = {r["k"]: r for r in joins.with_metadata(scored, meta, "k", "o", {"generator": "unknown", "condition": "clean"}).collect()}
    assert (got["a"]["generator"], got["b"]["generator"], got["c"]["generator"], got["c"]["condition"]) == ("real", "sd", "unknown", "clean")
    assert [got[k]["error_type"] for k in "abc"] == ["FP", "TP", "FN"]


def test_rules(spark):
    files = spark.createDataFrame([("DDPM/1.png", 512, 512), ("ffhq/1.png", 600, 400), ("real/coco/1.png", 900, 900), ("odd/1.png", 9, 9)], "rel string, width int, height int")
    rules = [{"pattern": "^ddpm/", "generator": "ddpm", "family": "diffusion", "arch": "pixel", "label": 1}, {"pattern": "ffhq", "label": 0}]
    assert curation.scanned(files, rules, ["^real/coco"], min_side=512).count() == 1
    assert curation.scanned(files, rules, ["^real/coco"]).count() == 2
    assert {r["group"]: r["n"] for r in curation.scan_report(files, rules, ["^real/coco"]).collect()} == {"ddpm": 1, "real": 1, "unmatched": 1}


def test_samples(spark):
    df = spark.range(100).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"), (F.col("id") % 3).cast("string").alias("g"))
    got = sampling.balanced(df, 40, 1, "id")
    assert sorted(r["n"] for r in got.groupBy("y").agg(F.count("*").alias("n")).collect()) == [20, 20]
    assert {r["id"] for r in got.collect()} == {r["id"] for r in sampling.balanced(df.repartition(7), 40, 1, "id").collect()}
    assert sampling.capped_positives(df, "g", 2, 1, "id").where("y = 1").count() == 6
    with pytest.raises(ValueError, match="unknown generators"):
        sampling.among_generators(df, ["9"], "g")
    with pytest.raises(ValueError, match="needed"):
        sampling.pools(df.withColumn("label", F.col("y")), {"p": {"label": 1, "n": 99}}, 1, "id")
    extra = df.where("y = 1").limit(5).withColumn("id", F.col("id") + 1000)
    assert sampling.replaced(df, extra, 1, "id").count() == 100


def test_galleries(spark, tmp_path):
    worst = spark.createDataFrame([("FP", "real/a.jpg", 0.9, 0, 1), ("FN", "fake/b.jpg", 0.2, 1, 1)], "error_type string, image_path string, pred double, label int, place int")
    page = tmp_path / "m.html"
    page.write_text(sinks.gallery_html(worst, "m", 0.5, 10), encoding="utf-8")
    meta, cards = readers.galleries(spark, str(page))
    assert meta.first()["joined"] == 10
    assert {(r["error_type"], r["path"]) for r in cards.collect()} == {("FP", "real/a.jpg"), ("FN", "fake/b.jpg")}
    assert readers.html_cards(spark, str(page)).count() == 2
    page.write_text(page.read_text(encoding="utf-8").replace("FP=1", "FP=2"), encoding="utf-8")
    with pytest.raises(Exception, match="differ"):
        readers.galleries(spark, str(page))[0].collect()


def test_tree_and_predictions(spark, tmp_path):
    for rel in ("real/a.jpg", "fake/b.PNG", "fake/c.txt", "other/d.jpg"):
        (tmp_path / rel).parent.mkdir(exist_ok=True)
        (tmp_path / rel).write_bytes(b"x")
    got = {r["rel"]: r["y"] for r in readers.labelled_tree(spark, str(tmp_path)).collect()}
    assert got == {"real/a.jpg": 0, "fake/b.PNG": 1}
    index = readers.source_index(spark, str(tmp_path), "d", "train", ["real"], ["fake"])
    assert {(r["label"], r["original_format"]) for r in index.collect()} == {(0, "jpg"), (1, "png")}
    with pytest.raises(ValueError, match="at once"):
        readers.source_index(spark, str(tmp_path), "d", "train", ["x"], ["X"])
    preds = tmp_path / "p.json"
    preds.write_text('[{"image_path": "a", "pred": 0.5}]')
    assert readers.predictions(spark, str(preds)).first()["pred"] == 0.5
    preds.write_text('{"image_path": "a"}')
    with pytest.raises(ValueError, match="array"):
        readers.predictions(spark, str(preds))


def test_shards(spark, tmp_path):
    rows = [(T.Row(bytes=b"1", path="x"), label) for label in (0, 2, 1, 0)]
    spark.createDataFrame(rows, "image struct<bytes:binary,path:string>, label bigint").coalesce(1).write.parquet(str(tmp_path / "s"))
    got = readers.shards(spark, str(tmp_path / "s"), cap=2)
    assert sorted(r["label"] for r in got.collect()) == [0, 1]
    assert got.select("image_id").distinct().count() == 2


def test_capped_shards_are_not_ordered(spark, tmp_path):
    """Every cap gives the first rows in the order of shards, from the shards it needs only, by a plan without a sort."""
    rows = [(f"img{k}", (0, 1, 2, 7)[k % 4]) for k in range(40)]
    spark.createDataFrame(rows, "image string, label bigint").repartition(4).write.parquet(str(tmp_path / "s"))
    every = [(r["shard"], r["row"], r["image"]) for r in readers.shards(spark, str(tmp_path / "s"), labels={0: 0, 1: 1, 2: 1}).orderBy("shard", "row").collect()]
    assert len(every) == 30
    for cap in (0, 1, 7, len([x for x in every if x[0] == every[0][0]]), 23, 30, 99):
        got = readers.shards(spark, str(tmp_path / "s"), cap=cap, labels={0: 0, 1: 1, 2: 1})
        assert sorted((r["shard"], r["row"], r["image"]) for r in got.collect()) == every[:cap]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "Exchange" not in plan and "Limit" not in plan


def test_pools_of_shards_and_without_overlap(spark, tmp_path):
    spark.createDataFrame([(f"i{k}", k % 2) for k in range(6)], "image string, label bigint").coalesce(1).write.parquet(str(tmp_path / "p"))
    got = readers.negatives(spark, "SID", {"sid_val": str(tmp_path / "p")})
    assert got.count() == 3 and got.select("y").distinct().collect()[0]["y"] == 0 and "/0" in got.orderBy("path").first()["path"]
    (tmp_path / "t" / "val2017").mkdir(parents=True)
    for name in ("a.jpg", "b.jpg", "val2017/c.jpg"):
        (tmp_path / "t" / name).write_bytes(b"x")
    held = spark.createDataFrame([("/other/b.jpg",)], "path string")
    left = readers.negatives(spark, "wf", {"wildfake": str(tmp_path / "t")}, held=held, forbidden=["val2017"])
    assert [r["path"].rpartition("/")[2] for r in left.collect()] == ["a.jpg"]
    with pytest.raises(ValueError, match="no negatives"):
        readers.negatives(spark, "wf", {"wildfake": str(tmp_path / "t")}, forbidden=["jpg"])


def test_three_class_tree(spark, tmp_path):
    for name in ("real/a.jpg", "real/deep/b.png", "tampered/c.jpg", "other/d.jpg", "e.jpg", "real/no.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    rows = readers.three_class_tree(spark, str(tmp_path), content=True)
    got = {r["rel"]: (r["label"], r["generator"], r["generation_type"], r["content_type"], bytes(r["content"]).decode()) for r in rows.collect()}
    assert got == {
        "real/a.jpg": (0, None, None, "real", "real/a.jpg"), "real/deep/b.png": (0, None, None, "real", "real/deep/b.png"),
        "tampered/c.jpg": (1, "flux", "i2i", "partial_manipulation", "tampered/c.jpg"),
    }
    # Files of other classes are not opened: that they are gone does not matter.
    one = rows.where("subdir = 'tampered'")
    for name in ("real/a.jpg", "real/deep/b.png", "real/no.txt"):
        (tmp_path / name).unlink()
    assert [r["rel"] for r in one.collect()] == ["tampered/c.jpg"]


def test_recipes_and_holdouts():
    with pytest.raises(ValueError, match="hold-outs"):
        readers.check_recipe({"train": {"datasets": ["v"], "forbid": ["v"]}}, ["v"])
    with pytest.raises(ValueError, match="forbid"):
        readers.check_recipe({"train": {"datasets": ["t"], "forbid": []}}, ["v"])
    readers.check_recipe({"train": {"datasets": ["t"], "forbid": ["v"]}}, ["v"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("clean", 4, 0.5, None)], "condition string, n long, acc double, auroc double")
    assert sinks.markdown(df, ["condition", "n", "acc", "auroc"], "-").splitlines()[2] == "| clean | 4 | 0.5000 | - |"
    sinks.json_lines(df, str(tmp_path / "j"))
    assert '"auroc":null' in "".join(f.read_text() for f in (tmp_path / "j").glob("part-*.json"))
    sinks.metric_csv(df, str(tmp_path / "c"))
    assert ",,clean,4,,,0.5000,,,,,," in "".join(f.read_text() for f in (tmp_path / "c").glob("part-*.csv"))


def test_prepared(spark):
    df = spark.createDataFrame([(1, None, 0.5), (None, 0, 0.2)], "y int, label int, pred double")
    assert [(r["label"], r["generator"]) for r in curation.prepared(df).collect()] == [(1, "unknown"), (0, "real")]
    with pytest.raises(Exception, match="outside"):
        curation.prepared(spark.createDataFrame([(1, 1.5)], "y int, pred double")).collect()


def test_seed_and_hash(spark):
    import hashlib

    r = spark.range(1).select(values.seed56(F.lit("img"), F.lit("jpeg_q70")), values.hash_long(F.lit("ffffffffffffffff"))).first()
    assert r[0] == int.from_bytes(hashlib.sha1(b"img|jpeg_q70|v2").digest()[:7], "big") and r[1] == -1


@pytest.mark.parametrize(("digits", "leaf"), [(4, 2_000_000), (1, 10)])
def test_large_picks_equal_ranking(spark, digits, leaf):
    """The n-th draw of each group by counts of its leading digits, refined or not; null groups, small groups and repeated ids too."""
    rows = [(k % 450, ("a", "a", None)[k % 3], k) for k in range(900)] + [(1000 + k, "small", k) for k in range(5)]
    df = spark.createDataFrame(rows, "id long, g string, x long").repartition(5)
    for n in (1, 37, 250, 5000):
        got = sampling.smallest(df, ["g"], n, 3, "id", digits, leaf)
        wanted = sampling.first_per(df, ["g"], n, sampling.draw(3, "id"), F.col("id"))
        key = lambda d: sorted((str(r["g"]), r["id"]) for r in d.collect())
        assert key(got) == key(wanted)
    whole = sampling.smallest(df, [], 600, 3, "id", digits, leaf)
    assert whole.count() == 600 and sampling.smallest(df, [], 0, 3, "id").count() == 0
    assert whole.columns == df.columns


def test_large_picks_order_no_group(spark):
    """The plan of a large pick has a filter with a broadcast, and neither a window nor a sort of its rows."""
    df = spark.range(20_000).select("id", (F.col("id") % 2).alias("y"))
    plan = sampling.balanced(df, 9_000, 1, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Exchange hash" not in plan
    assert sampling.balanced(df, 9_000, 1, "id").groupBy("y").count().select("count").distinct().first()[0] == 4_500
    assert sampling.balanced(df, 1, 1, "id").count() == 2


@pytest.mark.parametrize(("distance", "hot"), [(3, 10**9), (3, 40), (6, 5)])
def test_near_hashes_on_skewed_bands(spark, distance, hot):
    """Hashes that agree in most bits, equal ones and negative ones: each pair once, however often bands are cut."""
    import random

    rng = random.Random(distance)
    base = rng.getrandbits(64)
    made = lambda n: [base ^ rng.getrandbits(64) & (0xFFFF if k % 5 else (1 << 64) - 1) for k in range(n)] + [base, base]
    a, b = made(150), made(120)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = lambda h: spark.createDataFrame([(k, signed(x)) for k, x in enumerate(h)] + [(0, signed(h[0])), (999, None)], "id long, hash long")
    got = [tuple(r) for r in joins.near_hashes(frame(a), frame(b), distance, hot=hot).collect()]
    wanted = {(i, j, (x ^ y).bit_count()) for i, x in enumerate(a) for j, y in enumerate(b) if (x ^ y).bit_count() <= distance}
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 100


def test_hot_bands_are_cut_again(spark):
    """A fifth of the hashes share their upper bits: candidates grow with the rows, not with their square."""
    import random

    rng = random.Random(1)
    made = {}
    whole = joins.hamming

    for n in (1000, 4000):
        rows = [(k, (0x123456 << 40 | rng.getrandbits(40)) if k % 5 == 0 else rng.getrandbits(62)) for k in range(n)]
        df = spark.createDataFrame(rows, "id long, hash long")
        seen = spark.sparkContext.accumulator(0)

        def counted(a, b, seen=seen):
            @F.udf("int")
            def f(x, y):
                seen.add(1)
                return (x ^ y & (1 << 64) - 1).bit_count()

            return f(a, b)

        joins.hamming = counted
        try:
            joins.near_hashes(df, df, 4, hot=2_000).count()
        finally:
            joins.hamming = whole
        made[n] = seen.value
    assert made[4000] < 14 * made[1000] and made[4000] < 800 * 800 / 10, made
