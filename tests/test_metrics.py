import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.operators import groups, metrics


def frame(spark, ys, scores, **more):
    rows = [(y, float(s), *[v[k] for v in more.values()]) for k, (y, s) in enumerate(zip(ys, scores, strict=True))]
    return spark.createDataFrame(rows, "label int, pred double" + "".join(f", {k} string" for k in more))


@pytest.mark.parametrize(
    ("ys", "scores", "wanted"),
    [
        ([1, 0, 1, 0, 1], [0.7, 0.6, 0.55, 0.3, 0.2], 0.5),  # 3 of 6 pairs
        ([0, 0, 0, 1], [0.05, 0.4, 0.35, 0.4], 2.5 / 3),
        ([1, 1, 0], [0.3, 0.3, 0.3], 0.5),
        ([1, 0], [0.25, 0.75], 0.0),
        ([0, 0, 0], [0.6, 0.1, 0.5], None),
    ],
)
def test_auroc(spark, ys, scores, wanted):
    got = metrics.auroc(frame(spark, ys, scores)).first()["auroc"]
    assert got is None if wanted is None else math.isclose(got, wanted, abs_tol=1e-12)


def test_auroc_with_many_ties_and_groups(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), rng.randint(0, 20) / 20, rng.choice("ab")) for _ in range(400)]
    df = spark.createDataFrame(rows, "label int, pred double, g string")
    found = {r["g"]: r["auroc"] for r in metrics.auroc(df, ["g"]).collect()}
    for g in "ab":
        pos = [s for y, s, h in rows if h == g and y == 1]
        neg = [s for y, s, h in rows if h == g and y == 0]
        wanted = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert math.isclose(found[g], wanted)


def test_confusion(spark):
    r = metrics.binary_metrics(frame(spark, [1, 1, 1, 0, 0, 0], [0.95, 0.5, 0.2, 0.7, 0.49, 0.1])).first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"]) == (2, 1, 1, 2)
    assert math.isclose(r["fpr"], 1 / 3) and math.isclose(r["precision_fake"], 2 / 3) and math.isclose(r["recall_fake"], 2 / 3)


def test_single_class(spark):
    r = metrics.binary_metrics(frame(spark, [0, 0, 0], [0.6, 0.1, 0.5])).first()
    assert (r["n_fake"], r["recall_fake"], r["auroc"]) == (0, 0.0, None) and math.isclose(r["fpr"], 2 / 3)


def test_nan_is_an_error(spark):
    with pytest.raises(Exception, match="null or NaN"):
        metrics.binary_metrics(frame(spark, [0, 1], [float("nan"), 0.5])).collect()


def test_composite(spark):
    conditions = [f"c{k}" for k in range(14)]
    rows = [("m", "clean", 0.9), *[("m", c, 0.8) for c in conditions], ("p", "clean", 0.9), ("p", "c3", 0.7), ("q", "clean", 0.9), ("r", "c1", 0.5)]
    df = spark.createDataFrame(rows, "model string, condition string, auroc double")
    found = {r["model"]: r for r in metrics.composite(df, conditions, ["model"]).collect()}
    assert math.isclose(found["m"]["formula"], 0.85) and found["m"]["complete"]
    assert math.isclose(found["p"]["formula"], 0.8) and found["p"]["n_robust"] == 1 and not found["p"]["complete"]
    assert found["q"]["formula"] == 0.9 and not found["q"]["complete"]
    assert found["r"]["formula"] is None


def test_shared_negatives_equal_a_copy_of_them(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), rng.randint(0, 9) / 9, rng.choice("abc")) for _ in range(300)]
    df = spark.createDataFrame(rows, "label int, pred double, generator string")
    found = {r["generator"]: r for r in metrics.shared_negative_metrics(df, "generator").collect()}
    for g in "abc":
        own = [(y, s) for y, s, h in rows if y == 0 or h == g]
        wanted = metrics.binary_metrics(frame(spark, *zip(*own, strict=True))).first()
        for key in ("n", "tp", "fp", "tn", "fn", "auroc", "mean_pred"):
            assert math.isclose(found[g][key], wanted[key]), key


def test_sweep_equals_single_thresholds(spark):
    df = frame(spark, [0, 1, 0, 1, 1], [0.2, 0.3, 0.6, 0.6, 0.9])
    found = {r["threshold"]: r for r in metrics.sweep(df, [0.3, 0.6]).collect()}
    for t in (0.3, 0.6):
        wanted = metrics.binary_metrics(df, threshold=t).first()
        assert all(found[t][k] == wanted[k] for k in ("tp", "fp", "tn", "fn", "acc", "recall_fake", "mean_pred"))


def test_error_stats_and_worst(spark):
    rows = [("f1", 0.9, 0, "FP", "real"), ("f2", 0.8, 0, "FP", "real"), ("m1", 0.2, 1, "FN", "sd"), ("t1", 0.9, 1, "TP", "sd")]
    df = spark.createDataFrame(rows, "image_path string, pred double, label int, error_type string, generator string")
    stats = {(r["group_type"], r["group_value"]): r for r in groups.error_stats(df, ["generator"]).collect()}
    whole = stats["overall", "all"]
    assert (whole["n_images"], whole["n_fp"], whole["n_fn"], whole["fpr"], whole["fnr"]) == (4, 2, 1, 1.0, 0.5)
    own = stats["generator", "sd"]
    assert (own["n_images"], own["n_real"], own["n_fake"], own["n_fn"], own["fnr"]) == (2, 0, 2, 1, 0.5)
    top = {r["error_type"]: r["image_path"] for r in groups.worst(df, 1).collect()}
    assert top == {"FP": "f1", "FN": "m1"}


def test_overlap(spark):
    rows = [("left", "FP", "shared"), ("left", "FP", "left"), ("right", "FP", "shared"), ("left", "FN", "shared"), ("right", "FN", "shared"), ("right", "FN", "right")]
    found = {r["error_type"]: r for r in groups.error_overlap(spark.createDataFrame(rows, "model string, error_type string, key string")).collect()}
    assert (found["FP"]["intersection"], found["FP"]["union"], found["FP"]["jaccard"]) == (1, 2, 0.5)
    assert (found["FN"]["intersection"], found["FN"]["union"], found["FN"]["share_of_right"]) == (1, 2, 0.5)


def test_transitions(spark):
    base = spark.createDataFrame([("a", 1, 0.2), ("b", 1, 0.2), ("c", 0, 0.2), ("d", 1, 0.9), ("e", 0, 0.9)], "key string, label int, pred double")
    new = spark.createDataFrame([("a", 0.9), ("b", 0.3), ("c", 0.7), ("d", 0.1), ("e", 0.1), ("z", 0.5)], "key string, pred double")
    found = {r["bucket"]: r["n"] for r in groups.transitions(base, new).collect()}
    assert found == {"fn_fixed": 1, "fn_remain": 1, "fp_new": 1, "fn_new": 1, "fp_fixed": 1}


def test_pairs_and_triplets(spark):
    rows = [("s1", "real", 0.2), ("s1", "x", 0.7), ("s2", "real", 0.5), ("s2", "x", 0.5), ("s3", "x", 0.9), (None, "real", 0.1), (None, "x", 0.9)]
    df = spark.createDataFrame(rows, "source_id string, role string, pred double")
    r = groups.pair_ranking(df).first()
    assert (r["n"], r["hits"], r["pair_acc"]) == (2, 1, 0.5)
    assert {x["source_id"] for x in groups.complete_sources(df, ["real", "x"]).collect()} == {"s1", "s2"}


def test_percentiles(spark):
    df = spark.createDataFrame([(0.6,), (0.9,)], "pred double")
    assert math.isclose(metrics.percentiles(df, "pred").first()["q50"], 0.75)


def test_percentiles_equal_numpy(spark):
    """Crowded, equal and outlying scores, by group; a null is no score, and a group of nulls has none."""
    rng = np.random.default_rng(3)
    scores = {
        "crowded": 1 - 10.0 ** rng.uniform(-14, -3, 400), "equal": np.full(50, 0.25), "even": rng.random(301), "wide": rng.normal(0, 5, 120), "one": np.array([1.0]),
        "ends": np.array([0.0, 0.0, 1.0, 1.0, 1e-13]),
    }
    rows = [(g, float(x)) for g, xs in scores.items() for x in xs] + [("none", None), ("one", None)]
    at = (0, 0.1, 0.25, 0.5, 0.9, 1)
    got = {r["g"]: r for r in metrics.percentiles(spark.createDataFrame(rows, "g string, pred double"), "pred", ["g"], at).collect()}
    assert set(got) == {*scores, "none"} and got["none"]["q50"] is None
    for g, xs in scores.items():
        for q in at:
            assert math.isclose(got[g][f"q{round(100 * q)}"], np.quantile(xs, q), rel_tol=1e-12, abs_tol=1e-15), (g, q)


def test_slots_follow_the_scores(spark):
    """Slots never fall as the score rises, and part scores that crowd at an end."""
    xs = np.sort(np.concatenate([1 - 10.0 ** np.linspace(-15, 0, 200), 10.0 ** np.linspace(-300, 0, 200), [-3.0, 0.0, 1.0, 7.0], np.linspace(0, 1, 500)]))
    got = [r["s"] for r in spark.createDataFrame([(float(x),) for x in xs], "score double").coalesce(1).select(metrics._slot().alias("s")).collect()]
    assert got == sorted(got)
    assert len({s for s, x in zip(got, xs, strict=True) if 0.9999 < x < 1}) > 50


def test_error_summary_has_scores(spark):
    errors = spark.createDataFrame([("a", "FP", 0.5), ("a", "FP", 0.7), ("a", "FN", 0.1)], "model string, error_type string, pred double")
    totals = spark.createDataFrame([("a", 4, 4), ("b", 3, 3)], "model string, n_real long, n_fake long")
    got = {r["model"]: r for r in groups.error_summary(errors, totals).collect()}
    assert (got["a"]["fp"], got["a"]["fn"], got["b"]["fp"], got["b"]["fp_scores"]) == (2, 1, 0, None)
    assert np.allclose(got["a"]["fp_scores"], [0.5, 0.55, 0.6, 0.65, 0.7]) and got["a"]["accuracy"] == 0.625


def test_empty_table(spark):
    df = spark.createDataFrame([], "label int, pred double, g string")
    assert metrics.binary_metrics(df, ["g"]).count() == 0


def brute_auroc(rows):
    pos, neg = ([p for p, y in rows if y == k] for k in (1, 0))
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_scores_of_any_range_spread_evenly(spark):
    """Logits far outside 0..1, half of them one value, and a group of huge amounts: ranks as by definition, slots of about equal size."""
    rng = random.Random(9)
    rows = [("a", rng.gauss(0, 40) if k % 2 else 3.5, int(rng.random() < 0.4)) for k in range(1500)]
    rows += [("b", 1e12 + k * 0.001, int(k % 3 == 0)) for k in range(500)] + [("b", -1e300, 1), ("b", 1e300, 0)]
    df = spark.createDataFrame(rows, "g string, pred double, label int")
    cuts = metrics.score_cuts(df, slots=32)
    assert cuts == sorted(set(cuts)) and 10 < len(cuts) < 32
    slots = metrics.histogram(df, ["g"]).withColumn("slot", metrics._slot(cuts))
    assert slots.groupBy("slot").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] < 200
    rising = [r["slot"] for r in slots.orderBy("score").collect()]
    assert rising == sorted(rising)
    for own in (cuts, [], None):
        got = {r["g"]: r["auroc"] for r in metrics.auroc(df, ["g"], cuts=own).collect()}
        assert got == pytest.approx({g: brute_auroc([(p, y) for h, p, y in rows if h == g]) for g in "ab"})
    quarter = {r["g"]: r["q25"] for r in metrics.percentiles(df, "pred", ["g"], cuts=cuts).collect()}
    assert quarter == pytest.approx({g: float(np.percentile([p for h, p, _ in rows if h == g], 25)) for g in "ab"})
    assert metrics.score_cuts(df.limit(0)) == []


def test_sweep_by_group_equals_copied_negatives(spark):
    rng = random.Random(10)
    rows = [(f"g{k % 3}" if k % 2 else "none", round(rng.random(), 2), k % 2) for k in range(400)]
    df = spark.createDataFrame(rows, "generator string, pred double, label int")
    got = {(r["generator"], r["threshold"]): r for r in metrics.sweep_by_group(df, "generator").collect()}
    assert len(got) == 3 * 4
    for (g, t), r in got.items():
        own = [(p, y) for h, p, y in rows if y == 0 or h == g]
        assert (r["tp"], r["fp"], r["n"]) == (sum(p >= t and y == 1 for p, y in own), sum(p >= t and y == 0 for p, y in own), len(own))
        assert r["auroc_fixed"] == pytest.approx(brute_auroc(own)) and r["mean_pred"] == pytest.approx(sum(p for p, _ in own) / len(own))


def test_slices_read_their_rows_once(spark, tmp_path):
    rows = [(("src1", "", None, "Real")[k % 4], (k * 37 % 100) / 100, int(k % 3 == 0), ("x", "y", None)[k % 3 - 1], str(k % 2)) for k in range(240)]
    spark.createDataFrame(rows, "generator string, pred double, label int, semantic_scene string, resolution string").write.parquet(str(tmp_path / "r"))
    df = spark.read.parquet(str(tmp_path / "r"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted = df.mapInArrow(count, df.schema)
    found = groups.slices(counted, groups.slice_keys(df.columns), min_support=10, min_generator_support=5)
    got = {(r["feature"], r["value"]): r for r in found.collect()}
    assert seen.value == 240
    assert set(got) == {("semantic_scene", "x"), ("semantic_scene", "y"), ("resolution", "0"), ("resolution", "1")}
    for (feature, value), r in got.items():
        own = [(p, y) for _, p, y, scene, size in rows if (scene if feature == "semantic_scene" else size) == value]
        assert r["n"] == len(own) and r["n_fake"] == sum(y for _, y in own)
    with pytest.raises(ValueError, match="positive"):
        groups.slices(df, ["resolution"], min_support=0)


def test_no_match_at_all_is_an_error(spark):
    preds = spark.createDataFrame([("a", "a.jpg", 0.5)], "key string, image_path string, pred double")
    labels = spark.createDataFrame([("b", 1)], "key string, y int")
    with pytest.raises(Exception, match="no prediction has a label"):
        metrics.score_predictions(preds, labels)[0].collect()
