"""Heads by mini-batches against a plain loop; the store and what it refuses; features of files and their cache."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.operators import training
from verdigris.sources import readers, stores


def rows_of(n=300, width=6, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 2] > 0).astype(int)
    return [(k, [float(v) for v in x[k]], int(y[k])) for k in range(n)]


def test_erf():
    x = np.linspace(-4, 4, 101)
    assert np.abs(training.erf(x) - [math.erf(v) for v in x]).max() < 2e-7


@pytest.mark.parametrize("kind", ["linear", "mlp"])
def test_gradients_are_derivatives(kind):
    head = training.Head(4, kind, hidden=3, dropout=0.25)
    rng = np.random.default_rng(1)
    x, y, row, w = rng.normal(size=(9, 4)), rng.integers(0, 2, 9), rng.integers(0, 1 << 60, 9), head.start(2)
    got = head.gradient(w, x, y, row, 5)[0]
    for k in range(len(w)):
        up, down = (head.gradient(w + d * np.eye(len(w))[k], x, y, row, 5)[1] for d in (1e-5, -1e-5))
        assert got[k] == pytest.approx((up - down) / 2e-5, abs=2e-4)


@pytest.mark.parametrize("kind", ["linear", "mlp"])
def test_training_equals_a_plain_loop(spark, kind):
    rows = rows_of()
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    train, held = df.where("id < 240").repartition(3), df.where("id >= 240")
    head = training.Head(6, kind, hidden=8)
    seen = []
    state = training.train_head(train, held, "v", "y", "id", head, epochs=3, batch=60, rate=0.05, seed=4, told=lambda *x: seen.append(x))
    # The same, in numpy, over batches by the same hash of the id.
    of = {r["id"]: (r["row"], r["row"] % 4) for r in train.select("id", F.xxhash64(F.lit(4), "id").alias("row")).collect()}
    w = head.start(4)
    m, v, t, best = np.zeros(len(w)), np.zeros(len(w)), 0, (-1.0, None)
    for epoch in range(3):
        for b in np.random.default_rng([4, epoch]).permutation(4):
            own = [(x, y, of[i][0]) for i, x, y in rows if i < 240 and of[i][1] == b]
            g = head.gradient(w, np.array([x for x, *_ in own]), np.array([y for _, y, _ in own]), np.array([r for *_, r in own]), 4 + 1000 * epoch)[0] / len(own)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        z = head.logits(w, np.array([x for i, x, _ in rows if i >= 240]))
        accuracy = float(((z >= 0) == np.array([y for i, _, y in rows if i >= 240])).mean())
        assert seen[epoch][2] == pytest.approx(accuracy)
        if accuracy > best[0]:
            best = accuracy, w.copy()
    assert np.allclose(state.weights, w, atol=1e-9) and np.allclose(state.best, best[1], atol=1e-9) and state.best_accuracy == best[0] and state.steps == 12
    got = {r["id"]: r["pred"] for r in training.with_predictions(held, head, state.best, "v").collect()}
    z = head.logits(best[1], np.array([x for i, x, _ in rows if i >= 240]))
    assert [got[i] for i in range(240, 300)] == pytest.approx(list(1 / (1 + np.exp(-z))))


def test_training_goes_on_from_its_state(spark, tmp_path):
    df = spark.createDataFrame(rows_of(120), "id long, v array<double>, y int")
    train, held, head = df.where("id < 90"), df.where("id >= 90"), training.Head(6)
    store = stores.Store(str(tmp_path / "store"))
    options = {"batch": 45, "rate": 0.1, "seed": 2}
    training.train_head(train, held, "v", "y", "id", head, epochs=1, store=store, fields={"split": "train"}, **options)
    ran = []
    both = training.train_head(train, held, "v", "y", "id", head, epochs=3, store=store, fields={"split": "train"}, told=lambda *x: ran.append(x[0]), **options)
    assert ran == [2, 3] and both.epochs == 3
    whole = training.train_head(train, held, "v", "y", "id", head, epochs=3, **options)
    assert np.allclose(both.weights, whole.weights, atol=1e-12) and np.allclose(both.first, whole.first) and both.steps == whole.steps
    # Another split, or other rows, have a state of their own.
    training.train_head(train, held, "v", "y", "id", head, epochs=1, store=store, fields={"split": "test"}, told=lambda *x: ran.append(x[0]), **options)
    training.train_head(train.where("id > 0"), held, "v", "y", "id", head, epochs=1, store=store, fields={"split": "train"}, told=lambda *x: ran.append(x[0]), **options)
    assert ran == [2, 3, 1, 1]


def test_store(spark, tmp_path):
    store, made = stores.Store(str(tmp_path / "s")), []
    df = spark.createDataFrame([(k, [float(k)] * 3) for k in range(20)], "id long, x array<float>")

    def make():
        made.append(1)
        return df

    fields = {"source": "a", "split": "test", "n": 20, "content": stores.content_digest(df)}
    assert stores.content_digest(df) == stores.content_digest(df.repartition(7)) != stores.content_digest(df.where("id > 0"))
    for _ in range(2):
        assert sorted(map(tuple, store.table(spark, fields, make).collect())) == sorted(map(tuple, df.collect()))
    # The same options with another source do not meet.
    store.table(spark, fields | {"source": "b"}, make)
    assert len(made) == 2
    state = {"weights": np.arange(5.0), "steps": 7}
    key = store.save(fields, state)
    back = store.load(fields)
    assert (back["weights"] == state["weights"]).all() and back["steps"].item() == 7 and store.load(fields | {"split": "val"}) is None
    with pytest.raises(ValueError, match="other fields"):
        store.load(fields | {"split": "val"}, key)


def test_features_are_predicted_on_misses_only(spark, tmp_path):
    root, cache = tmp_path / "files", str(tmp_path / "cache")
    root.mkdir()
    for k in range(12):
        (root / f"{k:02d}.bin").write_bytes(bytes([k, k + 1, 3 * k]))
    seen = spark.sparkContext.accumulator(0)

    def model():
        def predict(contents):
            seen.add(len(contents))
            return np.array([[float(x) for x in c[:3]] for c in contents], np.float32)

        return predict

    files = lambda: readers.files(spark, str(root), content=True)
    got = training.extracted(files(), model, cache, model="m1", batch=5)
    assert {r["path"].rpartition("/")[2]: list(r["features"]) for r in got.collect()} == {f"{k:02d}.bin": [k, k + 1, 3 * k] for k in range(12)}
    assert seen.value == 12
    (root / "12.bin").write_bytes(bytes([9, 9, 9]))
    assert training.extracted(files(), model, cache, model="m1").count() == 13 and seen.value == 13
    assert training.extracted(files(), model, cache, model="m1").count() == 13 and seen.value == 13
    assert training.extracted(files(), model, cache, model="m2").count() == 13 and seen.value == 26
