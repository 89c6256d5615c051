"""Images read from files, measured and transformed by Spark; heads chosen on held-out rows."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.functions import pixels
from verdigris.operators import joins, metrics, scoring
from verdigris.sources import readers, sinks


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    rng = np.random.default_rng(1)
    for kind in ("real", "fake"):
        (root / kind).mkdir()
        for k in range(3):
            (root / kind / f"{k}.ppm").write_bytes(pixels.ppm_bytes(rng.integers(0, 256, (20 + k, 30, 3)).astype(np.uint8)))
    return root


@pytest.fixture(autouse=True)
def ppm_is_an_image(monkeypatch):
    monkeypatch.setattr(readers, "is_image", lambda rel: F.lower(rel).rlike(r"\.(ppm|png|jpg)$"))


def test_source_index_has_sizes_and_hashes(spark, tree):
    rows = readers.source_index_with_sizes(spark, str(tree), pixels.ppm_image, dataset="d", split="eval", real=["real"], fake=["fake"]).collect()
    assert sorted((r["label"], r["height"], r["width"]) for r in rows) == [(y, 20 + k, 30) for y in (0, 1) for k in range(3)]
    by = {r["path"].rpartition("/")[2]: r for r in rows if r["label"] == 1}
    assert by["1.ppm"]["phash"] == pixels.perceptual_hash(pixels.ppm_image((tree / "fake" / "1.ppm").read_bytes()))


def test_measures_equal_numpy(spark, tree):
    files = readers.images(spark, str(tree), content=True)
    rows = scoring.measured(files, pixels.ppm_image).collect()
    assert len(rows) == 6
    for r in rows:
        with open(r["path"], "rb") as f:
            wanted = pixels.features(pixels.ppm_image(f.read()), "ppm")
        assert {k: r[k] for k in wanted} == wanted


def test_transforms_equal_numpy(spark):
    rng = np.random.default_rng(2)
    images = [rng.integers(0, 256, (9, 7, 3)).astype(np.uint8) for _ in range(6)]
    settings = [s for s in pixels.SETTINGS if s[1] != "jpeg"][:6]
    rows = spark.createDataFrame(
        [(str(k), bytearray(img.tobytes()), 9, 7, op, float(v), 11 * k) for k, (img, (_, op, _, v)) in enumerate(zip(images, settings, strict=True))],
        "row_id string, pixels binary, height int, width int, op string, value double, seed long",
    )
    for r in scoring.transformed(rows, pixels.apply).collect():
        k = int(r["row_id"])
        img, params = pixels.apply(images[k], settings[k][1], settings[k][3], 11 * k)
        assert bytes(r["pixels"]) == img.tobytes() and (r["height"], r["width"]) == img.shape[:2] and r["params"] == params


def test_splits_and_pools(spark, tree):
    roots = {"val": str(tree), "extra": str(tree / "fake")}
    assert readers.split(spark, roots, "val").groupBy("y").count().count() == 2
    with pytest.raises(ValueError, match="known: extra, val"):
        readers.split(spark, roots, "test")
    assert readers.negatives(spark, "pool", {"pool": str(tree / "real")}).count() == 3
    assert readers.negatives(spark, "dir", {}, str(tree)).count() == 3
    with pytest.raises(ValueError, match="unknown pool"):
        readers.negatives(spark, "nope", {})


@pytest.mark.parametrize("kind", ["linear", "mlp"])
def test_best_head_by_held_out_rows(spark, kind):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=6)]) for k in range(300)]
    df = spark.createDataFrame([(k, v, int(v[0] + 0.5 * v[1] > 0)) for k, v in rows], "id long, v array<double>, y int")
    predictor, quality = scoring.fit_head_by_eval(df.where("id < 200"), df.where("id >= 200"), "v", "y", kind=kind, hidden=8)
    assert quality > 0.95
    got = predictor(df.where("id >= 200")).select("pred", F.col("y").alias("label"))
    assert abs(metrics.auroc(got).first()["auroc"] - quality) < 1e-9


def test_nearest_prototypes_equal_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=5)], k % 3) for k in range(40)] + [(40, [0.0] * 5, 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    x = np.array([r[1] for r in rows])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    means = np.array([unit[[k for k, _, y in rows if y == c and norm[k] > 0]].mean(0) for c in range(3)])
    s = unit @ (means / np.linalg.norm(means, axis=1, keepdims=True)).T
    for r in scoring.nearest_prototypes(df, scoring.prototypes(df, "v", "label"), "v", "id").where("id < 40").collect():
        order = np.argsort(-s[r["id"]])
        assert r["best"] == order[0] and abs(r["score"] - s[r["id"]][order[0]]) < 1e-9
        assert abs(r["margin"] - (s[r["id"]][order[0]] - s[r["id"]][order[1]])) < 1e-9


def unpacked_png(data):
    """The pixels of a PNG without filters, read by the format's definition."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, found = 8, {}
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        assert struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + body)
        found[kind] = body
        at += 12 + size
    w, h, depth, colour = struct.unpack(">IIBB", found[b"IHDR"][:10])
    assert (depth, colour) == (8, 2)
    lines = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(h, 3 * w + 1)
    assert not lines[:, 0].any()
    return lines[:, 1:].reshape(h, w, 3)


def test_thumbnails(spark, tree):
    files = readers.images(spark, str(tree), content=True).select("path", "content").unionByName(spark.createDataFrame([("bad", bytearray(b"no image")), ("none", None)], "path string, content binary"))
    got = {r["path"]: r["thumb"] for r in scoring.thumbnails(files, pixels.ppm_image, 15).collect()}
    assert len(got) == 8 and got.pop("bad") is None and got.pop("none") is None
    for path, thumb in got.items():
        with open(path, "rb") as f:
            wanted = pixels.bounded(pixels.ppm_image(f.read()), 15)
        assert (unpacked_png(bytes(thumb)) == wanted).all() and max(wanted.shape[:2]) == 15


def test_galleries_with_pictures(spark, tmp_path):
    thumb = bytearray(pixels.png_bytes(np.zeros((2, 2, 3), np.uint8)))
    rows = [(kind, k + 1, f"{kind}/<{k}>.jpg", 0.5 + k / 200, int(kind == "FN"), "clean", thumb if k else None) for kind in ("FP", "FN") for k in range(45)]
    worst = spark.createDataFrame(rows, "error_type string, place long, image_path string, pred double, label int, condition string, thumb binary")
    one = sinks.gallery(worst.where("place <= 2"), "m", 0.5, 100, str(tmp_path / "a" / "m.html"))
    assert one == [str(tmp_path / "a" / "m.html")]
    text = (tmp_path / "a" / "m.html").read_text(encoding="utf-8")
    assert text.count("data:image/png;base64,") == 2 and text.count("[image not found: ") == 2
    pages = sinks.gallery(worst, "m", 0.5, 100, str(tmp_path / "m.html"))
    assert [p.rpartition("/")[2] for p in pages] == ["index.html", "page-2.html", "page-3.html"]
    assert sum(open(p, encoding="utf-8").read().count("<figure") for p in pages) == 90
    assert len(list((tmp_path / "m" / "thumbs").iterdir())) == 88
    meta, cards = readers.galleries(spark, pages[0])
    assert (meta.first()["n_fp"], meta.first()["n_fn"], cards.count()) == (45, 45, 90)
    assert cards.where("path = 'FN/<3>.jpg'").count() == 1
    assert len(sinks.gallery(worst, "m", 0.5, 100, str(tmp_path / "b.html"), layout="embedded")) == 1
    with pytest.raises(ValueError, match="layout"):
        sinks.gallery(worst, "m", 0.5, 100, str(tmp_path / "c.html"), layout="x")


def test_style_similarity(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 2.0]), (3, [1.0, 1.0])], "id int, v array<double>")
    got = {r["id"]: r for r in scoring.style_similarity(rows, "v", [2.0, 0.0], [0.0, 3.0]).collect()}
    assert {k: r["stylized"] for k, r in got.items()} == {1: False, 2: True, 3: False}
    assert abs(got[2]["style_sim"] - 2 / 5**0.5) < 1e-12 and got[1]["photo_sim"] == 1.0


def test_slice_tables(spark, tmp_path):
    row = dict.fromkeys(sinks.SLICE_COLUMNS)
    row |= {"feature": "size", "value": "small", "n": 5, "auroc": 0.25, "fnr": None, "shortcut_candidate": True, "blind_spot_candidate": False}
    schema = ", ".join(f"{c} {'string' if c in ('feature', 'value') else 'boolean' if c.endswith('candidate') else 'long' if c.startswith('n') else 'double'}" for c in sinks.SLICE_COLUMNS)
    df = spark.createDataFrame([tuple(row.values())], schema)
    shown = sinks.slice_markdown(df).splitlines()
    assert shown[0].startswith("| feature | value | n |") and shown[2] == "| size | small | 5 | — | — | 0.2500 | — | — | — | True | False |"
    sinks.slice_csv(df, str(tmp_path / "s"))
    text = "".join(f.read_text() for f in (tmp_path / "s").glob("part-*.csv"))
    assert text.splitlines()[0] == ",".join(sinks.SLICE_COLUMNS)


def test_features_of_another_model_do_not_count(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "path string")
    cache = spark.createDataFrame([("a", 2, "m1", 0.5), ("b", 2, "m0", 0.7)], "path string, feature_version int, semantic_model string, x double")
    have, missing = joins.attached(rows, cache, "path", 2, model="m1")
    assert [r["path"] for r in have.collect()] == ["a"] and [r["path"] for r in missing.collect()] == ["b"]
