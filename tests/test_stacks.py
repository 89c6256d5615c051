"""Images measured and transformed in stacks, by tasks that are dealt by rows and not by the bytes of a file."""

import numpy as np
import pyarrow as pa
import pytest

from verdigris import plans
from verdigris.functions import pixels
from verdigris.operators import scoring

RNG = np.random.default_rng(3)
SHAPES = [(16, 12), (9, 7), (1, 5), (5, 1), (40, 33), (2, 600)]


def pictures(height: int, width: int, n: int = 5) -> np.ndarray:
    return np.concatenate([RNG.integers(0, 256, (n, height, width, 3)), np.zeros((1, height, width, 3), int), RNG.integers(0, 3, (n, height, width, 3)) * 127]).astype(np.uint8)


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """12,000 parts in one file, as one task would read it."""
    folder = tmp_path_factory.mktemp("parts")
    spark.range(0, 12_000, 1, 1).selectExpr("id AS p_partkey", "CAST(id % 300 AS INT) AS p_size").write.parquet(f"{folder}/part.parquet")
    return str(folder)


@pytest.mark.parametrize("shape", SHAPES)
def test_measures_of_a_stack_are_those_of_each_image(shape):
    stack = pictures(*shape)
    assert pixels.perceptual_hashes(stack) == [pixels.perceptual_hash(img) for img in stack]
    assert pixels.features_of_stack(stack, ["jpeg"] * len(stack)) == [pixels.features(img, "jpeg") for img in stack]
    for img, got in zip(stack, pixels.features_of_stack(stack, ["ppm"] * len(stack)), strict=True):
        levels = (pixels.bounded(img, 512).astype(np.float32) / np.float32(255) @ np.array([0.2126, 0.7152, 0.0722], np.float32)).ravel()
        p = np.bincount((levels * 255).clip(0, 255).astype(np.uint8)) / levels.size
        assert got["entropy_bits"] == pytest.approx(-sum(x * np.log2(x) for x in p if x), abs=1e-9)
        assert got["brightness_mean"] == pytest.approx(levels.astype(float).mean(), abs=1e-5)


def test_stacks_hold_every_image_once_and_little_at_a_time():
    images = [(np.full((*SHAPES[k % 5], 3), k % 251, np.uint8), k % 3) for k in range(3_000)] + [(np.zeros((2_000, 2_000, 3), np.uint8), 0)]
    seen = []
    for places, stack, key in scoring._stacks(images):
        assert all((images[p][0] == img).all() and images[p][1] == key for p, img in zip(places, stack, strict=True))
        assert len(places) == 1 or stack.nbytes < scoring.STACK + stack[0].nbytes
        seen += places
    assert sorted(seen) == list(range(len(images)))


def test_measures_of_mixed_sizes(spark):
    images = {f"{k}.ppm": pictures(*SHAPES[k % 6], 1)[k % 3] for k in range(60)}
    rows = spark.createDataFrame([(p, bytearray(pixels.ppm_bytes(img)), p) for p, img in images.items()], "path string, content binary, kept string").coalesce(1)
    got = scoring.measured(rows, pixels.ppm_image, keep=["kept"]).collect()
    assert [r["path"] for r in got] == list(images) == [r["kept"] for r in got]
    for r in got:
        wanted = pixels.features(images[r["path"]], "ppm") | {"phash": pixels.perceptual_hash(images[r["path"]])}
        assert {k: r[k] for k in wanted} == wanted
    broken = spark.createDataFrame([("a.ppm", bytearray(b"GIF89a"))], "path string, content binary")
    with pytest.raises(Exception, match="PPM"):
        scoring.measured(broken, pixels.ppm_image).collect()


def test_pixel_measures_is_dealt_by_rows(spark, parts):
    rows = plans.QUERIES["pixel_measures"](spark, parts)
    assert rows.rdd.getNumPartitions() == 3
    i = np.arange(24 * 18 * 3)
    got = {int(r["path"].removesuffix(".ppm")): r for r in rows.collect()}
    assert sorted(got) == list(range(12_000))
    for key in range(0, 12_000, 397):
        img = (i * (7 + key % 300) % 256).astype(np.uint8).reshape(18, 24, 3)
        wanted = pixels.features(img, "ppm") | {"phash": pixels.perceptual_hash(img)}
        assert {k: got[key][k] for k in wanted} == wanted


@pytest.mark.parametrize("shape", SHAPES)
def test_a_transformed_stack_is_each_image_transformed(shape):
    stack = pictures(*shape)
    seeds = [17 * k for k in range(len(stack))]
    for _, op, _, value in pixels.SETTINGS:
        if op == "jpeg":
            with pytest.raises(ValueError, match="codec"):
                pixels.apply_to_stack(stack, op, value, seeds)
            continue
        out, params = pixels.apply_to_stack(stack, op, value, seeds)
        for k, img in enumerate(stack):
            wanted, used = pixels.apply(img, op, value, seeds[k])
            assert out[k].shape == wanted.shape and (out[k] == wanted).all() and params[k] == used
    with pytest.raises(ValueError, match="unknown operation"):
        pixels.apply_to_stack(stack, "nope", 1.0, seeds)


def test_transforms_of_mixed_sizes(spark):
    settings = [s for s in pixels.SETTINGS if s[1] != "jpeg"]
    images = [(pictures(*SHAPES[k % 6], 1)[k % 3], *settings[k % 10][1::2], 31 * k) for k in range(120)]
    rows = [(str(k), bytearray(img.tobytes()), *img.shape[:2], op, float(value), seed) for k, (img, op, value, seed) in enumerate(images)]
    rows = spark.createDataFrame(rows, "row_id string, pixels binary, height int, width int, op string, value double, seed long").coalesce(1)
    total = ("long", pa.int64(), lambda stack: stack.reshape(len(stack), -1).sum(1))
    whole = scoring.transformed_stacks(rows, pixels.apply_to_stack).collect()
    sums = scoring.transformed_stacks(rows, pixels.apply_to_stack, {"total": total}).collect()
    assert whole == scoring.transformed(rows, pixels.apply).collect() and [r["row_id"] for r in whole] == [str(k) for k in range(120)]
    for r, t, (img, op, value, seed) in zip(whole, sums, images, strict=True):
        wanted, used = pixels.apply(img, op, value, seed)
        assert bytes(r["pixels"]) == wanted.tobytes() and (r["height"], r["width"]) == wanted.shape[:2] and r["params"] == used
        assert t["total"] == int(wanted.sum()) and (t["height"], t["width"], t["params"]) == (r["height"], r["width"], r["params"])


def test_pixel_transforms_is_dealt_by_rows(spark, parts):
    rows = plans.QUERIES["pixel_transforms"](spark, parts)
    assert rows.rdd.getNumPartitions() == 6
    blurred = rows.where("row_id like '%|blur_s10'").collect()
    assert sorted(int(r["row_id"].split("|")[0]) for r in blurred) == list(range(12_000))
    i = np.arange(16 * 12 * 3)
    for r in blurred[::397]:
        img = (i * (7 + int(r["row_id"].split("|")[0]) % 300) % 256).astype(np.uint8).reshape(16, 12, 3)
        assert r["total"] == int(pixels.blur(img, 1.0).sum()) and (r["height"], r["width"], r["params"]) == (16, 12, {"sigma": 1.0})
