"""Images as files: bytes, places, manifests, and what a failed task leaves."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.functions import pixels
from verdigris.operators import materialize
from verdigris.schema import SOURCE, TRANSFORM
from verdigris.sources import image_files

SETTINGS = pixels.resolve("jpeg_q30,blur_s10,jitter_p20,crop_p80")


def fake_codec():
    """A lossy codec that can be told from its bytes: the quality, the shape, and the pixels without their lowest bits."""

    def encode(img, quality=95):
        return b"FAKE" + bytes([quality, *img.shape[:2]]) + (img >> 4).tobytes()

    def decode(data):
        if data[:4] != b"FAKE":
            return pixels.plain_image(data)
        return (np.frombuffer(data, np.uint8, -1, 7) << 4).reshape(data[5], data[6], 3)

    return pixels.Codec(decode, encode, lossy=True)


FAKE = fake_codec()


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sources")
    rng = np.random.default_rng(5)
    rows = []
    for k in range(6):
        img = rng.integers(0, 256, (20 + k, 30, 3)).astype(np.uint8)
        path = root / f"{k}.ppm"
        path.write_bytes(pixels.ppm_bytes(img))
        ident = f"{k}{'abcdef'[k]}" + "0" * 38
        rows.append((ident, str(path), k % 2, "d", "gen" if k % 2 else None, "val" if k < 4 else "train", 30, 20 + k, *[None] * 4, "ppm", None, None))
    return spark.createDataFrame(rows, SOURCE)


def lines(manifest):
    return [json.loads(x) for p in sorted(manifest.glob("part-*")) for x in p.read_text().splitlines()]


def test_files_and_manifest(spark, sources, tmp_path):
    root, manifest = tmp_path / "out", tmp_path / "m"
    told = materialize.materialized(sources, SETTINGS, FAKE, str(root), str(manifest), splits=["val"])
    assert told == {"rows": 16, "made": 16, "skipped": 0}
    got = lines(manifest)
    assert [r["transform_key"] for r in got] == [s[0] for s in SETTINGS for _ in range(4)]
    assert all(set(r) == set(TRANSFORM.fieldNames()) for r in got)
    assert not list(root.glob("_*"))
    values = {key: (op, v) for key, op, _, v in SETTINGS}
    by_id = {r["image_id"]: r for r in sources.collect()}
    for r in got:
        source = by_id[r["source_image_id"]]
        op, value = values[r["transform_key"]]
        ending = "jpg" if op == "jpeg" else "png"
        assert r["path"] == f"{root}/{r['transform_key']}/{source['image_id'][:2]}/{source['image_id']}.{ending}"
        with open(r["path"], "rb") as f:
            data = f.read()
        with open(source["path"], "rb") as f:
            img = pixels.ppm_image(f.read())
        if op == "jpeg":
            # Encoded once, at its quality, and kept as it is.
            assert data == FAKE.encode(img, 30)
        else:
            wanted, params = pixels.apply(img, op, value, r["seed"])
            assert (pixels.plain_png_image(data) == wanted).all() and r["params"] == pytest.approx(params)
            assert (r["height"], r["width"]) == wanted.shape[:2]
        assert (r["label"], r["generator"], r["split"], r["row_id"]) == (source["label"], source["generator"], "val", f"{source['image_id']}_{r['transform_key']}")


def test_second_run_makes_nothing(spark, sources, tmp_path):
    root, manifest = tmp_path / "out", tmp_path / "m"
    materialize.materialized(sources, SETTINGS, FAKE, str(root), str(manifest), limit=3)
    before, when = lines(manifest), {p: p.stat().st_mtime_ns for p in root.rglob("*.*")}
    assert len(before) == 12 == len(when)
    assert materialize.materialized(sources, SETTINGS, FAKE, str(root), str(manifest), limit=3) == {"rows": 12, "made": 0, "skipped": 12}
    assert lines(manifest) == before and {p: p.stat().st_mtime_ns for p in root.rglob("*.*")} == when
    gone = next(root.rglob("*.jpg"))
    gone.unlink()
    assert materialize.materialized(sources, SETTINGS, FAKE, str(root), str(manifest), limit=3)["made"] == 1 and gone.exists()
    assert materialize.materialized(sources, SETTINGS, FAKE, str(root), str(manifest), limit=3, overwrite=True)["made"] == 12


def test_content_of_items_and_odd_ids(spark, sources, tmp_path):
    content = spark.read.format("binaryFile").load(f"{sources.first()['path'].rpartition('/')[0]}/*.ppm").select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    items = sources.join(content, "path").withColumn("image_id", F.concat(F.lit("../a b/"), "image_id"))
    told = materialize.materialized(items, SETTINGS[1:2], pixels.PPM, str(tmp_path / "o"), str(tmp_path / "m"), resize_back=True)
    assert told["made"] == 6
    assert all(p.resolve().is_relative_to(tmp_path / "o") for p in (tmp_path / "o").rglob("*.png"))
    assert materialize.materialized(items.drop("content"), SETTINGS[1:2], pixels.PPM, str(tmp_path / "o"), str(tmp_path / "m"))["made"] == 0
    found = materialize.contents(spark, SETTINGS[1:2], str(tmp_path / "o")).join(materialize.placed(items.select("image_id"), SETTINGS[1:2]), "place")
    assert found.count() == 6


def test_jpeg_is_refused_without_a_lossy_codec(spark, sources, tmp_path):
    with pytest.raises(ValueError, match="lossy"):
        materialize.materialized(sources, SETTINGS, pixels.PPM, str(tmp_path / "o"), str(tmp_path / "m"))
    with pytest.raises(ValueError, match="lossy"):
        pixels.apply(np.zeros((2, 2, 3), np.uint8), "jpeg", 30, 1, pixels.PPM)
    with pytest.raises(ValueError, match="no source rows"):
        materialize.materialized(sources, SETTINGS, FAKE, str(tmp_path / "o"), str(tmp_path / "m"), splits=["test"])


def test_a_failed_task_leaves_no_half_file(spark, tmp_path):
    """The second partition's task fails when half of its files are made."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in batch.column(0).to_pylist():
                if k == 150:
                    raise RuntimeError("a task that is lost")
                yield pa.RecordBatch.from_arrays([pa.array([f"k/{k}.bin"]), pa.array([bytes([k % 256]) * 1000], pa.binary())], ["path", "content"])

    rows = spark.range(0, 200, 1, 2).mapInArrow(run, "path string, content binary")
    with pytest.raises(Exception, match="a task that is lost"):
        image_files.write_files(rows, str(tmp_path / "o"))
    left = [p for p in (tmp_path / "o").glob("[!_]*/*") if p.is_file()]
    assert all(p.suffix == ".bin" and p.stat().st_size == 1000 and int(p.stem) < 100 for p in left)
    image_files.write_files(spark.range(0, 200, 1, 2).select(F.concat(F.lit("k/"), F.col("id").cast("string"), F.lit(".bin")).alias("path"), F.lit(b"x").alias("content")), str(tmp_path / "o"))
    assert sum(1 for _ in (tmp_path / "o").rglob("*.bin")) == 200


def test_conditions_lists():
    assert pixels.conditions("ops") == list(pixels.DAILY)
    with pytest.raises(ValueError, match="empty"):
        pixels.conditions(" , ")
