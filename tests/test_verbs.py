"""The verbs over a small tree of images, from files to tables."""

import csv
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris import __main__ as command
from verdigris import verbs
from verdigris.functions import pixels
from verdigris.sources import readers, sinks


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("verbs")
    rng = np.random.default_rng(8)
    for kind in ("real", "fake"):
        (root / kind).mkdir()
        for k in range(4):
            (root / kind / f"{k}.ppm").write_bytes(pixels.ppm_bytes(rng.integers(0, 256, (10 + k, 12, 3)).astype(np.uint8)))
    return root


@pytest.fixture(autouse=True)
def ppm_is_an_image(monkeypatch):
    monkeypatch.setattr(readers, "is_image", lambda rel: F.lower(rel).rlike(r"\.(ppm|png|jpg)$"))


def oracle(rows):
    """Right about every image."""
    return rows.withColumn("pred", F.when(F.col("image_id").startswith("fake"), 0.9).otherwise(0.1))


def by_size(rows):
    """Taken by surprise by small images: width and height are where a PNG has them, or in a PPM's second line."""
    height = F.when(F.hex(F.substring("content", 1, 4)) == "89504E47", F.conv(F.hex(F.substring("content", 21, 4)), 16, 10)).otherwise(F.substring_index(F.split(F.decode(F.substring("content", 1, 9), "ISO-8859-1"), "\n")[1], " ", -1))
    return rows.withColumn("pred", F.when(height.cast("int") < 10, 0.2).otherwise(0.8))


def test_score(spark, tree, tmp_path):
    file = tmp_path / "p.json"
    file.write_text(json.dumps([{"image_path": f"/there/{k}/{i}.ppm", "pred": p} for k, p in (("real", 0.6), ("fake", 0.7)) for i in range(5)]))
    found, errors = verbs.score(spark, str(file), readers.labelled_tree(spark, str(tree)), str(tree), "/there", split="val")
    r = found.first()
    assert (r["n"], r["fp"], r["tp"], r["unmatched"], r["auroc"], r["split"], r["condition"]) == (8, 4, 4, 2, 1.0, "val", "clean")
    assert [(e["error_type"], e["y"]) for e in errors.collect()] == [("FP", 0)] * 4


def test_compare_makes_images_once(spark, tree, tmp_path):
    files = readers.images(spark, str(tree), content=True)
    items = files.select(F.col("rel").alias("image_id"), "content", F.col("rel").startswith("fake").cast("int").alias("label"))
    asked, out = "clean,crop_p80,blur_s10", str(tmp_path / "work")
    models = {"oracle": oracle, "size": by_size}
    table, errors = verbs.compare(items, models, asked, out, split="val")
    rows = {(r["model"], r["condition"]): r for r in table.collect()}
    assert set(rows) == {(m, c) for m in models for c in asked.split(",")}
    assert all(r["n"] == 8 and r["split"] == "val" for r in rows.values())
    assert all(rows["oracle", c]["acc"] == 1.0 for c in asked.split(","))
    assert rows["size", "clean"]["recall_fake"] == 1.0 and rows["size", "crop_p80"]["recall_fake"] == 0.5
    assert errors.where("model = 'oracle'").isEmpty()
    again, _ = verbs.robustness(items, oracle, asked, out, model="oracle")
    assert again.count() == 3 and verbs.materialize(items, "crop_p80,blur_s10", out) == {"rows": 16, "made": 0, "skipped": 16}
    with pytest.raises(ValueError, match="no condition"):
        verbs.materialize(items, "clean", out)


def test_command_line(spark, tree, tmp_path, capsys):
    out = str(tmp_path / "r")
    models = ["--model", f"o={__name__}:oracle", "--model", f"s={__name__}:by_size"]
    (tmp_path / "splits.json").write_text(json.dumps({"val": str(tree)}))
    named = ["--splits", str(tmp_path / "splits.json"), "--split", "val", "--work-dir", str(tmp_path / "images")]
    command.main(["compare", *named, "--conditions", "clean,crop_p80", "--out", out, *models[2:], *models[:2]])
    with open(f"{out}/compare_pivot.md", encoding="utf-8") as f:
        pivot = f.read()
    # Models come in the order they were asked for.
    assert "| o | 1.0000 / 1.0000 | 1.0000 / 1.0000 |" in pivot and pivot.index("| s |") < pivot.index("| o |")
    assert (tmp_path / "images" / "images" / "crop_p80").is_dir()
    with pytest.raises(SystemExit):
        command.main(["compare", "--out", out, *models])
    with pytest.raises(ValueError, match="lossy"):
        command.main(["compare", *named, "--out", out, *models])
    with open(f"{out}/compare.json", encoding="utf-8") as f:
        assert [(r["model"], r["condition"]) for r in json.load(f)] == [("o", "clean"), ("o", "crop_p80"), ("s", "clean"), ("s", "crop_p80")]
    part = next(p for p in (tmp_path / "r" / "compare.csv").iterdir() if p.name.startswith("part-"))
    with open(part, encoding="utf-8") as f:
        got = list(csv.DictReader(f))
    assert tuple(got[0]) == sinks.METRIC_COLUMNS and [r["acc"] for r in got[:2]] == ["1.0000", "1.0000"]
    assert "errors" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        command.main(["robustness", "--root", str(tree), "--out", out, *models])
