"""The four verbs of an evaluation, over DataFrames: score, materialize, compare, robustness.

Items are (image_id, content, label); a predictor takes rows with image_id, condition and
content and adds `pred`.  `python -m verdigris` offers the same on a command line.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.paths import relative_to
from .functions.pixels import PPM, Codec, conditions, refuse_unsupported, resolve
from .functions.values import error_type
from .operators.groups import worst
from .operators.materialize import contents, materialized, placed, with_sizes
from .operators.metrics import binary_metrics, score_predictions
from .operators.scoring import Predictor
from .schema import SOURCE
from .sources import readers, sinks


def score(
    spark: SparkSession, predictions: str, labelled: DataFrame, root: str, predict_root: str | None = None, threshold: float = 0.5, max_errors: int = 50,
    split: str = "", condition: str = "clean",
) -> tuple[DataFrame, DataFrame]:
    """Metrics of a prediction file against labelled images (path, y), and the worst errors.

    Paths are compared below their roots; an image that is predicted twice counts twice.
    """
    own = readers.predictions(spark, predictions)
    preds = own.select(relative_to(F.col("image_path"), predict_root or root).alias("key"), "image_path", "pred")
    labels = labelled.select(relative_to(F.col("path"), root).alias("key"), "y")
    found, errors = score_predictions(preds, labels, threshold=threshold, max_errors=max_errors)
    return found.withColumns({"split": F.lit(split), "condition": F.lit(condition)}), errors


def materialize(items: DataFrame, asked: str, out: str, codec: Codec = PPM, **options) -> dict[str, int]:
    """Items under the asked conditions as files below `out`/images, with `out`/manifest; how many rows, files made and files that were there.

    items: image_id, content and label, and as many columns of a source manifest as there are.
    """
    names = [c for c in conditions(asked) if c != "clean"]
    if not names:
        raise ValueError("no condition to materialize")
    settings = resolve(",".join(names))
    refuse_unsupported([op for _, op, _, _ in settings], codec)
    rows = items if {"width", "height"} <= set(items.columns) else with_sizes(items.drop("width", "height"), codec.decode)
    filled = {"path": F.col("image_id"), "source_dataset": F.lit(""), "split": F.lit(options.pop("split", ""))}
    rows = rows.withColumns({f.name: filled.get(f.name, F.lit(None)).cast(f.dataType) for f in SOURCE.fields if f.name not in rows.columns})
    return materialized(rows, settings, codec, f"{out.rstrip('/')}/images", f"{out.rstrip('/')}/manifest", **options)


def _under(items: DataFrame, names: Sequence[str], out: str, codec: Codec) -> DataFrame:
    """image_id, condition, label and content of the items under each condition; `clean` ones as they are."""
    rows = []
    if "clean" in names:
        rows.append(items.select("image_id", F.lit("clean").alias("condition"), F.col("label").cast("int").alias("label"), "content"))
    if others := [n for n in names if n != "clean"]:
        materialize(items, ",".join(others), out, codec)
        settings = resolve(",".join(others))
        own = placed(items.select("image_id", F.col("label").cast("int").alias("label")), settings)
        files = contents(items.sparkSession, settings, f"{out.rstrip('/')}/images").drop("transform_key")
        rows.append(own.join(files, "place").select("image_id", F.col("key").alias("condition"), "label", "content"))
    return reduce(DataFrame.unionByName, rows)


def compare(
    items: DataFrame, predictors: Mapping[str, Predictor], asked: str, out: str, codec: Codec = PPM, threshold: float = 0.5, split: str = "", max_errors: int = 50
) -> tuple[DataFrame, DataFrame]:
    """(model, split, condition and metrics; the worst errors of each) of several models on the same images, which are made once."""
    if not predictors:
        raise ValueError("no model to compare")
    rows = _under(items, conditions(asked), out, codec)
    scored = [predict(rows).select(F.lit(model).alias("model"), "condition", "image_id", "label", "pred") for model, predict in predictors.items()]
    every = reduce(DataFrame.unionByName, scored)
    table = binary_metrics(every, ["model", "condition"], threshold=threshold).withColumn("split", F.lit(split))
    named = every.withColumn("error_type", error_type(F.col("pred"), F.col("label"), threshold))
    return table, worst(named, max_errors, tie="image_id", keys=["model", "condition"])


def robustness(items: DataFrame, predictor: Predictor, asked: str, out: str, model: str = "", **options) -> tuple[DataFrame, DataFrame]:
    """The same of one model."""
    return compare(items, {model: predictor}, asked, out, **options)


def write_tables(table: DataFrame, where: str, stem: str, asked: str = "", models: Sequence[str] = ()) -> list[str]:
    """A metric table of a few rows as JSON, CSV and Markdown, and with conditions as a pivot too; the paths."""
    Path(where).mkdir(parents=True, exist_ok=True)
    paths = [f"{where.rstrip('/')}/{stem}{end}" for end in (".json", ".csv", ".md", "_pivot.md")]
    table = table.orderBy("model", "condition")
    sinks.metric_json(table, paths[0])
    sinks.metric_csv(table.coalesce(1), paths[1])
    Path(paths[2]).write_text(sinks.markdown(table), encoding="utf-8")
    if not asked:
        return paths[:3]
    Path(paths[3]).write_text(sinks.pivot_markdown(table, conditions(asked), models), encoding="utf-8")
    return paths
