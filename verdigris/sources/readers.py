"""Readers: file trees, JSON lines, prediction arrays, Parquet shards, HTML galleries, configurations."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import IMAGE_SUFFIXES, is_image, item_id, label_from_folders, name, relative_to, suffix
from ..operators.validate import parse_strict


def _plain(path):
    """A file's path without the scheme that Spark puts before it."""
    return F.regexp_replace(path, "^file:/+", "/")


def files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, rel, length, modificationTime (and content) of all files below root; their bytes are read only if asked for."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = rows.withColumn("path", _plain(F.col("path"))).withColumn("rel", relative_to(F.col("path"), root))
    return rows if content else rows.drop("content")


def images(spark: SparkSession, root: str, content: bool = False, or_all: bool = False) -> DataFrame:
    """Files with an image's ending; with `or_all`, all files where there is none."""
    rows = files(spark, root, content)
    found = rows.where(is_image(F.col("rel")))
    return rows if or_all and found.isEmpty() else found


def labelled_tree(spark: SparkSession, root: str, positives: Sequence[str] = (), default: int | None = None) -> DataFrame:
    """Images labelled by their folders (y); those without a label go."""
    rows = images(spark, root).withColumn("y", label_from_folders(F.col("rel"), positives, default))
    return rows.where("y IS NOT NULL")


def source_index(
    spark: SparkSession, root: str, dataset: str, split: str, real: Sequence[str], fake: Sequence[str], label: int | None = None, content: bool = False
) -> DataFrame:
    """Rows for a source manifest (and the files' content): label from the parent folder's name, or the one given."""
    if both := set(map(str.lower, real)) & set(map(str.lower, fake)):
        raise ValueError(f"real and fake at once: {', '.join(sorted(both))}")
    rows = images(spark, root, content)
    parent = F.lower(F.element_at(F.split("path", "/"), -2))
    own = F.lit(label) if label is not None else (
        F.when(parent.isin(*[x.lower() for x in fake]), 1).when(parent.isin(*[x.lower() for x in real]), 0)
    )
    ending = F.lower(F.ltrim(suffix(F.col("path")), F.lit(".")))
    return rows.select(
        item_id(F.col("path"), F.col("length")).alias("image_id"), "path", own.cast("int").alias("label"),
        F.lit(dataset).alias("source_dataset"), F.lit(split).alias("split"), ending.alias("original_format"), "length",
        *(["content"] if content else []),
    ).where("label IS NOT NULL")


def source_index_with_sizes(spark: SparkSession, root: str, decode, **options) -> DataFrame:
    """source_index with width, height and perceptual hash of each image, in one scan; `decode`: bytes -> array."""
    from ..operators.scoring import measured

    rows = source_index(spark, root, content=True, **options)
    keep = [c for c in rows.columns if c not in ("path", "content")]
    return measured(rows, decode, keep=keep).select("path", *keep, "width", "height", "phash")


def split_root(roots: Mapping[str, str], name_: str) -> str:
    """The folder of a named split; a name that is not there is an error that lists those that are."""
    if name_ not in roots:
        raise ValueError(f"unknown split {name_}; known: {', '.join(sorted(roots))}")
    return roots[name_]


def split(spark: SparkSession, roots: Mapping[str, str], name_: str, all_positive: Sequence[str] = ()) -> DataFrame:
    """The labelled images of a named split; in splits of `all_positive`, what no folder labels is positive.  A split without images is an error."""
    rows = labelled_tree(spark, split_root(roots, name_), default=1 if name_ in all_positive else None)
    if rows.isEmpty():
        raise ValueError(f"split {name_} has no labelled images")
    return rows


#: Other names of pools.
POOL_ALIASES = {"custom": "dir", "official_val": "coco", "val": "coco", "wf": "wildfake", "sid": "sid_val"}


def negatives(
    spark: SparkSession, kind: str, pools: Mapping[str, str], folder: str | None = None, held: DataFrame | None = None, forbidden: Sequence[str] = (), label: int = 0
) -> DataFrame:
    """Negatives (y = 0) of a named pool, or of a `folder` for kind `dir`: its negative folders, or all of it where none is labelled.

    A pool is a tree of images, or Parquet shards (image, label), of which the rows of one
    label are taken, with `path` made of shard and row.  `held` (rows with a `path`): images
    whose name one of these has go, as do those whose path has a `forbidden` part in it.
    """
    from ..operators.joins import without_overlap

    kind = kind.strip().lower()
    kind = POOL_ALIASES.get(kind, kind)
    if kind == "dir":
        if folder is None:
            raise ValueError("kind dir needs a folder")
        rows = images(spark, folder)
        own = label_from_folders(F.col("rel"), (), None)
        marked = rows.withColumn("y", own)
        if folder.rstrip("/").rpartition("/")[2].lower() == "real" or marked.where("y IS NOT NULL").isEmpty():
            found = rows.withColumn("y", F.lit(0))
        else:
            found = marked.where("y = 0")
    elif kind not in pools:
        raise ValueError(f"unknown pool {kind}; known: {', '.join(sorted([*pools, 'dir']))}")
    elif files(spark, pools[kind]).where(F.col("rel").endswith(".parquet")).isEmpty():
        found = images(spark, pools[kind]).withColumn("y", F.lit(0))
    else:
        path = F.concat_ws("/", F.lit(pools[kind].rstrip("/")), "shard", F.col("row").cast("string"))
        found = shards(spark, pools[kind], labels={label: 0}).withColumnRenamed("label", "y").withColumn("path", path)
    if held is not None:
        last = F.element_at(F.split("path", "/"), -1)
        found = without_overlap(found, held.select(last.alias("held_name")), last, "held_name")
    for part in forbidden:
        found = found.where(~F.col("path").contains(part))
    if found.isEmpty():
        raise ValueError(f"no negatives in {kind}")
    return found


#: The folders of a three-class tree, and what their images are.
CLASS_FIELDS = ("label", "generator", "family", "arch", "generation_type", "content_type")
CLASSES = {
    "real": (0, None, None, None, None, "real"),
    "full_synth": (1, "flux", "diffusion", "flow", "t2i", "full_synthetic"),
    "tampered": (1, "flux", "diffusion", "flow", "i2i", "partial_manipulation"),
}


def three_class_tree(spark: SparkSession, root: str, split: str = "train", content: bool = False, classes: Mapping[str, tuple] = CLASSES) -> DataFrame:
    """Images below root/real, root/full_synth and root/tampered with `subdir` and the fields of its class, in one scan; folders may be missing.

    subdir comes from the metadata of the file, so files of classes that a filter on it rules
    out are not opened.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root.rstrip('/')}/{{{','.join(classes)}}}")
    below = relative_to(_plain(F.col("_metadata.file_path")), root)
    rows = rows.withColumn("subdir", F.substring_index(below, "/", 1)).where(F.col("subdir").isin(*classes))
    rows = rows.withColumn("path", _plain(F.col("path"))).withColumn("rel", relative_to(F.col("path"), root)).where(is_image(F.col("rel")))
    fields = []
    for k, name_ in enumerate(CLASS_FIELDS):
        value = F.lit(None).cast("int" if name_ == "label" else "string")
        for folder, values in classes.items():
            value = F.when(F.col("subdir") == folder, F.lit(values[k])).otherwise(value)
        fields.append(value.alias(name_))
    return rows.select("path", "rel", "length", "subdir", *fields, F.lit(split).alias("split"), *(["content"] if content else []))


def shards(spark: SparkSession, where: str, cap: int | None = None, labels: Mapping[int, int] | None = None) -> DataFrame:
    """image and label of Parquet shards, only those two columns; rows of labels that are not mapped go.

    With a cap, the first so many rows in the order of shards and rows: labels are counted by
    shard, the counts added up, and whole shards are taken up to the one where the cap is
    reached, of which the row that reaches it is looked up.  Only the shards taken are read,
    and their images are neither moved nor ordered.
    """
    mapped = labels or {0: 0, 1: 1}
    place = [F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row")]
    rows = spark.read.parquet(where)
    known = F.col("label").isin(*mapped)
    if cap is not None:
        rows = rows.where(up_to_cap(rows.where(known).select(*place), cap))
    rows = rows.where(known).select("image", "label", *place)
    label = F.create_map(*[F.lit(x).cast("int") for pair in mapped.items() for x in pair])[F.col("label").cast("int")]
    return rows.withColumn("label", label).withColumn("image_id", F.sha1(F.concat_ws(":", "shard", F.col("row").cast("string"))))


def up_to_cap(places: DataFrame, cap: int) -> Column:
    """Which of all rows of a Parquet scan are among the first `cap` of places (shard, row), by their metadata."""
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    if cap <= 0:
        return F.lit(False)
    reach = F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, 0))  # one row a shard
    counts = places.groupBy("shard").agg(F.count("*").alias("n")).withColumn("reach", reach)
    at = counts.where(F.col("reach") >= cap).orderBy("shard").first()
    if at is None:
        return F.lit(True)
    left = cap - (at["reach"] - at["n"])
    if left == at["n"]:
        return name <= at["shard"]
    # Row numbers of one shard.
    last = places.where(F.col("shard") == at["shard"]).orderBy("row").select("row").offset(left - 1).limit(1).first()["row"]
    return (name <= at["shard"]) & ((name < at["shard"]) | (row <= last))


def shards_or_tree(spark: SparkSession, shard_path: str | None, tree: str | None, **options) -> DataFrame:
    """Shards where there are any, else the labelled tree."""
    if shard_path and files(spark, shard_path).where(F.col("rel").endswith(".parquet")).count():
        return shards(spark, shard_path, **options)
    if tree is None:
        raise ValueError("neither shards nor a tree")
    return labelled_tree(spark, tree)


def manifest_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """value, file and line (from 1) of JSON lines; blank lines count and are left out.

    A file may be read in many splits: lines are numbered inside each, and the splits'
    counts are added up, so that no task sees a whole file.
    """
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = spark.read.text(path).select("value", *split).withColumn("at", F.monotonically_increasing_id())
    counts = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    lines = rows.join(counts, ["file", "block"])
    return lines.select("value", "file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line")).where(F.trim("value") != "")


def strict_manifest(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, required: Sequence[str]) -> DataFrame:
    """The records of JSON lines; a line that is none is an error that names file and line."""
    rows = parse_strict(manifest_lines(spark, path), schema, required)
    message = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.array_join("errors", "; "))
    first = schema.fields[0].name
    checked = F.when(F.size("errors") > 0, F.raise_error(message).cast(schema.fields[0].dataType)).otherwise(F.col(f"record.{first}"))
    return rows.select(checked.alias(first), *[F.col(f"record.{f.name}").alias(f.name) for f in schema.fields[1:]])


def loose_manifest(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """JSON lines of which only `path` must be there."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    path_ = F.when(F.coalesce("path", F.lit("")) == "", F.raise_error(F.lit("a row has no path")).cast("string")).otherwise(F.col("path"))
    return rows.withColumn("path", path_)


def present(rows: DataFrame, listing: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(rows whose file is listed, rows whose file is not)."""
    have = listing.select(path).distinct()
    return rows.join(have, path, "left_semi"), rows.join(have, path, "left_anti")


def resolved(rows: DataFrame, listing: DataFrame, candidates: Sequence) -> DataFrame:
    """rows (row_id) with `found`: the first candidate path that is listed."""
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), c.alias("path")) for k, c in enumerate(candidates)]))
    tried = rows.select("row_id", keys.alias("t")).select("row_id", "t.rank", "t.path")
    hit = tried.join(listing.select("path").distinct(), "path").groupBy("row_id").agg(F.min_by("path", "rank").alias("found"))
    return rows.join(hit, "row_id", "left")


def predictions(spark: SparkSession, path: str, label: bool = False) -> DataFrame:
    """A JSON array of predictions; a payload that is no array of objects with a path and a score is an error."""
    head = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    if not head or head["c"] != "[":
        raise ValueError(f"{path}: an array is expected")
    schema = "image_path string, pred double, y int, label int, condition string, generator string, _corrupt string"
    rows = spark.read.schema(schema).option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    bad = F.col("_corrupt").isNotNull() | F.col("image_path").isNull() | F.col("pred").isNull()
    if label:
        bad = bad | F.coalesce("y", "label").isNull()
    checked = F.when(bad, F.raise_error(F.lit("a prediction lacks its path, score or label")).cast("string")).otherwise(F.col("image_path"))
    return rows.withColumn("image_path", checked).drop("_corrupt")


def feature_cache(spark: SparkSession, path: str, schema: str, version: int) -> DataFrame:
    """Cached features of one version; rows of other versions go."""
    return spark.read.schema(schema).json(path).where(F.col("feature_version") == version)


_META = r"threshold=([0-9.eE+-]+) · FP=(\d+) · FN=(\d+) · joined=(\d+)"
_CARD = "array<struct<etype string, path string, pred double, label int>>"


def galleries(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(model, threshold, n_fp, n_fn, joined; model, error_type, path, pred, label) of error galleries in HTML.

    The cards are one JSON object with the lists FP and FN; a gallery whose lists differ
    from the counts it states is an error.
    """
    pages = spark.read.text(path, wholetext=True).withColumn("model", name(F.col("_metadata.file_path")))
    number = lambda k, kind: F.regexp_extract("value", _META, k).cast(kind)
    body = F.from_json(F.regexp_extract("value", r"(?s)(\{\s*\"F[PN]\".*?\]\s*\})", 1), f"FP {_CARD}, FN {_CARD}")
    rows = pages.select(
        "model", number(1, "double").alias("threshold"), number(2, "int").alias("n_fp"), number(3, "int").alias("n_fn"),
        number(4, "int").alias("joined"), body.alias("cards"),
    )
    fit = (F.size("cards.FP") == F.col("n_fp")) & (F.size("cards.FN") == F.col("n_fn"))
    message = F.concat(F.col("model"), F.lit(": the cards differ from the counts"))
    rows = rows.withColumn("n_fp", F.when(F.coalesce(fit, F.lit(False)), F.col("n_fp")).otherwise(F.raise_error(message).cast("int")))
    both = F.concat(F.col("cards.FP"), F.col("cards.FN"))
    cards = rows.where("n_fp IS NOT NULL").select("model", F.explode(both).alias("c"))
    return rows.drop("cards"), cards.select("model", F.col("c.etype").alias("error_type"), "c.path", "c.pred", "c.label")


def html_cards(spark: SparkSession, path: str) -> DataFrame:
    """etype, path, pred of the cards of an embedded gallery page, in order."""
    pages = spark.read.text(path, wholetext=True)
    card = r'(?s)data-etype="([^"]*)"[^>]*data-path="([^"]*)"[^>]*data-pred="([^"]*)"'
    found = F.arrays_zip(*[F.regexp_extract_all("value", F.lit(card), F.lit(k)).alias(n) for k, n in ((1, "etype"), (2, "path"), (3, "pred"))])
    rows = pages.select(F.posexplode(found).alias("place", "c"))
    return rows.select("place", "c.etype", "c.path", F.col("c.pred").cast("double").alias("pred"))


def config(path: str) -> dict:
    """A JSON or YAML file on the driver; YAML where its library is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML configurations need PyYAML; JSON ones do not") from e
    return yaml.safe_load(text)


def check_recipe(recipe: Mapping, holdouts: Sequence[str]) -> None:
    """A recipe must forbid every hold-out and must not train on one."""
    train = recipe.get("train", {})
    if used := sorted(set(train.get("datasets", ())) & set(holdouts)):
        raise ValueError(f"trains on hold-outs: {', '.join(used)}")
    if missing := sorted(set(holdouts) - set(train.get("forbid", ()))):
        raise ValueError(f"does not forbid: {', '.join(missing)}")


def check_holdout(listing: DataFrame, split: str, marker: str) -> None:
    """A tree with a marker file must not be indexed for training."""
    if split == "train" and listing.where(name(F.col("path")) == marker).count():
        raise ValueError(f"{marker} marks a hold-out; it cannot be indexed for training")


def numbered(rows: DataFrame, *order) -> DataFrame:
    """row_id 0, 1, ... in the given order, for small tables that need an ordinal."""
    return rows.withColumn("row_id", F.row_number().over(W.orderBy(*order)) - 1)


SUFFIXES = IMAGE_SUFFIXES
