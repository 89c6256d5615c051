"""Images under settings, as files, with the manifest of what they are.

A setting's image of an item is `root/key/id[:2]/id.ext`.  JPEG settings keep the bytes of
the encoder as they are; all others are written without loss, as PNG.  A file that is
there is not made again, so a run that was stopped is taken up where it was, and a run
with nothing left to do writes the same manifest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels
from ..functions.values import scaled_side, seed56
from ..schema import SOURCE, TRANSFORM
from ..sources import readers
from ..sources.image_files import opened, write_files

Setting = tuple[str, str, str, float]
#: Source columns that a manifest repeats.
COPIED = ("label", "source_dataset", "generator", "split", "family", "arch", "generation_type", "content_type", "original_format", "phash")


def _file_id(ident: Column) -> Column:
    """An id as the name of a file: what a name cannot have is escaped."""
    return F.regexp_replace(F.url_encode(ident), r"^\.", "%2E")


def place(ident: Column, key: Column, ending: Column) -> Column:
    """The path of an image below the root."""
    name = _file_id(ident)
    return F.concat_ws("/", key, F.substring(name, 1, 2), F.concat(name, F.lit("."), ending))


def _endings(settings: Sequence[Setting]) -> Column:
    """key -> (ending), as a map."""
    return F.create_map(*[F.lit(x) for key, op, _, _ in settings for x in (key, "jpg" if op == "jpeg" else "png")])


def made(items: DataFrame, settings: Sequence[Setting], codec: pixels.Codec, resize_back: bool = False) -> DataFrame:
    """path and content of the items' images under the settings that their `todo` (keys) names; each item is read and decoded once.

    items: image_id, path, todo and maybe content; without it, the file at `path` is read in the task.
    """
    asked = {key: (op, value) for key, op, _, value in settings}
    pixels.refuse_unsupported([op for op, _ in asked.values()], codec)
    held = "content" in items.columns
    todo = F.transform("todo", lambda k: F.struct(k.alias("key"), place(F.col("image_id"), k, _endings(settings)[k]).alias("place"), seed56(F.col("image_id"), k).alias("seed")))
    rows = items.select("path", (F.col("content") if held else F.lit(None).cast("binary")).alias("content"), todo.alias("todo"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, work in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not held:
                    store, at = opened(path)
                    with store.open_input_stream(at) as f:
                        content = f.read()
                img = codec.decode(content)
                # One image at a time: an item's images are never together in memory.
                for w in work:
                    op, value = asked[w["key"]]
                    yield pa.RecordBatch.from_arrays([pa.array([w["place"]]), pa.array([pixels.file_of(img, op, value, w["seed"], codec, resize_back)], pa.binary())], ["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def _under(items: DataFrame, settings: Sequence[Setting], nths: Sequence[int]) -> DataFrame:
    """items under each of the settings of these numbers (`nth`), with `drawn`: the parameters that come from a seed, which are those of jitter, else null."""
    rows = items.withColumn("nth", F.explode(F.array(*[F.lit(k) for k in nths])))
    if all(settings[k][1] != "jitter" for k in nths):
        return rows.withColumn("drawn", F.lit(None).cast("map<string,double>"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    key = F.element_at(F.create_map(*[x for k in nths for x in (F.lit(k), F.lit(settings[k][0]))]), F.col("nth"))
    spreads = {k: settings[k][3] for k in nths}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, seeds = batch.columns
            drawn = [list(pixels.jitter_factors(s, spreads[k]).items()) for s, k in zip(seeds.to_pylist(), batch.column("nth").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(drawn, pa.map_(pa.string(), pa.float64()))], [*batch.schema.names[:-1], "drawn"])

    return rows.withColumn("_seed", seed56(F.col("image_id"), key)).mapInArrow(run, f"{kinds}, drawn map<string,double>")


def manifest_rows(items: DataFrame, settings: Sequence[Setting], root: str, order: str, resize_back: bool = False) -> DataFrame:
    """TRANSFORM rows of all items under all settings, by setting, then in the items' order.

    What is ordered are the items' own columns and the numbers of settings; ids, seeds, paths and
    parameters are made in the ordered rows.
    """
    held = SOURCE.fieldNames()
    by = order if order in held else "_order"
    items = items.select(*held, *([F.col(order).alias(by)] if by not in held else []))
    jittered = [k for k, s in enumerate(settings) if s[1] == "jitter"]
    plain = [k for k in range(len(settings)) if k not in jittered]
    rows = reduce(DataFrame.unionByName, [_under(items, settings, nths) for nths in (plain, jittered) if nths]).orderBy("nth", by, "image_id")
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("nth"))
    keys, ops, names, values = zip(*settings, strict=True)
    rows = rows.withColumns({"transform_key": of(keys), "transform": of(ops)})
    cropped = lambda side: F.coalesce(*[F.when(F.col("transform_key") == key, scaled_side(F.col(side), v)) for key, op, _, v in settings if op == "crop" and not resize_back], F.col(side))
    ending = of(["jpg" if op == "jpeg" else "png" for op in ops])
    rows = rows.withColumns(
        {
            "row_id": F.concat_ws("_", "image_id", "transform_key"), "source_image_id": F.col("image_id"), "source_path": F.col("path"),
            "seed": seed56(F.col("image_id"), F.col("transform_key")), "params": F.coalesce("drawn", F.create_map(of(names), of([float(v) for v in values]))),
            "path": F.concat(F.lit(root.rstrip("/") + "/"), place(F.col("image_id"), F.col("transform_key"), ending)),
            "width": cropped("width"), "height": cropped("height"),
        }
    )
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TRANSFORM.fields])


def placed(items: DataFrame, settings: Sequence[Setting]) -> DataFrame:
    """items with each key, and where its image is below the root (`place`)."""
    keys = F.explode(F.array(*[F.lit(s[0]) for s in settings])).alias("key")
    return items.select("*", keys).withColumn("place", place(F.col("image_id"), F.col("key"), _endings(settings)[F.col("key")]))


def contents(spark: SparkSession, settings: Sequence[Setting], root: str) -> DataFrame:
    """place, transform_key and content of all images that are there under the settings."""
    return reduce(
        DataFrame.unionByName,
        [
            readers.files(spark, f"{root.rstrip('/')}/{key}", content=True).select(F.concat(F.lit(f"{key}/"), "rel").alias("place"), F.lit(key).alias("transform_key"), "content")
            for key, *_ in settings
        ],
    )


def with_sizes(items: DataFrame, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """items (content) with width and height."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in items.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = [decode(c).shape for c in batch.column("content").to_pylist()]
            sides = [pa.array([s[k] for s in shapes], pa.int32()) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *sides], [*batch.schema.names, "width", "height"])

    return items.mapInArrow(run, f"{kinds}, width int, height int")


def there(items: DataFrame, settings: Sequence[Setting], root: str) -> DataFrame:
    """image_id and `done`: the keys of the settings under which its file is there.  Files are listed, not read."""
    try:
        files = readers.files(items.sparkSession, root).select(F.col("rel").alias("place"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = items.sparkSession.createDataFrame([], "place string")
    return placed(items.select("image_id"), settings).join(files, "place", "left_semi").groupBy("image_id").agg(F.collect_set("key").alias("done"))


def materialized(
    items: DataFrame, settings: Sequence[Setting], codec: pixels.Codec, root: str, manifest: str, splits: Sequence[str] = (), limit: int = 0,
    order: str = "image_id", resize_back: bool = False, overwrite: bool = False,
) -> dict[str, int]:
    """Writes the images of source rows (SOURCE, and maybe content) and a manifest of JSON lines; how many rows it has, how many files were made and how many were there.

    splits: only rows of these.  limit: of these, the first so many in the order, under
    each setting.  Of rows that share an image_id, one (of the first path) is made.
    """
    if splits:
        items = items.where(F.col("split").isin(*splits))
    if items.isEmpty():
        raise ValueError(f"no source rows{f' with a split in {sorted(splits)}' if splits else ''}")
    if limit > 0:
        items = items.orderBy(order, "image_id").limit(limit)
    keys = F.array(*[F.lit(s[0]) for s in settings])
    one = items.groupBy("image_id").agg(F.min("path").alias("path"))
    todo = one.withColumn("todo", keys)
    if not overwrite:
        todo = one.join(there(one, settings, root), "image_id", "left").select("image_id", "path", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>"))).alias("todo"))
    todo = todo.where(F.size("todo") > 0)
    n_made = todo.agg(F.sum(F.size("todo"))).first()[0] or 0
    if n_made:
        work = todo
        if "content" in items.columns:
            work = todo.join(items.select("image_id", "path", "content"), ["image_id", "path"]).dropDuplicates(["image_id"])
        write_files(made(work, settings, codec, resize_back), root)
    rows = manifest_rows(items, settings, root, order, resize_back)
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(manifest)
    n = items.count() * len(settings)
    return {"rows": n, "made": n_made, "skipped": n - n_made}
