"""Row schemas and their domain rules."""

from __future__ import annotations

from pyspark.sql import types as T

#: The names that records may hold.
SPLITS = ("train", "val", "test", "unseen")
FAMILIES = ("gan", "diffusion")
GENERATION_TYPES = ("t2i", "i2i")
ARCHES = ("unet", "dit", "flow", "pixel")
CONTENT_TYPES = ("real", "full_synthetic", "partial_manipulation")

_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "map<string,double>": T.MapType(T.StringType(), T.DoubleType()),
}


def struct(text: str) -> T.StructType:
    """`name kind, name kind`; needs no session."""
    pairs = (field.split() for field in text.split(", "))
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


#: The fields of records, in order, and those that must be there.
SOURCE = struct(
    "image_id string, path string, label int, source_dataset string, generator string, split string, width int, height int, "
    "family string, arch string, generation_type string, content_type string, original_format string, phash string, source_id string"
)
TRANSFORM = struct(
    "row_id string, source_image_id string, source_path string, transform string, transform_key string, params map<string,double>, "
    "seed bigint, path string, label int, source_dataset string, generator string, split string, width int, height int, "
    "family string, arch string, generation_type string, content_type string, original_format string, phash string"
)
PREDICTION = struct("image_path string, pred double, y int, condition string, generator string, model string")
SOURCE_REQUIRED = ("image_id", "path", "label", "source_dataset", "split", "width", "height")
TRANSFORM_REQUIRED = (
    "row_id", "source_image_id", "source_path", "transform", "transform_key", "params", "seed", "path", "label", "source_dataset",
    "split", "width", "height",
)
