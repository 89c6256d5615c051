"""Strict records: unknown and missing fields, raw types, domain rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.values import content_type, file_format, generator_name

_RAW = {"int": "BIGINT", "bigint": "BIGINT", "string": "STRING"}


def parse_strict(lines: DataFrame, schema: T.StructType, required: Sequence[str], text: str = "value") -> DataFrame:
    """The record of each JSON line, and `errors`: why it is none (empty if it is one).

    A JSON true or 1.0 is not an integer, unknown fields are errors, blank lines are skipped.
    """
    rows = lines.where(F.trim(text) != "").withColumn("raw", F.try_parse_json(F.col(text)))
    kind = F.schema_of_variant("raw")
    is_object = F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))
    keys = F.json_object_keys(text)
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    unknown = F.array_sort(F.array_except(keys, names))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), keys))
    checks = [
        F.when(F.col("raw").isNull(), F.lit("not JSON")),
        F.when(F.col("raw").isNotNull() & ~is_object, F.lit("not an object")),
        F.when(is_object & (F.size(unknown) > 0), F.concat(F.lit("unknown fields "), F.array_join(unknown, ","))),
        F.when(is_object & (F.size(missing) > 0), F.concat(F.lit("missing fields "), F.array_join(missing, ","))),
    ]
    for f in schema.fields:
        wanted = _RAW.get(f.dataType.simpleString())
        if wanted:
            given = F.schema_of_variant(F.try_variant_get("raw", f"$.{f.name}", "variant"))
            fit = given.isNull() | given.isin(wanted, "VOID")
            checks.append(F.when(is_object & ~fit, F.lit(f"{f.name}: {wanted} expected")))
    errors = F.array_compact(F.array(*checks))
    return rows.withColumn("errors", errors).withColumn("record", F.from_json(text, schema)).drop("raw")


def normalized(rows: DataFrame) -> DataFrame:
    """Generator, format and content type in their normal form."""
    return rows.withColumns(
        {
            "generator": generator_name(F.col("generator")),
            "original_format": file_format(F.col("original_format")),
            "content_type": content_type(F.col("label"), F.col("content_type")),
        }
    )


def violations(rows: DataFrame) -> Column:
    """array<string>: the domain rules that a normalized row breaks."""
    has = set(rows.columns)
    c = F.col
    among = lambda name, values: c(name).isNotNull() & ~c(name).isin(*values)
    rules: list[tuple[Column, str]] = [
        (c("label").isNull() | ~c("label").isin(0, 1), "label must be 0 or 1"),
        (c("split").isNull() | ~c("split").isin(*S.SPLITS), "split is not known"),
        (c("path").isNull() | (c("path") == ""), "path is empty"),
        (c("width").isNull() | (c("width") < 1), "width must be positive"),
        (c("height").isNull() | (c("height") < 1), "height must be positive"),
        ((c("label") == 0) & c("generator").isNotNull(), "a real row has no generator"),
        (among("family", S.FAMILIES), "family is not known"),
        (among("arch", S.ARCHES), "arch is not known"),
        (among("generation_type", S.GENERATION_TYPES), "generation_type is not known"),
        (among("content_type", S.CONTENT_TYPES), "content_type is not known"),
        ((c("label") == 0) & F.coalesce("family", "arch", "generation_type").isNotNull(), "a real row has no family, arch or generation_type"),
        ((c("label") == 0) & (c("content_type") != "real"), "a real row's content_type is real"),
        ((c("label") == 1) & (c("content_type") == "real"), "a generated row's content_type is not real"),
        ((c("label") == 1) & (c("family") == "gan") & c("arch").isNotNull(), "gan has no arch"),
        (c("phash").isNotNull() & ~c("phash").rlike("^[0-9a-fA-F]{16}$"), "phash must be 16 hexadecimal digits"),
    ]
    if "transform_key" in has:
        rules += [
            (F.coalesce(F.size("params"), F.lit(0)) < 1, "params is empty"),
            (c("seed").isNull() | (c("seed") < 0), "seed must not be negative"),
        ]
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for bad, text in rules]))


def quarantined(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without violations, rows with them and their list)."""
    marked = normalized(rows)
    marked = marked.withColumn("violations", violations(marked))
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def insisted(rows: DataFrame) -> DataFrame:
    """The normalized rows; a violation is an error when the row is read."""
    marked = normalized(rows)
    found = violations(marked)
    message = F.concat_ws(": ", F.coalesce("path", F.lit("?")), F.array_join(found, "; "))
    return marked.withColumn("path", F.when(F.size(found) > 0, F.raise_error(message).cast("string")).otherwise(F.col("path")))


def trainable(rows: DataFrame) -> DataFrame:
    """Training rows that are not partial manipulations; a null content type may be trained on."""
    return rows.where((F.col("split") == "train") & ~F.col("content_type").eqNullSafe("partial_manipulation"))
