"""Scalar functions: normalisers, buckets, error types, hashes, seeds, score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALIASES = {"jpeg": "jpg", "tiff": "tif"}
SEED_SALT = "v2"


def filled(text: Column, default: str) -> Column:
    """The default in place of null and of an empty string."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def generator_name(generator: Column) -> Column:
    """Null in place of an empty name and of `real`."""
    return F.when(generator.isin("", "real"), F.lit(None)).otherwise(generator)


def file_format(value: Column) -> Column:
    bare = F.ltrim(F.lower(F.trim(value)), F.lit("."))
    out = F.when(bare == "", F.lit(None))
    for long, short in _ALIASES.items():
        out = out.when(bare == long, short)
    return out.otherwise(bare)


def content_type(label: Column, value: Column) -> Column:
    return F.coalesce(value, F.when(label == 0, "real").otherwise("full_synthetic"))


def error_type(pred: Column, label: Column, threshold: float = 0.5) -> Column:
    """TP, FP, TN or FN; at the threshold a score is positive, and NaN never is."""
    positive = (pred >= F.lit(float(threshold))) & ~F.isnan(pred)
    return F.when(positive & (label == 1), "TP").when(positive, "FP").when(label == 0, "TN").otherwise("FN")


def bucket3(value: Column, low: float, high: float, names: tuple[str, str, str]) -> Column:
    return F.when(value < F.lit(float(low)), names[0]).when(value > F.lit(float(high)), names[2]).otherwise(names[1])


def seed56(item: Column, key: Column) -> Column:
    """A seed below 2**56 for an item and a setting, the same everywhere."""
    digest = F.sha1(F.concat_ws("|", item, key, F.lit(SEED_SALT)))
    return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")


def hash_long(hex16: Column) -> Column:
    """16 hexadecimal digits as a signed long."""
    return F.conv(hex16, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def scaled_side(side: Column, keep: float) -> Column:
    """A side after scaling, rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(side.cast("double") * F.lit(float(keep)), 0).cast("int"))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column, margin: float = 1e-7) -> Column:
    inside = F.least(F.greatest(p, F.lit(margin)), F.lit(1 - margin))
    return F.ln(inside / (F.lit(1.0) - inside))


def fused(p: Column, q: Column, weight: float = 0.5) -> Column:
    """Two probabilities mixed on the logit scale."""
    return sigmoid(F.lit(weight) * logit(p) + F.lit(1 - weight) * logit(q))


def text_or_empty(value: Column, digits: int = 4) -> Column:
    return F.when(value.isNull(), "").otherwise(F.format_string(f"%.{digits}f", value))


def entropy(counts: Column) -> Column:
    """Shannon entropy (bits) of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
