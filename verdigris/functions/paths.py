"""Functions on slash-separated paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File name endings that count as images.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))


def path_order(path: Column) -> Column:
    """Sort key that orders paths folder by folder rather than as plain strings."""
    return F.split(path, "/")


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last ending with its dot, or an empty string; a leading dot begins no ending."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def without_suffix(path: Column) -> Column:
    ending = suffix(path)
    return F.when(ending == "", path).otherwise(F.left(path, F.length(path) - F.length(ending)))


def relative_to(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1))).otherwise(path)


def is_image(path: Column) -> Column:
    return F.lower(F.ltrim(suffix(path), F.lit("."))).isin(*IMAGE_SUFFIXES)


def label_from_folders(rel: Column, positives: Sequence[str] = (), default: int | None = None) -> Column:
    """1 if a folder is named fake (which wins) or like a known generator, 0 if real; else `default`."""
    folders = F.transform(F.slice(parts(rel), 1, F.greatest(F.size(parts(rel)) - 1, F.lit(0))), lambda p: F.lower(p))
    known = F.array(*[F.lit(p.lower()) for p in positives]) if positives else F.array().cast("array<string>")
    return (
        F.when(F.array_contains(folders, "fake"), 1)
        .when(F.array_contains(folders, "real"), 0)
        .when(F.arrays_overlap(folders, known), 1)
        .otherwise(F.lit(default).cast("int"))
    )


def _starts(prefix: str):
    return lambda p: F.startswith(p, F.lit(prefix))


def first_known_part(path: Column, known: Sequence[str], fallbacks: Sequence[tuple[str, str]] = (), default: str = "unknown") -> Column:
    """The first known name, in sorted order, that is a part of the path; then (prefix, name) fallbacks."""
    own = F.transform(parts(path), lambda p: F.lower(p))
    out = None
    for word in sorted(known):
        hit = F.array_contains(own, word.lower())
        out = F.when(hit, word) if out is None else out.when(hit, word)
    for prefix, word in fallbacks:
        hit = F.exists(own, _starts(prefix))
        out = F.when(hit, word) if out is None else out.when(hit, word)
    return F.lit(default) if out is None else out.otherwise(default)


def key_from_first_marker(path: Column, markers: Sequence[str]) -> Column:
    """The path from its first part that is a marker on; else its name."""
    own = F.split(path, "/")
    place = F.array_position(F.transform(own, lambda p: p.isin(*markers)), True)
    return F.when(place > 0, F.array_join(F.slice(own, place.cast("int"), F.size(own)), "/")).otherwise(name(path))


def key_by_marker_priority(path: Column, markers: Sequence[str]) -> Column:
    """The path from the first marker, in the markers' order, that is a part of it; else the whole path."""
    own = F.split(path, "/")
    out = None
    for m in markers:
        place = F.array_position(own, m)
        tail = F.array_join(F.slice(own, F.greatest(place, F.lit(1)).cast("int"), F.size(own)), "/")
        out = F.when(place > 0, tail) if out is None else out.when(place > 0, tail)
    return path if out is None else out.otherwise(path)


def split_role(stem: Column, roles: Sequence[str]) -> tuple[Column, Column]:
    """(source id, role) of names such as `17_roleA`: the longest role that ends the name; null role if none."""
    longest_first = sorted(roles, key=len, reverse=True)
    pattern = f"^(.*?)(?:_({'|'.join(longest_first)}))?$"
    role = F.regexp_extract(stem, pattern, 2)
    return F.regexp_extract(stem, pattern, 1), F.when(role == "", F.lit(None)).otherwise(role)


def hashed_path(root: str, key: Column, item: Column, ending: str) -> Column:
    """root/key/first two digits of the id/id.ending."""
    return F.concat(F.lit(root.rstrip("/") + "/"), key, F.lit("/"), F.left(item, F.lit(2)), F.lit("/"), item, F.lit(f".{ending}"))


def item_id(path: Column, size: Column) -> Column:
    return F.sha1(F.concat_ws(":", path, size.cast("string")))
