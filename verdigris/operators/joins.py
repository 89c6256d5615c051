"""Joins on path keys, hashes and pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import without_suffix
from ..functions.tables import written
from ..functions.values import error_type, filled, hamming


def label_index(labels: DataFrame, rel: str, label: str, order: str) -> DataFrame:
    """key, y: each row under its path with and without its ending; the last row of a key counts.

    `n_labels` above 1 shows that different labels met in a key.
    """
    keys = F.explode(F.array_distinct(F.array(F.col(rel), without_suffix(F.col(rel)))))
    rows = labels.select(keys.alias("key"), F.col(label).alias("y"), F.col(order).alias("at"))
    return rows.groupBy("key").agg(F.max_by("y", "at").alias("y"), F.count_distinct("y").alias("n_labels"))


def by_first_match(rows: DataFrame, index: DataFrame, candidates: Sequence[Column], how: str = "inner") -> DataFrame:
    """rows (with a unique `row_id`) joined to index (key, y) by the first candidate key that is there."""
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), c.alias("key")) for k, c in enumerate(candidates)]))
    tried = rows.select("row_id", keys.alias("t")).select("row_id", "t.rank", "t.key")
    hit = tried.join(index.select("key", "y"), "key").groupBy("row_id").agg(F.min_by("y", "rank").alias("y"))
    return rows.join(hit, "row_id", how)


def unmatched(rows: DataFrame, index: DataFrame, candidates: Sequence[Column]) -> DataFrame:
    """Rows that no candidate finds."""
    keys = rows.select("row_id", F.explode(F.array(*candidates)).alias("key"))
    return rows.join(keys.join(index.select("key"), "key", "left_semi"), "row_id", "left_anti")


def with_metadata(scored: DataFrame, metadata: DataFrame, key: str, order: str, fields: Mapping[str, str], threshold: float = 0.5) -> DataFrame:
    """Scored rows (pred, label) with metadata of the same key, the first row of a key first.

    Missing or empty fields get their defaults; rows with label 0 get the generator `real`.
    """
    first = metadata.groupBy(key).agg(F.min_by(F.struct(*fields), order).alias("m"))
    rows = scored.join(first, key, "left")
    out = {f: filled(F.col(f"m.{f}"), default) for f, default in fields.items()}
    if "generator" in out:
        out["generator"] = filled(F.col("m.generator"), "unknown")
        out["generator"] = F.when((F.col("label") == 0) & (out["generator"] == "unknown"), "real").otherwise(out["generator"])
    return rows.withColumns(out | {"error_type": error_type(F.col("pred"), F.col("label"), threshold)}).drop("m")


def equal_hashes(a: DataFrame, b: DataFrame, ident: str = "image_id", digest: str = "phash") -> DataFrame:
    """id_a, id_b of rows with one hash; null hashes match nothing."""
    left = a.where(F.col(digest).isNotNull()).select(F.col(ident).alias("id_a"), F.col(digest).alias("h"))
    right = b.where(F.col(digest).isNotNull()).select(F.col(ident).alias("id_b"), F.col(digest).alias("h"))
    return left.join(right, "h").select("id_a", "id_b").distinct()


#: Pairs that one band's value may make before it is cut again.
HOT_PAIRS = 1_000_000
#: How often at most: after that, what is left agrees in nearly all bits.
CUTS = 4


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bands(positions: Sequence[int], bands: int) -> list[list[int]]:
    """The positions in `bands` runs of about equally many."""
    ends = [len(positions) * k // bands for k in range(bands + 1)]
    return [list(positions[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]


def near_hashes(a: DataFrame, b: DataFrame, distance: int, ident: str = "id", digest: str = "hash", hot: int = HOT_PAIRS) -> DataFrame:
    """id_a, id_b, distance of 64-bit hashes (long) that differ in at most `distance` bits.

    64 bits are cut into distance + 1 bands; two hashes within the distance agree in one
    band at least, so the pairs are found by an equi-join and then checked.  A pair is made
    by its first agreeing band only.  A band's value that would make more than `hot` pairs
    is hot: the bits that its hashes have besides are cut into distance + 1 bands again,
    and the pairs agree in one of these too.  Equal hashes stay together, whatever is cut:
    they are pairs.
    """
    side = lambda df, x: df.where(F.col(digest).isNotNull()).select(F.col(ident).alias(f"id_{x}"), F.col(digest).cast("long").alias(f"hash_{x}")).distinct()
    rows = {x: side(df, x).withColumn("node", F.lit(0)) for x, df in (("a", a), ("b", b))}
    # Of each way that bands were taken: bits not used, bits that agree, and bands before those taken, in which pairs differ.
    nodes: dict[int, tuple[list[int], int, list[int]]] = {0: (list(range(64)), 0, [])}
    key, out = ["node", "band", "bits"], None
    for k in range(CUTS):
        table, further = [], {}
        for node, (free, agreed, before) in nodes.items():
            masks = [sum(1 << p for p in band) for band in _bands(free, distance + 1)]
            for band, mask in enumerate(masks):
                child, earlier = node * (distance + 1) + band, before + masks[:band]
                table.append((node, band, child, _signed(agreed | mask), [_signed(m) for m in earlier]))
                further[child] = ([p for p in free if not mask >> p & 1], agreed | mask, earlier)
        dims = F.broadcast(a.sparkSession.createDataFrame(table, "node int, band int, child int, mask long, before array<long>"))
        cut = {x: r.join(dims, "node").withColumn("bits", F.col(f"hash_{x}").bitwiseAND(F.col("mask"))) for x, r in rows.items()}
        last = k == CUTS - 1
        heavy = None
        if not last:
            sizes = [c.groupBy(*key).agg(F.count("*").alias(f"n_{x}")) for x, c in cut.items()]
            heavy = written(sizes[0].join(sizes[1], key).where(F.col("n_a") * F.col("n_b") > hot).select(*key), "hot")
            last = heavy.isEmpty()
        light = cut if last else {x: c.join(heavy, key, "left_anti") for x, c in cut.items()}
        pairs = light["a"].join(light["b"].drop("mask", "before", "child"), key)
        apart = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
        pairs = pairs.where(F.forall("before", lambda m: apart.bitwiseAND(m) != 0))
        found = pairs.select("id_a", "id_b", hamming(F.col("hash_a"), F.col("hash_b")).alias("distance")).where(F.col("distance") <= distance)
        out = found if out is None else out.unionByName(found)
        if last:
            break
        rows = {x: c.join(heavy, key, "left_semi").select(f"id_{x}", f"hash_{x}", F.col("child").alias("node")) for x, c in cut.items()}
        nodes = further
    return out


def without_overlap(rows: DataFrame, held: DataFrame, name: Column, held_name: str, path: Column | None = None, parts: Sequence[str] = ()) -> DataFrame:
    """rows whose name no held-out row has and whose path has none of the parts in it; rows without a name stay."""
    for part in parts:
        rows = rows.where(~F.coalesce(path.contains(part), F.lit(False)))
    names = held.select(F.col(held_name).alias("_held")).where(F.col("_held").isNotNull()).distinct()
    return rows.withColumn("_name", name).join(names, F.col("_name") == F.col("_held"), "left_anti").drop("_name")


def without_leaks(train: DataFrame, leaks: DataFrame, ident: str = "image_id") -> DataFrame:
    """Training rows that no leak (id_a) names."""
    return train.join(leaks.select(F.col("id_a").alias(ident)).distinct(), ident, "left_anti")


def times_settings(rows: DataFrame, settings: DataFrame, first: int | None = None, order: str | None = None) -> DataFrame:
    """Each row with each setting; with `first`, the first so many rows of the order only.  settings is a small dimension."""
    if first is not None:
        rows = rows.orderBy(order).limit(first)
    return rows.crossJoin(F.broadcast(settings))


def times_views(rows: DataFrame, views: Sequence[str]) -> DataFrame:
    return rows.withColumn("view", F.explode(F.array(*[F.lit(v) for v in views])))


def attached(rows: DataFrame, cache: DataFrame, key: str, version: int, model: str | None = None, model_column: str = "semantic_model") -> tuple[DataFrame, DataFrame]:
    """(rows with the cached features of this version, rows that have none yet); with `model`, only features of that model count."""
    own = cache.where(F.col("feature_version") == version)
    if model is not None:
        own = own.where(F.col(model_column) == model)
    own = own.drop("feature_version").dropDuplicates([key])
    return rows.join(own, key), rows.join(own.select(key), key, "left_anti")
