"""Seeded samples, caps, first-of-key picks and unions of pools.

A sample takes rows in the order of sha1(seed | id): the same rows on any cluster and
any partitioning.  Picks of a few per group rank inside the group, of which each task
keeps its own first.  Larger picks count the digests by their leading digits: the group's
n-th digest is found among those that share its digits, and all rows up to it are kept by
a filter, so that no group is ever ordered and no row moves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def draw(seed: int | str, ident: str) -> Column:
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(ident).cast("string")))


def first_per(df: DataFrame, keys: Sequence[str], n: int | Column, *order: Column) -> DataFrame:
    """The first n rows of each group in the given order."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


#: Picks of at most so many rows a group rank them: Spark keeps so many a task before it shuffles them.
FEW = 1000
#: Hexadecimal digits that one count parts a group by, and digests that one task may order.
DIGITS, LEAF = 4, 2_000_000
#: Groups whose limits are broadcast; those of more groups are met in a shuffle.
MAX_GROUPS = 100_000


def _small(df: DataFrame) -> tuple[DataFrame, bool]:
    """df as a local table, and True, if it has at most MAX_GROUPS rows."""
    got = df.limit(MAX_GROUPS + 1).toArrow()
    return (df, False) if got.num_rows > MAX_GROUPS else (df.sparkSession.createDataFrame(got, df.schema), True)


def _met(rows: DataFrame, limits: DataFrame, keys: Sequence[str], few: bool, how: str = "inner") -> DataFrame:
    """rows with the limits of their group (null keys are a group); `limits` are named by `_key0`, `_key1`, ..."""
    on = F.lit(True)
    for k, key in enumerate(keys):
        on = on & rows[key].eqNullSafe(limits[f"_key{k}"])
    return rows.join(F.broadcast(limits) if few else limits, on, how).drop(*[f"_key{k}" for k in range(len(keys))])


def cuts(df: DataFrame, keys: Sequence[str], n: int, seed: int | str, ident: str, digits: int = DIGITS, leaf: int = LEAF) -> tuple[DataFrame, bool]:
    """The n-th digest (`_at`) of each group with more than n rows, how many rows have it (`_ties`) and how many of them are among the n (`_allowed`); and whether it is a local table.

    Groups' digests are counted by their first `digits`, then, where more than `leaf` share
    those of the n-th, by twice as many among them, and so on; only those that are left are ordered.
    """
    own, named = ([f"{x}{k}" for k in range(len(keys))] for x in ("_own", "_key"))
    whole = W.partitionBy(*(own or [F.lit(0)]))
    every = df.select(*[F.col(k).alias(a) for k, a in zip(keys, own, strict=True)], draw(seed, ident).alias("_digest"))
    rows, width = every.withColumn("_need", F.lit(n).cast("long")), digits
    while True:
        parts = rows.groupBy(*own, "_need", F.substring("_digest", 1, width).alias("_prefix")).agg(F.count("*").alias("_rows"))
        # At most 16 ** digits rows a group.
        reach = F.sum("_rows").over(whole.orderBy("_prefix").rowsBetween(W.unboundedPreceding, 0))
        parts = parts.withColumn("_reach", reach).where((F.col("_reach") >= F.col("_need")) & (F.col("_reach") - F.col("_rows") < F.col("_need")))
        found, few = _small(parts.select(*own, "_prefix", (F.col("_need") - F.col("_reach") + F.col("_rows")).alias("_need"), "_rows").toDF(*named, "_prefix", "_need", "_rows"))
        rows = _met(every, found, own, few).where(F.substring("_digest", 1, width) == F.col("_prefix")).select(*own, "_digest", "_need")
        if width >= 40 or (found.agg(F.max("_rows")).first()[0] or 0) <= leaf:
            break
        width = min(40, width + digits)
    order = whole.orderBy("_digest")
    ranked = rows.withColumns({"_place": F.row_number().over(order), "_first": F.rank().over(order), "_ties": F.count("*").over(order.rangeBetween(W.currentRow, W.currentRow))})
    at = ranked.where(F.col("_place") == F.col("_need"))
    # The n-th row itself need not be the first of equal digests.
    return _small(at.select(*own, F.col("_digest").alias("_at"), "_ties", (F.col("_need") - F.col("_first") + 1).alias("_allowed")).toDF(*named, "_at", "_ties", "_allowed"))


def smallest(df: DataFrame, keys: Sequence[str], n: int, seed: int | str, ident: str, digits: int = DIGITS, leaf: int = LEAF) -> DataFrame:
    """The first n rows of each group in the order of the draw, for any n and groups of any size.

    Rows that share an id share a draw; of those that the n-th draw has, as many as are needed
    are taken.  Groups of at most n rows are taken whole.
    """
    if n <= 0:
        return df.limit(0)
    limits, few = cuts(df, keys, n, seed, ident, digits, leaf)
    met = _met(df.withColumn("_digest", draw(seed, ident)), limits, keys, few, "left")
    if limits.where("_allowed < _ties").isEmpty():
        return met.where(F.col("_at").isNull() | (F.col("_digest") <= F.col("_at"))).select(df.columns)
    out = met.where(F.col("_at").isNull() | (F.col("_digest") < F.col("_at")))
    equal = met.where(F.col("_digest") == F.col("_at"))
    place = F.row_number().over(W.partitionBy(*keys, "_digest").orderBy("_digest"))
    return out.select(df.columns).unionByName(equal.withColumn("_place", place).where("_place <= _allowed").select(df.columns))


def seeded(df: DataFrame, keys: Sequence[str], n: int, seed: int | str, ident: str) -> DataFrame:
    """The first n rows of each group in the order of the draw: ranked if n is small, else by `smallest`."""
    if n > FEW:
        return smallest(df, keys, n, seed, ident)
    return first_per(df, keys, n, draw(seed, ident), F.col(ident))


def sample(df: DataFrame, n: int, seed: int | str, ident: str) -> DataFrame:
    """n rows, or all: each task keeps its own first n if these are few, so nothing is ordered as a whole."""
    return smallest(df, [], n, seed, ident) if n > FEW else df.orderBy(draw(seed, ident), ident).limit(n)


def balanced(df: DataFrame, n: int, seed: int | str, ident: str, label: str = "y") -> DataFrame:
    """n // 2 rows of each label, 1 at least (all of a smaller one); with one label only, n of it."""
    labels = df.agg(F.count_distinct(label)).first()[0]
    if labels < 2:
        return sample(df, n, seed, ident)
    return seeded(df, [label], max(1, n // 2), seed, ident)


def capped_positives(df: DataFrame, group: str, cap: int, seed: int | str, ident: str, label: str = "y") -> DataFrame:
    """At most `cap` positives of each group; all negatives."""
    pos = seeded(df.where(F.col(label) == 1), [group], cap, seed, ident)
    return pos.unionByName(df.where(F.col(label) == 0))


def among_generators(df: DataFrame, allowed: Sequence[str], group: str = "generator", label: str = "y") -> DataFrame:
    """Negatives, and positives of the allowed generators; a generator that does not occur is an error."""
    found = {r[0] for r in df.where((F.col(label) == 1) & F.col(group).isin(*allowed)).select(group).distinct().collect()}
    if missing := sorted(set(allowed) - found):
        raise ValueError(f"unknown generators: {', '.join(missing)}")
    return df.where((F.col(label) == 0) | F.col(group).isin(*allowed))


def matching(df: DataFrame, spec: Mapping) -> DataFrame:
    """Rows of a pool: a label, lists that columns must be in (null is in none) and content types that they must not have."""
    out = df.where(F.col("label") == spec["label"]) if "label" in spec else df
    for field in ("family", "arch", "generation_type", "generator", "source_dataset", "content_type"):
        if field in spec:
            out = out.where(F.col(field).isin(*spec[field]))
    if "exclude_content_type" in spec:
        out = out.where(~F.coalesce(F.col("content_type").isin(*spec["exclude_content_type"]), F.lit(False)))
    return out


def pools(df: DataFrame, specs: Mapping[str, Mapping], seed: int | str, ident: str = "image_id") -> DataFrame:
    """The union of samples of pools; each spec has `n`.  Too few rows, or no pool at all, is an error."""
    if not specs:
        raise ValueError("no pools are given")
    out = None
    for name, spec in specs.items():
        own = sample(matching(df, spec), spec["n"], f"{seed}/{name}", ident).withColumn("pool", F.lit(name))
        if (have := own.count()) < spec["n"]:
            raise ValueError(f"pool {name}: {spec['n']} rows are needed, {have} are there")
        out = own if out is None else out.unionByName(own)
    return out


def taken(df: DataFrame, n: int | None, seed: int | str, ident: str) -> DataFrame:
    """All rows, or a sample of n."""
    return df if n is None else sample(df, n, seed, ident)


def replaced(base: DataFrame, extra: DataFrame, seed: int | str, ident: str, label: str = "y") -> DataFrame:
    """base with as many positives gone as extra has (all at most), and extra added; negatives stay."""
    gone = extra.where(F.col(label) == 1).count()
    pos = base.where(F.col(label) == 1)
    left = pos.join(sample(pos.select(ident), gone, seed, ident), ident, "left_anti")
    return left.unionByName(base.where(F.col(label) == 0)).unionByName(extra)


def first_of_name(df: DataFrame, name: Column, *order: Column) -> DataFrame:
    """One row for each lower-cased name: the first in the order."""
    return first_per(df.withColumn("_name", F.lower(name)), ["_name"], 1, *order).drop("_name")


def united(sources: Sequence[DataFrame], name: Column, *order: Column) -> DataFrame:
    """Sources one after the other, each name from the first source that has it."""
    out = None
    for k, df in enumerate(sources):
        own = df.withColumn("_source", F.lit(k))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return first_of_name(out, name, F.col("_source"), *order).drop("_source")


def added(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """base, and the rows of extra whose key it does not have."""
    return base.unionByName(extra.join(base.select(key).distinct(), key, "left_anti").select(base.columns))


def labelled_union(positives: DataFrame, negatives: DataFrame, label: str = "y") -> DataFrame:
    """Positives as 1 and negatives as 0; an empty side is an error."""
    for what, df in (("positives", positives), ("negatives", negatives)):
        if df.isEmpty():
            raise ValueError(f"no {what}")
    return positives.withColumn(label, F.lit(1)).unionByName(negatives.withColumn(label, F.lit(0)))


def counted(df: DataFrame, keys: Sequence[str], least: Mapping[str, int] | None = None) -> DataFrame:
    """Rows of each group; a group below its least number is an error."""
    rows = df.groupBy(*keys).agg(F.count("*").alias("n"))
    for value, n in (least or {}).items():
        have = rows.where(F.col(keys[0]) == value).agg(F.sum("n")).first()[0] or 0
        if have < n:
            raise ValueError(f"{value}: {n} rows are needed, {have} are there")
    return rows
