"""Group reports: error rates, slices, transitions, overlaps, pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pixels import LOW_LEVEL_SLICES
from ..functions.values import error_type
from ..functions.tables import written
from .metrics import checked, histogram, histogram_metrics, percentiles, with_fnr


def _rate(part: Column, whole: Column) -> Column:
    return part / F.greatest(F.lit(1), whole).cast("double")


def error_counts(label: str = "label") -> list[Column]:
    return [
        F.count("*").alias("n_images"), F.count_if(F.col(label) == 0).alias("n_real"), F.count_if(F.col(label) != 0).alias("n_fake"),
        F.count_if(F.col("error_type") == "FP").alias("n_fp"), F.count_if(F.col("error_type") == "FN").alias("n_fn"),
    ]


def error_stats(joined: DataFrame, fields: Sequence[str], label: str = "label") -> DataFrame:
    """Error counts and rates overall and by each field: group_type, group_value, counts, fpr, fnr (6 digits)."""
    fields = list(fields)
    rows = joined.groupingSets([[], *([f] for f in fields)], *fields).agg(F.grouping_id().alias("set"), *error_counts(label))
    kind, value = F.lit("overall"), F.lit("all")
    for k, f in enumerate(fields):
        own = F.col("set").bitwiseAND(F.lit(1 << (len(fields) - 1 - k))) == 0
        kind, value = F.when(own, f).otherwise(kind), F.when(own, F.col(f).cast("string")).otherwise(value)
    rates = [F.round(_rate(F.col("n_fp"), F.col("n_real")), 6).alias("fpr"), F.round(_rate(F.col("n_fn"), F.col("n_fake")), 6).alias("fnr")]
    return rows.select(kind.alias("group_type"), value.alias("group_value"), "n_images", "n_real", "n_fake", "n_fp", "n_fn", *rates)


def worst(joined: DataFrame, k: int, score: str = "pred", tie: str = "image_path", keys: Sequence[str] = ()) -> DataFrame:
    """The k worst false positives (highest scores) and false negatives (lowest), with their place."""
    errors = joined.where(F.col("error_type").isin("FP", "FN"))
    badness = F.when(F.col("error_type") == "FP", -F.col(score)).otherwise(F.col(score))
    place = F.row_number().over(W.partitionBy(*keys, "error_type").orderBy(badness, F.col(tie)))
    return errors.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def slice_cube(df: DataFrame, features: Sequence[str], generator: str = "generator", score: str = "pred", label: str = "label") -> DataFrame:
    """feature, value, generator, score, pos and neg: rows of either label, for each feature value and for all rows (feature null)."""
    there = [f for f in features if f in df.columns]
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in there]
    cells = F.filter(F.array(*cells), lambda c: c["value"].isNotNull()) if cells else F.array().cast("array<struct<feature:string,value:string>>")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("feature"), F.lit(None).cast("string").alias("value")))
    named = F.lower(F.coalesce(F.nullif(F.col(generator), F.lit("")), F.lit("unknown"))).alias("generator")
    long = checked(df, score).select(named, F.col(score).alias("pred"), F.col(label).alias("label"), F.explode(F.concat(cells, whole)).alias("c"))
    return histogram(long.select("generator", "pred", "label", "c.feature", "c.value"), ["feature", "value", "generator"])


def slices(
    df: DataFrame, features: Sequence[str], threshold: float = 0.5, min_support: int = 20, min_generator_support: int = 20,
    generator: str = "generator", score: str = "pred", label: str = "label",
) -> DataFrame:
    """Metrics of every feature value against the whole, with two candidate flags.

    A value is a shortcut candidate if its share of positives and of negatives differ by
    0.15; a blind-spot candidate if fpr or fnr is 0.10 above the whole's, or if two
    generators have an fnr 0.05 above their own.  Features that df does not have have no values.

    Rows are read once: all that follows comes from one cube, which is written.
    """
    if min_support <= 0 or min_generator_support <= 0:
        raise ValueError("least supports must be positive")
    cube = written(slice_cube(df, features, generator, score, label), "cube")
    own = F.col("feature").isNotNull()
    summed = lambda rows, *keys: rows.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    whole = with_fnr(histogram_metrics(summed(cube.where(~own)), [], threshold)).select(*[F.col(c).alias(f"all_{c}") for c in ("n_real", "n_fake", "fpr", "fnr")])
    rows = with_fnr(histogram_metrics(summed(cube.where(own), "feature", "value"), ["feature", "value"], threshold)).where(F.col("n") >= min_support)
    # Misses of each generator by feature value, and by the whole (feature null).
    made = cube.where((F.col("pos") > 0) & ~F.col("generator").isin("real", "unknown"))
    missed = F.sum(F.when(F.col("score") < F.lit(float(threshold)), F.col("pos")).otherwise(0))
    made = made.groupBy("feature", "value", "generator").agg(F.sum("pos").alias("n"), missed.alias("m")).where(F.col("n") >= min_generator_support)
    base = made.where(~own).select("generator", (F.col("m") / F.col("n")).alias("base_fnr"))
    high = F.count_if(F.col("m") / F.col("n") >= F.col("base_fnr") + F.lit(0.05))
    found = made.where(own).join(base, "generator").groupBy("feature", "value").agg(F.count("*").alias("generator_count"), high.alias("high_fnr_generators"))
    rows = rows.join(found, ["feature", "value"], "left").fillna(0, ["generator_count", "high_fnr_generators"])
    rows = rows.crossJoin(F.broadcast(whole))  # one row
    null_if_zero = lambda c: F.nullif(F.col(c), F.lit(0)).cast("double")
    rows = rows.withColumns(
        {
            "real_prevalence": F.col("n_real") / null_if_zero("all_n_real"),
            "fake_prevalence": F.col("n_fake") / null_if_zero("all_n_fake"),
            "delta_fpr": F.when(F.col("n_real") > 0, F.col("fpr") - F.col("all_fpr")),
            "delta_fnr": F.when(F.col("n_fake") > 0, F.col("fnr") - F.col("all_fnr")),
        }
    ).withColumn("prevalence_gap", F.col("fake_prevalence") - F.col("real_prevalence"))
    at_least = lambda c, x: F.coalesce(F.col(c) >= F.lit(x), F.lit(False))
    return rows.withColumns(
        {
            "shortcut_candidate": F.coalesce(F.abs("prevalence_gap") >= F.lit(0.15), F.lit(False)),
            "blind_spot_candidate": at_least("delta_fpr", 0.10) | at_least("delta_fnr", 0.10) | (F.col("high_fnr_generators") >= 2),
        }
    ).drop("all_n_real", "all_n_fake", "all_fpr", "all_fnr")


def by_importance(rows: DataFrame) -> DataFrame:
    """Slices in the order of triage: candidates first, then by their largest deviation, then by size."""
    largest = F.greatest(*[F.abs(F.coalesce(F.col(c), F.lit(0.0))) for c in ("delta_fpr", "delta_fnr", "prevalence_gap")])
    return rows.orderBy(~F.col("blind_spot_candidate"), ~F.col("shortcut_candidate"), F.desc(largest), F.desc("n"), "feature", "value")


def transitions(base: DataFrame, new: DataFrame, key: str = "key", threshold: float = 0.5) -> DataFrame:
    """How errors change between two models on the keys both have: bucket, n."""
    old = error_type(F.col("old_pred"), F.col("label"), threshold)
    now = error_type(F.col("new_pred"), F.col("label"), threshold)
    rows = base.select(key, "label", F.col("pred").alias("old_pred")).join(new.select(key, F.col("pred").alias("new_pred")), key)
    rows = rows.select("label", old.alias("old"), now.alias("now"))
    bucket = F.lit("ok")
    for kind in ("FN", "FP"):
        was, is_ = F.col("old") == kind, F.col("now") == kind
        name = kind.lower()
        bucket = F.when(was & ~is_, f"{name}_fixed").when(was & is_, f"{name}_remain").when(~was & is_, f"{name}_new").otherwise(bucket)
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    columns = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r"))
    return picked.select(key, *[F.col(f"r.{c}").alias(c) for c in columns])


def error_overlap(errors: DataFrame, key: str = "key") -> DataFrame:
    """For each pair of models and error type: shared and united error keys, Jaccard similarity, shares."""
    own = errors.select("model", "error_type", key).distinct()
    sizes = own.groupBy("model", "error_type").agg(F.count("*").alias("size"))
    models = errors.select("model").distinct()
    kinds = errors.sparkSession.createDataFrame([("FP",), ("FN",)], "error_type string")
    pairs = models.toDF("left").join(models.toDF("right"), F.col("left") < F.col("right")).crossJoin(kinds)
    a, b = own.toDF("left", "error_type", key), own.toDF("right", "error_type", key)
    shared = a.join(b, ["error_type", key]).where(F.col("left") < F.col("right"))
    shared = shared.groupBy("left", "right", "error_type").agg(F.count("*").alias("intersection"))
    rows = pairs.join(shared, ["left", "right", "error_type"], "left")
    rows = rows.join(sizes.toDF("left", "error_type", "n_left"), ["left", "error_type"], "left")
    rows = rows.join(sizes.toDF("right", "error_type", "n_right"), ["right", "error_type"], "left").fillna(0)
    union = F.col("n_left") + F.col("n_right") - F.col("intersection")
    share = lambda n: F.when(F.col(n) > 0, F.col("intersection") / F.col(n)).otherwise(0.0)
    return rows.select(
        "left", "right", "error_type", "intersection", union.alias("union"),
        F.when(union > 0, F.col("intersection") / union).otherwise(1.0).alias("jaccard"),
        share("n_left").alias("share_of_left"), share("n_right").alias("share_of_right"),
    )


def error_summary(errors: DataFrame, totals: DataFrame) -> DataFrame:
    """Error counts, rates and score percentiles of each model; totals: model, n_real, n_fake."""
    out = totals
    both = ["model", "error_type"]
    counts = errors.groupBy(*both).agg(F.count("*").alias("n"))
    scores = percentiles(errors, "pred", both).select(*both, F.array("q0", "q25", "q50", "q75", "q100").alias("scores"))
    found = counts.join(scores, both)
    for kind in ("fp", "fn"):
        own = found.where(F.col("error_type") == kind.upper()).select("model", F.col("n").alias(kind), F.col("scores").alias(f"{kind}_scores"))
        out = out.join(own, "model", "left").fillna(0, [kind])
    n = F.col("n_real") + F.col("n_fake")
    wrong = (F.col("fp") > F.col("n_real")) | (F.col("fn") > F.col("n_fake"))
    fp = F.when(wrong, F.raise_error(F.lit("more errors than rows of that class")).cast("long")).otherwise(F.col("fp"))
    return out.withColumn("fp", fp).withColumns(
        {"fpr": F.col("fp") / F.col("n_real"), "fnr": F.col("fn") / F.col("n_fake"), "accuracy": 1 - (F.col("fp") + F.col("fn")) / n}
    )


def pair_ranking(rows: DataFrame, source: str = "source_id", role: str = "role", score: str = "pred", negative: str = "real") -> DataFrame:
    """How often each role's score is above that of the negative of the same source: role, n, hits, pair_acc, mean_delta.

    Rows without a source are in no pair; of a role that a source has twice, the highest score counts.
    """
    own = rows.where(F.col(source).isNotNull()).groupBy(source, role).agg(F.max(score).alias("s"))
    real = own.where(F.col(role) == negative).select(source, F.col("s").alias("real_s"))
    pairs = own.where(F.col(role) != negative).join(real, source)
    hit = F.count_if(F.col("s") > F.col("real_s"))
    return pairs.groupBy(role).agg(
        F.count("*").alias("n"), hit.alias("hits"), (hit / F.count("*")).alias("pair_acc"), F.avg(F.col("s") - F.col("real_s")).alias("mean_delta")
    )


def complete_sources(rows: DataFrame, roles: Sequence[str], source: str = "source_id", role: str = "role") -> DataFrame:
    """Sources that have every role; rows without a source are in none."""
    own = rows.where(F.col(source).isNotNull() & F.col(role).isin(*roles)).groupBy(source).agg(F.count_distinct(role).alias("n"))
    return own.where(F.col("n") == len(roles)).select(source)


def style_report(rows: DataFrame, flag: str = "stylized", score: str = "pred", threshold: float = 0.5) -> DataFrame:
    """Misses among positives: all, and by the flag."""
    kind = F.when(F.grouping(flag) == 1, "all_fake").when(F.col(flag), "stylized").otherwise("photoreal")
    missed = F.count_if(F.col(score) < F.lit(float(threshold)))
    out = rows.rollup(flag).agg(kind.alias("slice"), F.count("*").alias("n"), missed.alias("n_fn"))
    return out.select("slice", "n", "n_fn", (F.col("n_fn") / F.greatest(F.lit(1), F.col("n")).cast("double")).alias("fnr"))


def pivot_metrics(rows: DataFrame, conditions: Sequence[str], values: Sequence[str] = ("acc", "auroc")) -> DataFrame:
    """Models by conditions: one column for each condition and value."""
    return rows.groupBy("model").pivot("condition", list(conditions)).agg(*[F.max(v).alias(v) for v in values])


def slice_keys(columns: Sequence[str]) -> list[str]:
    """Columns that a slice report is made for: the low-level slices that are there, then the semantic ones in order, without their scores and margins."""
    semantic = sorted(c for c in set(columns) if c.startswith("semantic_") and not c.endswith(("_score", "_margin")))
    return [*LOW_LEVEL_SLICES, *semantic]
