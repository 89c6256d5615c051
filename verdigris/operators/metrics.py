"""Metrics of binary scorers, computed from score histograms.

Rows are first reduced to one row for each (group, score), so that everything behind
the first aggregation sees distinct scores only.  Ranks are summed inside slots of the
score range and the slots' totals are added up, so that a single group is not ordered
by one task.

Slots are fixed for scores between 0 and 1.  For scores of any other range (logits,
margins, amounts), `score_cuts` takes them from a quantile sketch of the scores, so that
no slot has many more rows than another; results are the same with any cuts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOTS = 1024
#: Slots for a unit of the log odds, by which crowded scores near 0 and 1 are parted further.
ODDS = 16
#: Accuracy of the sketch that cuts come from: ranks are off by less than a thousandth of the rows.
SKETCH_K = 4096
#: The thresholds that each generator is looked at with.
GROUP_THRESHOLDS = (0.3, 0.4, 0.5, 0.6)
KEYS = ("n", "n_real", "n_fake", "threshold", "acc", "auroc", "precision_fake", "recall_fake", "fpr", "tp", "fp", "tn", "fn", "mean_pred")


def checked(df: DataFrame, score: str = "pred") -> DataFrame:
    """The rows; a null or NaN score is an error."""
    bad = F.col(score).isNull() | F.isnan(score)
    return df.withColumn(score, F.when(bad, F.raise_error(F.lit("a score is null or NaN")).cast("double")).otherwise(F.col(score)))


def histogram(df: DataFrame, keys: Sequence[str], score: str = "pred", label: str = "label") -> DataFrame:
    """keys, score, pos and neg: rows of either label with that score."""
    pos = F.count_if(F.col(label) == 1).alias("pos")
    neg = F.count_if(F.col(label) == 0).alias("neg")
    return df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(pos, neg)


def score_cuts(df: DataFrame, score: str = "pred", slots: int = SLOTS, k: int = SKETCH_K) -> list[float]:
    """Scores that part the rows into about equally many: at most slots - 1, from one sketch that tasks merge.

    One scan of the score column; what comes to the driver is as many numbers as slots.
    Equal cuts are one, so a score that many rows share is a slot of its own.
    """
    sketch = F.kll_sketch_agg_double(F.col(score).cast("double"), F.lit(k))
    at = F.array(*[F.lit(x / slots) for x in range(1, slots)])
    found = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).agg(F.count("*").alias("n"), sketch.alias("sketch"))
    row = found.select(F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", at)).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def _slot(cuts: Sequence[float] | None = None) -> Column:
    """A number that never falls as the score rises.  All scores of one slot meet in one task.

    Without cuts: the score's part of the range from 0 to 1, and inside that its log odds.
    With them: how many are not above the score, by bisection.
    """
    if cuts is not None:
        held, steps = F.array(*[F.lit(float(x)) for x in cuts]).cast("array<double>"), max(len(cuts), 1).bit_length()
        sizes = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
        beyond = lambda at: F.coalesce(F.get(held, at - 1) <= F.col("score"), F.lit(False))
        return F.aggregate(sizes, F.lit(0), lambda at, size: F.when(beyond(at + size), at + size).otherwise(at))
    p = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    odds = F.when(p <= 0, -40.0).when(p >= 1, 40.0).otherwise(F.least(F.greatest(F.ln(p / (F.lit(1.0) - p)), F.lit(-40.0)), F.lit(40.0)))
    return (F.floor(p * SLOTS) * (80 * ODDS + 1) + F.floor((odds + 40) * ODDS)).cast("int")


def negatives_below(hist: DataFrame, keys: Sequence[str], cuts: Sequence[float] | None = None) -> DataFrame:
    """hist with `below`: negatives of the group with a smaller score."""
    slotted = hist.withColumn("slot", _slot(cuts))
    inside = W.partitionBy(*keys, "slot").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    rows = slotted.withColumn("inside", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    slots = slotted.groupBy(*keys, "slot").agg(F.sum("neg").alias("slot_neg"))
    earlier = W.partitionBy(*(keys or [F.lit(0)])).orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    slots = slots.select(*keys, "slot", F.coalesce(F.sum("slot_neg").over(earlier), F.lit(0)).alias("earlier"))
    on = _same(rows, slots, [*keys, "slot"])
    return rows.join(slots, on).select(*[rows[c] for c in hist.columns], (rows["inside"] + slots["earlier"]).alias("below"))


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def auroc_of(pos: Column, neg: Column, below: Column) -> Column:
    """Mann-Whitney U over P * N, ties half; null if a class is empty."""
    u = F.sum(pos.cast("double") * below + F.lit(0.5) * pos * neg)
    return u / F.nullif(F.sum(pos).cast("double") * F.sum(neg), F.lit(0.0))


def auroc(df: DataFrame, keys: Sequence[str] = (), score: str = "pred", label: str = "label", cuts: Sequence[float] | None = None) -> DataFrame:
    """keys and auroc."""
    ranked = negatives_below(histogram(df, keys, score, label), keys, cuts)
    return ranked.groupBy(*keys).agg(auroc_of(F.col("pos"), F.col("neg"), F.col("below")).alias("auroc"))


def rates(threshold: float) -> list[Column]:
    """Metric columns from tp, fp, tn, fn, score_sum (and auroc), with denominators of 1 at least."""
    c = {k: F.col(k) for k in ("tp", "fp", "tn", "fn")}
    n, n_real, n_fake = c["tp"] + c["fp"] + c["tn"] + c["fn"], c["tn"] + c["fp"], c["tp"] + c["fn"]
    one = lambda x: F.greatest(F.lit(1), x).cast("double")
    return [
        n.alias("n"), n_real.alias("n_real"), n_fake.alias("n_fake"), F.lit(float(threshold)).alias("threshold"),
        ((c["tp"] + c["tn"]) / one(n)).alias("acc"), F.col("auroc"),
        (c["tp"] / one(c["tp"] + c["fp"])).alias("precision_fake"), (c["tp"] / one(n_fake)).alias("recall_fake"),
        (c["fp"] / one(n_real)).alias("fpr"), c["tp"], c["fp"], c["tn"], c["fn"], (F.col("score_sum") / one(n)).alias("mean_pred"),
    ]


def confusion(threshold: float) -> list[Column]:
    """Aggregates tp, fp, tn, fn and score_sum over a histogram."""
    hit = F.col("score") >= F.lit(float(threshold))
    add = lambda what, when: F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0))
    return [
        add("pos", hit).alias("tp"), add("neg", hit).alias("fp"), add("neg", ~hit).alias("tn"), add("pos", ~hit).alias("fn"),
        F.sum(F.col("score") * (F.col("pos") + F.col("neg"))).alias("score_sum"),
    ]


def binary_metrics(df: DataFrame, keys: Sequence[str] = (), score: str = "pred", label: str = "label", threshold: float = 0.5, cuts: Sequence[float] | None = None) -> DataFrame:
    """keys and all metrics, one row a group."""
    return histogram_metrics(histogram(checked(df, score), keys, score, label), keys, threshold, cuts)


def histogram_metrics(hist: DataFrame, keys: Sequence[str] = (), threshold: float = 0.5, cuts: Sequence[float] | None = None) -> DataFrame:
    """The same from a histogram (keys, score, pos, neg)."""
    ranked = negatives_below(hist, keys, cuts)
    rows = ranked.groupBy(*keys).agg(*confusion(threshold), auroc_of(F.col("pos"), F.col("neg"), F.col("below")).alias("auroc"))
    return rows.select(*keys, *rates(threshold))


def shared_negative_metrics(df: DataFrame, group: str, score: str = "pred", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Metrics of each group's positives against the negatives of all groups.

    The negatives are counted once and not copied to the groups: each positive score
    looks up how many negatives are below and beside it.
    """
    hist = histogram(checked(df, score), [group], score, label)
    every = hist.groupBy("score").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    ranked = negatives_below(every, []).select("score", F.col("neg").alias("beside"), "below")
    hit = F.col("score") >= F.lit(float(threshold))
    negatives = every.agg(
        F.sum("neg").alias("all_neg"), F.coalesce(F.sum(F.when(hit, F.col("neg"))), F.lit(0)).alias("fp"),
        F.sum(F.col("score") * F.col("neg")).alias("neg_sum"),
    )
    pos = hist.where("pos > 0").select(group, "score", "pos").join(ranked, "score")
    u = F.sum(F.col("pos").cast("double") * F.col("below") + F.lit(0.5) * F.col("pos") * F.col("beside"))
    rows = pos.groupBy(group).agg(
        u.alias("u"), F.sum("pos").alias("all_pos"), F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.col("score") * F.col("pos")).alias("pos_sum"),
    ).crossJoin(F.broadcast(negatives))  # fmt: skip  (one row)
    rows = rows.select(
        group, "tp", "fp", (F.col("all_neg") - F.col("fp")).alias("tn"), (F.col("all_pos") - F.col("tp")).alias("fn"),
        (F.col("pos_sum") + F.col("neg_sum")).alias("score_sum"),
        (F.col("u") / F.nullif(F.col("all_pos").cast("double") * F.col("all_neg"), F.lit(0.0))).alias("auroc"),
        (F.col("pos_sum") / F.col("all_pos")).alias("mean_pred_fake"),
    )
    return rows.select(group, *rates(threshold), "mean_pred_fake")


def with_fnr(rows: DataFrame) -> DataFrame:
    """Adds fnr, null where there are no positives."""
    return rows.withColumn("fnr", F.col("fn") / F.nullif(F.col("n_fake"), F.lit(0)).cast("double"))


def sweep(
    df: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = (), score: str = "pred", label: str = "label", cuts: Sequence[float] | None = None
) -> DataFrame:
    """Metrics at each threshold from one histogram; rows are not copied for the thresholds."""
    ranked = negatives_below(histogram(checked(df, score), keys, score, label), keys, cuts)
    sums = []
    for k, t in enumerate(thresholds):
        hit = F.col("score") >= F.lit(float(t))
        sums += [F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(f"{c}_{k}") for c in ("pos", "neg")]
    whole = [F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.sum(F.col("score") * (F.col("pos") + F.col("neg"))).alias("score_sum")]
    rows = ranked.groupBy(*keys).agg(*sums, *whole, auroc_of(F.col("pos"), F.col("neg"), F.col("below")).alias("auroc"))
    cells = [F.struct(F.lit(float(t)).alias("at"), F.col(f"pos_{k}").alias("tp"), F.col(f"neg_{k}").alias("fp")) for k, t in enumerate(thresholds)]
    rows = rows.select(*keys, "p", "q", "score_sum", "auroc", F.explode(F.array(*cells)).alias("c"))
    rows = rows.select(*keys, "score_sum", "auroc", "c.at", "c.tp", "c.fp", (F.col("q") - F.col("c.fp")).alias("tn"), (F.col("p") - F.col("c.tp")).alias("fn"))
    return rows.select(*keys, F.col("at"), *rates(0.0)).drop("threshold").withColumnRenamed("at", "threshold").withColumnRenamed("auroc", "auroc_fixed")


def sweep_by_group(
    df: DataFrame, group: str, thresholds: Sequence[float] = GROUP_THRESHOLDS, score: str = "pred", label: str = "label", cuts: Sequence[float] | None = None
) -> DataFrame:
    """Metrics of each group's positives against the negatives of all groups, at each threshold.

    One histogram: negatives are added up over the groups, once, and looked up by the
    positives' scores; neither negatives nor positives are copied for groups or thresholds.
    """
    hist = histogram(checked(df, score), [group], score, label)
    every = hist.groupBy("score").agg(F.sum("neg").alias("neg"))
    ranked = negatives_below(every, [], cuts).select("score", F.col("neg").alias("beside"), "below")
    over = lambda what, name: [F.sum(F.when(F.col("score") >= F.lit(float(t)), F.col(what)).otherwise(0)).alias(f"{name}_{k}") for k, t in enumerate(thresholds)]
    negatives = every.agg(*over("neg", "fp"), F.sum("neg").alias("q"), F.sum(F.col("score") * F.col("neg")).alias("neg_sum"))  # one row
    u = F.sum(F.col("pos").cast("double") * F.col("below") + F.lit(0.5) * F.col("pos") * F.col("beside"))
    pos = hist.where("pos > 0").select(group, "score", "pos").join(ranked, "score")
    rows = pos.groupBy(group).agg(*over("pos", "tp"), F.sum("pos").alias("p"), F.sum(F.col("score") * F.col("pos")).alias("pos_sum"), u.alias("u"))
    rows = rows.crossJoin(F.broadcast(negatives))
    cells = F.array(*[F.struct(F.lit(float(t)).alias("at"), F.col(f"tp_{k}").alias("tp"), F.col(f"fp_{k}").alias("fp")) for k, t in enumerate(thresholds)])
    area = F.col("u") / F.nullif(F.col("p").cast("double") * F.col("q"), F.lit(0.0))
    rows = rows.select(group, "p", "q", (F.col("pos_sum") + F.coalesce("neg_sum", F.lit(0.0))).alias("score_sum"), area.alias("auroc"), F.explode(cells).alias("c"))
    rows = rows.select(group, "score_sum", "auroc", "c.at", "c.tp", "c.fp", (F.col("q") - F.col("c.fp")).alias("tn"), (F.col("p") - F.col("c.tp")).alias("fn"))
    return rows.select(group, "at", *rates(0.0)).drop("threshold").withColumnRenamed("at", "threshold").withColumnRenamed("auroc", "auroc_fixed")


def composite(rows: DataFrame, conditions: Sequence[str], keys: Sequence[str] = (), clean: str = "clean", order: str | None = None) -> DataFrame:
    """Half the clean AUROC and half the mean of those of the other conditions that are there.

    With `order`, the last of repeated conditions counts.  Without any other condition
    the clean AUROC stands alone; without it the score is null.
    """
    value = F.max_by("auroc", order) if order else F.max("auroc")
    one = rows.groupBy(*keys, "condition").agg(value.alias("auroc"))
    other = F.col("condition").isin(*conditions)
    out = one.groupBy(*keys).agg(
        F.max(F.when(F.col("condition") == clean, F.col("auroc"))).alias("auc_clean"),
        F.avg(F.when(other, F.col("auroc"))).alias("auc_robust"),
        F.count(F.when(other, F.col("auroc"))).alias("n_robust"),
    )
    half = F.lit(0.5) * F.col("auc_clean") + F.lit(0.5) * F.col("auc_robust")
    return out.withColumn("complete", F.col("auc_clean").isNotNull() & (F.col("n_robust") == len(conditions))).withColumn(
        "formula", F.when(F.col("n_robust") == 0, F.col("auc_clean")).otherwise(half)
    )


def percentiles(df: DataFrame, value: str, keys: Sequence[str] = (), at: Sequence[float] = (0, 0.25, 0.5, 0.75, 1), cuts: Sequence[float] | None = None) -> DataFrame:
    """Linearly interpolated percentiles q0, q25, ... of scores; nulls do not count, and a group without values has null.

    Exact, from counts of different values and their ranks: no task holds a whole group.
    """
    hist = df.groupBy(*keys, F.col(value).cast("double").alias("score")).agg(F.count(value).alias("neg"))
    ranked = negatives_below(hist, keys, cuts)
    sizes = hist.groupBy(*keys).agg(F.sum("neg").alias("size"))
    rows = ranked.join(sizes, _same(ranked, sizes, keys)).select(*[ranked[c] for c in ranked.columns], sizes["size"])
    holds = lambda place: F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("neg")), F.col("score")))
    found = []
    for k, q in enumerate(at):
        place = F.lit(float(q)) * (F.col("size") - 1)
        found += [holds(F.floor(place)).alias(f"low_{k}"), holds(F.ceil(place)).alias(f"high_{k}"), F.max(place - F.floor(place)).alias(f"part_{k}")]
    low, high, part = ([F.col(f"{n}_{k}") for k in range(len(at))] for n in ("low", "high", "part"))
    between = [F.when(low[k] == high[k], low[k]).otherwise((1 - part[k]) * low[k] + part[k] * high[k]) for k in range(len(at))]
    return rows.groupBy(*keys).agg(*found).select(*keys, *[between[k].alias(f"q{round(100 * q)}") for k, q in enumerate(at)])


def score_predictions(preds: DataFrame, labels: DataFrame, key: str = "key", threshold: float = 0.5, max_errors: int = 50) -> tuple[DataFrame, DataFrame]:
    """Metrics of predictions against labels with the number that no label matches, and the worst errors of each kind.

    preds: key, image_path, pred; labels: key, y, one row a key.  Predictions without a label
    count as unmatched only; where none has a label, asking for the metrics is an error.
    """
    from ..functions.values import error_type
    from .groups import worst

    rows = preds.join(labels.select(key, F.col("y").alias("label")), key, "left")
    # One histogram: a prediction without a label is in it as neither, and is counted as such.
    unlabelled = F.count_if(F.col("label").isNull()).alias("lost")
    pos, neg = F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    hist = checked(rows).groupBy(F.when(F.col("label").isNotNull(), F.col("pred").cast("double")).alias("score")).agg(pos, neg, unlabelled)
    ranked = negatives_below(hist, [])
    none = F.raise_error(F.lit("no prediction has a label")).cast("long")
    found = ranked.agg(
        *confusion(threshold), auroc_of(F.col("pos"), F.col("neg"), F.col("below")).alias("auroc"), F.sum("lost").alias("unmatched"), F.sum(F.col("pos") + F.col("neg")).alias("known"),
    )
    told = F.when(F.coalesce("known", F.lit(0)) == 0, none).otherwise(F.col("unmatched")).alias("unmatched")
    named = rows.where(F.col("label").isNotNull()).withColumn("error_type", error_type(F.col("pred"), F.col("label"), threshold))
    return found.select(*rates(threshold), told), worst(named, max_errors).select("error_type", "place", "image_path", "pred", F.col("label").alias("y"))
