"""Queries that evaluate scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import key_from_first_marker
from ..functions.values import bucket3, error_type
from ..operators import groups, metrics
from ..sources.sinks import METRIC_COLUMNS, metric_texts
from .registry import query, rounded, table
from .views import CONDITIONS, PRED, SALES, metric_sql, predictions, sales


@query(f"WITH {PRED} {metric_sql('pred', 'condition')}")
def auroc_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship."""
    return rounded(metrics.binary_metrics(predictions(spark, sf_dir), ["condition"]))


@query(f"WITH {SALES} {metric_sql('sales')}")
def overall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2 over many equal scores."""
    return rounded(metrics.binary_metrics(sales(spark, sf_dir)))


@query(f"WITH {SALES} {metric_sql('sales', 'generator, condition')}")
def robustness_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generator x condition."""
    return rounded(metrics.binary_metrics(sales(spark, sf_dir), ["generator", "condition"]))


@query(f"WITH {SALES} SELECT count(*) AS n, count_if(label = 0) AS n_real, count_if(label = 1) AS n_fake FROM sales")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23."""
    return sales(spark, sf_dir).agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("n_real"), F.count_if(F.col("label") == 1).alias("n_fake")
    )


def _shared(rows: str) -> str:
    return f"""
, pairs AS (SELECT g.generator, s.pred, s.label FROM (SELECT DISTINCT generator FROM {rows} WHERE label = 1) g
            JOIN {rows} s ON s.label = 0 OR s.generator = g.generator)
{metric_sql('pairs', 'generator', extra='round(avg(CASE WHEN label = 1 THEN pred END), 8) AS mean_pred_fake, ')}"""


@query(f"WITH {PRED} {_shared('pred')}")
def shared_negatives_by_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every generator's positives against all negatives."""
    return rounded(metrics.shared_negative_metrics(predictions(spark, sf_dir), "generator"))


@query(f"WITH {SALES} {_shared('sales')}")
def shared_negatives_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, A7 on many rows."""
    return rounded(metrics.shared_negative_metrics(sales(spark, sf_dir), "generator"))


@query(
    f"""WITH {PRED}, m AS ({metric_sql("pred", "condition")})
SELECT condition, n, n_real, n_fake, acc, auroc, fpr, round(fn / nullif(n_fake, 0)::DOUBLE, 8) AS fnr FROM m"""
)
def group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By condition, with a nullable fnr."""
    rows = metrics.with_fnr(metrics.binary_metrics(predictions(spark, sf_dir), ["condition"]))
    return rounded(rows.select("condition", "n", "n_real", "n_fake", "acc", "auroc", "fpr", "fnr"))


@query(
    f"""WITH {PRED}, m AS ({metric_sql("pred", "condition")}),
f AS (SELECT max(CASE WHEN condition = 'en' THEN auroc END) AS auc_clean, avg(CASE WHEN condition IN {CONDITIONS} THEN auroc END) AS auc_robust,
             count(CASE WHEN condition IN {CONDITIONS} THEN auroc END) AS n_robust FROM m)
SELECT round(auc_clean, 6) AS auc_clean, round(auc_robust, 6) AS auc_robust, n_robust, auc_clean IS NOT NULL AND n_robust = 3 AS complete,
       round(CASE WHEN n_robust = 0 THEN auc_clean ELSE 0.5::DOUBLE * auc_clean + 0.5::DOUBLE * auc_robust END, 6) AS formula FROM f"""
)
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: half clean, half the mean of the other conditions."""
    rows = metrics.binary_metrics(predictions(spark, sf_dir), ["condition"])
    return rounded(metrics.composite(rounded(rows), CONDITIONS, clean="en"), 6)


_THRESHOLDS = [round(0.05 * k, 2) for k in range(1, 20)]
_SWEEP_SQL = f"""WITH {SALES}, base AS (
  SELECT (sum(CASE WHEN label = 1 THEN r - (eq - 1) / 2.0::DOUBLE END) - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0::DOUBLE)
         / nullif(count_if(label = 1)::DOUBLE * count_if(label = 0), 0) AS auroc
  FROM (SELECT *, count(*) OVER (ORDER BY pred RANGE UNBOUNDED PRECEDING)::DOUBLE AS r, count(*) OVER (PARTITION BY pred) AS eq FROM sales)),
t AS (SELECT unnest({_THRESHOLDS}::DOUBLE[]) AS threshold),
c AS (SELECT threshold, count(*) AS n, count_if(label = 0) AS n_real, count_if(label = 1) AS n_fake, count_if(pred >= threshold AND label = 1) AS tp,
             count_if(pred >= threshold AND label = 0) AS fp, count_if(pred < threshold AND label = 0) AS tn, count_if(pred < threshold AND label = 1) AS fn,
             sum(pred) AS s FROM sales, t GROUP BY threshold)
SELECT threshold, n, n_real, n_fake, round((tp + tn) / n::DOUBLE, 8) AS acc, round(auroc, 8) AS auroc_fixed, round(tp / greatest(1, tp + fp)::DOUBLE, 8) AS precision_fake,
       round(tp / greatest(1, n_fake)::DOUBLE, 8) AS recall_fake, round(fp / greatest(1, n_real)::DOUBLE, 8) AS fpr, tp, fp, tn, fn, round(s / n, 8) AS mean_pred FROM c, base"""


_GROUPS = """, g AS (SELECT DISTINCT generator FROM {rows} WHERE label = 1), t AS (SELECT unnest([0.3, 0.4, 0.5, 0.6]::DOUBLE[]) AS threshold),
pairs AS (SELECT g.generator, s.pred, s.label FROM g JOIN {rows} s ON s.label = 0 OR s.generator = g.generator),
base AS ({base}),
c AS (SELECT generator, threshold, count(*) AS n, count_if(label = 0) AS n_real, count_if(label = 1) AS n_fake, count_if(pred >= threshold AND label = 1) AS tp,
             count_if(pred >= threshold AND label = 0) AS fp, count_if(pred < threshold AND label = 0) AS tn, count_if(pred < threshold AND label = 1) AS fn,
             sum(pred) AS s FROM pairs, t GROUP BY ALL)
SELECT c.generator, c.threshold, c.n, c.n_real, c.n_fake, round((c.tp + c.tn) / c.n::DOUBLE, 8) AS acc, base.auroc AS auroc_fixed, round(c.tp / greatest(1, c.tp + c.fp)::DOUBLE, 8) AS precision_fake,
       round(c.tp / greatest(1, c.n_fake)::DOUBLE, 8) AS recall_fake, round(c.fp / greatest(1, c.n_real)::DOUBLE, 8) AS fpr, c.tp, c.fp, c.tn, c.fn, round(s / c.n, 8) AS mean_pred
FROM c JOIN base USING (generator)"""


@query(f"WITH {PRED}{_GROUPS.format(rows='pred', base=metric_sql('pairs', 'generator'))}")
def generator_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every generator at four thresholds against all negatives, which the SQL copies and the library does not."""
    return rounded(metrics.sweep_by_group(predictions(spark, sf_dir), "generator"))


@query(f"WITH {SALES}{_GROUPS.format(rows='sales', base=metric_sql('pairs', 'generator'))}")
def generator_sweep_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, J15 on many rows."""
    return rounded(metrics.sweep_by_group(sales(spark, sf_dir), "generator"))


_MARGINS = """m AS (SELECT (l_extendedprice - 30000::DOUBLE) * (0.05::DOUBLE - l_discount) + 0::DOUBLE AS pred, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_linestatus AS condition, l_suppkey % 7 AS g FROM lineitem)"""


def _margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a wide range, most of them different, and many of them 0."""
    pred = (F.col("l_extendedprice") - F.lit(30000.0)) * (F.lit(0.05) - F.col("l_discount")) + F.lit(0.0)
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(pred.alias("pred"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"), F.col("l_linestatus").alias("condition"), (F.col("l_suppkey") % 7).alias("g"))


@query(f"WITH {_MARGINS} {metric_sql('m', 'condition', threshold=100.0)}")
def metrics_of_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2 for scores of any range: slots from a quantile sketch."""
    rows = _margins(spark, sf_dir)
    return rounded(metrics.binary_metrics(rows, ["condition"], threshold=100.0, cuts=metrics.score_cuts(rows)))


@query(
    f"WITH {_MARGINS} SELECT g, " + ", ".join(f"round(quantile_cont(pred, {q}), 8) AS q{round(100 * q)}" for q in (0, 0.25, 0.5, 0.75, 1)) + " FROM m GROUP BY g"
)
def percentiles_of_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18 for values of any range."""
    rows = _margins(spark, sf_dir)
    return rounded(metrics.percentiles(rows, "pred", ["g"], cuts=metrics.score_cuts(rows)))


@query(_SWEEP_SQL)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics at 19 thresholds from one histogram."""
    return rounded(metrics.sweep(sales(spark, sf_dir), _THRESHOLDS))


_ERROR = "CASE WHEN pred >= 0.5 AND label = 1 THEN 'TP' WHEN pred >= 0.5 THEN 'FP' WHEN label = 0 THEN 'TN' ELSE 'FN' END"


def _errors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("error_type", error_type(F.col("pred"), F.col("label")))


def _stats_sql() -> str:
    part = lambda kind, value, group: f"""
SELECT '{kind}' AS group_type, {value} AS group_value, count(*) AS n_images, count_if(label = 0) AS n_real, count_if(label <> 0) AS n_fake,
       count_if(e = 'FP') AS n_fp, count_if(e = 'FN') AS n_fn, round(count_if(e = 'FP') / greatest(1, count_if(label = 0))::DOUBLE, 6) AS fpr,
       round(count_if(e = 'FN') / greatest(1, count_if(label <> 0))::DOUBLE, 6) AS fnr FROM j {group}"""  # noqa: E731
    fields = ("condition", "generator", "source_dataset")
    return f"WITH {PRED}, j AS (SELECT *, {_ERROR} AS e FROM pred)" + " UNION ALL ".join(
        [part("overall", "'all'", ""), *(part(f, f, f"GROUP BY {f}") for f in fields)]
    )


@query(_stats_sql())
def error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and error rates by three fields."""
    return groups.error_stats(_errors(predictions(spark, sf_dir)), ["condition", "generator", "source_dataset"])


@query(f"""WITH {PRED} SELECT {_ERROR} AS error_type, count(*) AS n FROM pred GROUP BY 1""")
def error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11."""
    return _errors(predictions(spark, sf_dir)).groupBy("error_type").agg(F.count("*").alias("n"))


@query(
    f"""WITH {PRED}, j AS (SELECT *, {_ERROR} AS e FROM pred)
SELECT e AS error_type, image_path, pred, place FROM (
  SELECT *, row_number() OVER (PARTITION BY e ORDER BY CASE WHEN e = 'FP' THEN -pred ELSE pred END, image_path) AS place FROM j WHERE e IN ('FP', 'FN'))
WHERE place <= 20"""
)
def worst_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 worst of either kind."""
    return groups.worst(_errors(predictions(spark, sf_dir)), 20).select("error_type", "image_path", "pred", "place")


@query(
    f"""WITH {PRED}, j AS (SELECT *, {_ERROR} AS e FROM pred)
SELECT condition, e AS error_type, image_path, place FROM (
  SELECT *, row_number() OVER (PARTITION BY condition, e ORDER BY CASE WHEN e = 'FP' THEN -pred ELSE pred END, image_path) AS place FROM j WHERE e IN ('FP', 'FN'))
WHERE place <= 3"""
)
def worst_errors_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: top 3 of each slice."""
    rows = groups.worst(_errors(predictions(spark, sf_dir)), 3, keys=["condition"])
    return rows.select("condition", "error_type", "image_path", "place")


_SLICES = f"""WITH {PRED}, s AS (
  SELECT *, CASE WHEN n_chars < 800 THEN 'short' WHEN n_chars > 3000 THEN 'long' ELSE 'medium' END AS size FROM pred),
long AS (SELECT generator, pred, label, 'size' AS feature, size AS value FROM s UNION ALL
         SELECT generator, pred, label, 'condition', condition FROM s UNION ALL SELECT generator, pred, label, 'source_dataset', source_dataset FROM s),
m AS ({metric_sql("long", "feature, value")}),
a AS (SELECT count_if(label = 0) AS r, count_if(label = 1) AS f, count_if(label = 0 AND pred >= 0.5) / greatest(1, count_if(label = 0))::DOUBLE AS fpr,
             count_if(label = 1 AND pred < 0.5) / nullif(count_if(label = 1), 0)::DOUBLE AS fnr FROM pred),
base AS (SELECT generator, count_if(pred < 0.5) / count(*)::DOUBLE AS b FROM pred WHERE label = 1 GROUP BY 1 HAVING count(*) >= 5),
own AS (SELECT feature, value, l.generator, count_if(pred < 0.5) / count(*)::DOUBLE AS x FROM long l WHERE label = 1 GROUP BY ALL HAVING count(*) >= 5),
g AS (SELECT feature, value, count(*) AS generator_count, count_if(x >= b + 0.05::DOUBLE) AS high_fnr_generators FROM own JOIN base USING (generator) GROUP BY ALL),
d AS (
  SELECT m.feature, m.value, n, n_real, n_fake, auroc, m.fpr, fn / nullif(n_fake, 0)::DOUBLE AS fnr, n_fake / nullif(f, 0)::DOUBLE - n_real / nullif(r, 0)::DOUBLE AS prevalence_gap,
         CASE WHEN n_real > 0 THEN fp / greatest(1, n_real)::DOUBLE - a.fpr END AS delta_fpr, CASE WHEN n_fake > 0 THEN fn / nullif(n_fake, 0)::DOUBLE - a.fnr END AS delta_fnr,
         coalesce(generator_count, 0) AS generator_count, coalesce(high_fnr_generators, 0) AS high_fnr_generators
  FROM m CROSS JOIN a LEFT JOIN g ON m.feature = g.feature AND m.value = g.value WHERE n >= 20)
SELECT feature, value, n, n_real, n_fake, auroc, fpr, round(fnr, 8) AS fnr, round(prevalence_gap, 8) AS prevalence_gap, round(delta_fpr, 8) AS delta_fpr, round(delta_fnr, 8) AS delta_fnr,
       generator_count, high_fnr_generators, coalesce(abs(prevalence_gap) >= 0.15, FALSE) AS shortcut_candidate,
       coalesce(delta_fpr >= 0.10, FALSE) OR coalesce(delta_fnr >= 0.10, FALSE) OR high_fnr_generators >= 2 AS blind_spot_candidate FROM d"""


def _triaged(found: DataFrame) -> DataFrame:
    return groups.by_importance(found).select(
        "feature", "value", "n", "n_real", "n_fake", "auroc", "fpr", "fnr", "prevalence_gap", "delta_fpr", "delta_fnr",
        "generator_count", "high_fnr_generators", "shortcut_candidate", "blind_spot_candidate",
    )


@query(_SLICES)
def slice_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by feature value, with candidates, in the order of triage."""
    rows = predictions(spark, sf_dir).withColumn("size", bucket3(F.col("n_chars"), 800, 3000, ("short", "medium", "long")))
    return rounded(_triaged(groups.slices(rows, ["size", "condition", "source_dataset"], min_support=20, min_generator_support=5)))


@query(_SLICES.replace("'size' AS feature", "'resolution' AS feature").replace("label, 'condition'", "label, 'semantic_scene'").replace("label, 'source_dataset'", "label, 'semantic_style'"))
def slice_report_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for features that are found by the names of columns; low-level slices that are not there have no values."""
    rows = predictions(spark, sf_dir).withColumn("semantic_style_score", F.lit(1.0))
    rows = rows.withColumnsRenamed({"condition": "semantic_scene", "source_dataset": "semantic_style"}).withColumn("resolution", bucket3(F.col("n_chars"), 800, 3000, ("short", "medium", "long")))
    return rounded(_triaged(groups.slices(rows, groups.slice_keys(rows.columns), min_support=20, min_generator_support=5)))


_TWO = f"""WITH {PRED}, two AS (SELECT regexp_replace(image_path, '^.*?(fake|real)/', '\\1/') AS key, label, pred, (doc_id * 104729 % 1000)::DOUBLE / 1000::DOUBLE AS other FROM pred)"""


@query(
    f"""{_TWO}, e AS (SELECT CASE WHEN pred >= 0.5 AND label = 0 THEN 'fp' WHEN pred < 0.5 AND label = 1 THEN 'fn' END AS a,
  CASE WHEN other >= 0.5 AND label = 0 THEN 'fp' WHEN other < 0.5 AND label = 1 THEN 'fn' END AS b FROM two)
SELECT CASE WHEN a IS NOT NULL AND b IS NULL THEN a || '_fixed' WHEN a = b THEN a || '_remain' WHEN a IS NULL AND b IS NOT NULL THEN b || '_new' ELSE 'ok' END AS bucket, count(*) AS n
FROM e GROUP BY 1"""
)
def error_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes from one model to the next."""
    rows = predictions(spark, sf_dir).withColumn("key", key_from_first_marker(F.col("image_path"), ("fake", "real", "FAKE", "REAL")))
    new = rows.withColumn("pred", (F.col("doc_id") * 104729 % 1000).cast("double") / F.lit(1000.0))
    old = groups.last_by(rows.select("key", "label", "pred", "doc_id"), "key", "doc_id")
    return groups.transitions(old, groups.last_by(new.select("key", "pred", "doc_id"), "key", "doc_id"))


def _model_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    score = lambda k: ((F.col("doc_id") * k % 1000).cast("double") / F.lit(1000.0)).alias("pred")
    parts = [rows.select(F.lit(m).alias("model"), F.col("image_path").alias("key"), "label", score(k)) for m, k in (("a", 7919), ("b", 104729), ("c", 1299709))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.withColumn("error_type", error_type(F.col("pred"), F.col("label"))).where(F.col("error_type").isin("FP", "FN"))


_MODELS = f"""WITH {PRED}, k AS (SELECT * FROM (VALUES ('a', 7919), ('b', 104729), ('c', 1299709)) x(model, f)),
p AS (SELECT model, image_path AS key, label, (doc_id * f % 1000)::DOUBLE / 1000::DOUBLE AS pred FROM pred, k),
e AS (SELECT *, CASE WHEN pred >= 0.5 THEN 'FP' ELSE 'FN' END AS error_type FROM p WHERE (pred >= 0.5) = (label = 0))"""


@query(
    f"""{_MODELS}, s AS (SELECT model, error_type, list(key) AS l FROM e GROUP BY ALL),
q AS (SELECT a.model AS left, b.model AS right, a.error_type, len(list_intersect(a.l, b.l)) AS intersection, len(a.l) AS na, len(b.l) AS nb
      FROM s a JOIN s b ON a.error_type = b.error_type AND a.model < b.model)
SELECT "left", "right", error_type, intersection, na + nb - intersection AS "union", round(intersection / (na + nb - intersection)::DOUBLE, 8) AS jaccard,
       round(intersection / na::DOUBLE, 8) AS share_of_left, round(intersection / nb::DOUBLE, 8) AS share_of_right FROM q"""
)
def error_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error sets of all pairs of models."""
    return rounded(groups.error_overlap(_model_errors(spark, sf_dir)))


@query(
    f"""{_MODELS} SELECT model, error_type, round(quantile_cont(pred, 0), 8) AS q0, round(quantile_cont(pred, 0.25), 8) AS q25,
  round(quantile_cont(pred, 0.5), 8) AS q50, round(quantile_cont(pred, 0.75), 8) AS q75, round(quantile_cont(pred, 1), 8) AS q100 FROM e GROUP BY ALL"""
)
def error_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated percentiles of errors' scores."""
    return rounded(metrics.percentiles(_model_errors(spark, sf_dir), "pred", ["model", "error_type"]))


@query(
    f"""{_MODELS}, t AS (SELECT model, count_if(label = 0) AS n_real, count_if(label = 1) AS n_fake FROM p GROUP BY 1),
x AS (SELECT model, count_if(error_type = 'FP') AS fp, count_if(error_type = 'FN') AS fn FROM e GROUP BY 1)
SELECT model, n_real, n_fake, fp, fn, round(fp / n_real::DOUBLE, 8) AS fpr, round(fn / n_fake::DOUBLE, 8) AS fnr,
       round(1 - (fp + fn) / (n_real + n_fake)::DOUBLE, 8) AS accuracy FROM t JOIN x USING (model)"""
)
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and rates of each model's errors."""
    rows = predictions(spark, sf_dir)
    totals = rows.agg(F.count_if(F.col("label") == 0).alias("n_real"), F.count_if(F.col("label") == 1).alias("n_fake"))
    totals = totals.select(F.explode(F.array(*[F.lit(m) for m in "abc"])).alias("model"), "n_real", "n_fake")
    found = groups.error_summary(_model_errors(spark, sf_dir), totals)
    return rounded(found.select("model", "n_real", "n_fake", "fp", "fn", "fpr", "fnr", "accuracy"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "user", "real").otherwise(F.col("role"))
    return rows.select(F.col("conv_id").cast("string").alias("source_id"), role.alias("role"), (F.length("text") % 997 / F.lit(997.0)).alias("pred"))


_TURNS = """WITH t AS (SELECT conv_id::VARCHAR AS source_id, CASE WHEN role = 'user' THEN 'real' ELSE role END AS role, (length(text) % 997) / 997::DOUBLE AS pred FROM conversations),
o AS (SELECT source_id, role, max(pred) AS s FROM t WHERE source_id IS NOT NULL GROUP BY ALL)"""


@query(
    f"""{_TURNS} SELECT a.role, count(*) AS n, count_if(a.s > b.s) AS hits, round(count_if(a.s > b.s) / count(*)::DOUBLE, 8) AS pair_acc, round(avg(a.s - b.s), 8) AS mean_delta
FROM o a JOIN o b ON a.source_id = b.source_id AND b.role = 'real' WHERE a.role <> 'real' GROUP BY 1"""
)
def pair_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives against the negative of the same source."""
    return rounded(groups.pair_ranking(_turns(spark, sf_dir)))


@query(f"{_TURNS} SELECT source_id FROM t WHERE role IN ('real', 'assistant', 'system') GROUP BY 1 HAVING count(DISTINCT role) = 3")
def complete_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that have all three roles."""
    return groups.complete_sources(_turns(spark, sf_dir), ["real", "assistant", "system"])


@query(
    f"""WITH {PRED}, f AS (SELECT pred, n_chars > 1500 AS stylized FROM pred WHERE label = 1)
SELECT CASE WHEN grouping(stylized) = 1 THEN 'all_fake' WHEN stylized THEN 'stylized' ELSE 'photoreal' END AS slice, count(*) AS n, count_if(pred < 0.5) AS n_fn,
       round(count_if(pred < 0.5) / greatest(1, count(*))::DOUBLE, 8) AS fnr FROM f GROUP BY ROLLUP (stylized)"""
)
def style_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misses among positives, by style."""
    rows = predictions(spark, sf_dir).where("label = 1").withColumn("stylized", F.col("n_chars") > 1500)
    return rounded(groups.style_report(rows))


@query(
    f"""WITH {SALES}, m AS ({metric_sql("sales", "generator, condition")})
SELECT generator AS model, max(CASE WHEN condition = 'F' THEN acc END) AS "F_acc", max(CASE WHEN condition = 'F' THEN auroc END) AS "F_auroc",
       max(CASE WHEN condition = 'O' THEN acc END) AS "O_acc", max(CASE WHEN condition = 'O' THEN auroc END) AS "O_auroc" FROM m GROUP BY 1"""
)
def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: models by conditions."""
    rows = rounded(metrics.binary_metrics(sales(spark, sf_dir), ["generator", "condition"])).withColumnRenamed("generator", "model")
    return groups.pivot_metrics(rows, ["F", "O"])


@query(
    f"""WITH {SALES}, m AS ({metric_sql("sales", "condition")})
SELECT condition, n::VARCHAR AS n, printf('%.4f', threshold) AS threshold, '' AS unmatched FROM m"""
)
def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric table as text."""
    return metric_texts(metrics.binary_metrics(sales(spark, sf_dir), ["condition"]), ["condition", "n", "threshold", "unmatched"])


def _shown(x: str) -> str:
    return f"coalesce(printf('%.4f', {x}), '')"


@query(
    f"""WITH {SALES}, m AS ({metric_sql("sales", "condition")})
SELECT 'm1' AS model, 'whole' AS split, condition, n::VARCHAR AS n, n_real::VARCHAR AS n_real, n_fake::VARCHAR AS n_fake,
  {", ".join(f"{_shown(c)} AS {c}" for c in ("acc", "auroc", "precision_fake", "recall_fake", "fpr", "mean_pred", "threshold"))} FROM m"""
)
def metric_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K3: every column of a metric table as it is written."""
    rows = rounded(metrics.binary_metrics(sales(spark, sf_dir), ["condition"])).withColumns({"model": F.lit("m1"), "split": F.lit("whole")})
    return metric_texts(rows, METRIC_COLUMNS)


@query(
    f"""WITH r AS (SELECT quality AS label, (doc_id * 7919 % 1000)::DOUBLE / 1000::DOUBLE AS pred FROM documents JOIN labels USING (doc_id)), m AS ({metric_sql("r")})
SELECT m.n, n_real, n_fake, acc, auroc, fpr, tp, fp, tn, fn, (SELECT count(*) FROM documents) - m.n AS unmatched FROM m"""
)
def scored_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: predictions scored against labels by key, with the number that none matches."""
    pred = (F.col("doc_id") * 7919 % 1000).cast("double") / F.lit(1000.0)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("doc_id").cast("string").alias("image_path"), pred.alias("pred"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("y"))
    found, _ = metrics.score_predictions(rows.select("key", "image_path", "pred"), labels)
    return rounded(found.select("n", "n_real", "n_fake", "acc", "auroc", "fpr", "tp", "fp", "tn", "fn", "unmatched"))


@query(
    f"""WITH {PRED}, e AS (SELECT CASE WHEN pred >= 0.5 THEN 'FP' ELSE 'FN' END AS error_type, image_path, pred, label AS y FROM pred WHERE (pred >= 0.5) = (label = 0))
SELECT * FROM (SELECT error_type, row_number() OVER (PARTITION BY error_type ORDER BY CASE WHEN error_type = 'FP' THEN -pred ELSE pred END, image_path) AS place, image_path, pred, y FROM e) WHERE place <= 50"""
)
def scored_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, L1: the 50 worst errors of each kind of the same report."""
    rows = predictions(spark, sf_dir).withColumn("key", F.col("doc_id"))
    return metrics.score_predictions(rows.select("key", "image_path", "pred"), rows.select("key", F.col("label").alias("y")))[1]
