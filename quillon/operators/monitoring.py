"""Summaries of prediction and decision logs, governance by group, alerts and readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AlertThresholds
from ..functions.columns import is_positive_action, safe_rate
from . import metrics
from .prefix import percentiles


def for_context(log: DataFrame, context: str) -> DataFrame:
    return log.filter(F.lower(F.trim("task_context")) == context.strip().lower())


def prediction_summary(log: DataFrame, by: Sequence[str] = (), latency: str = "latency_ms", dense: str | None = None) -> DataFrame:
    """Latency percentiles, distinct ids, completeness; zero fraction of dense vectors where given.

    Error rate and freshness are placeholders: the log holds no failures and no feature times."""
    shares = []
    if dense:
        zeros = F.size(F.filter(dense, lambda v: v == 0))
        shares = [F.coalesce(F.avg(F.try_divide(zeros, F.size(dense))), F.lit(0.0)).alias("dense_zero_fraction"), F.coalesce(F.max(F.size(dense)), F.lit(0)).alias("dense_length")]
    out = log.groupBy(*by).agg(F.count("*").alias("prediction_count"), F.count_distinct("prediction_id").alias("distinct_predictions"), *shares)
    names = {50: "p0", 95: "p1", 99: "p2"}
    found = percentiles(log, by, latency, (0.5, 0.95, 0.99)).select(*by, *(F.col(c).alias(f"p{n}_latency_ms") for n, c in names.items()))
    out = out.join(found, list(by), "left") if by else out.join(found, how="left")
    zero = {f"p{n}_latency_ms": F.coalesce(f"p{n}_latency_ms", F.lit(0.0)) for n in names}
    return out.withColumns(zero | {"error_rate": F.lit(0.0), "completeness": F.when(F.col("prediction_count") > 0, 1.0).otherwise(0.0), "freshness_seconds": F.lit(None).cast("double")})


def sparse_histogram(log: DataFrame, ids: str = "sparse_feature_ids", buckets: int = 32) -> DataFrame:
    return log.select(F.explode(ids).alias("id")).groupBy((F.col("id") % buckets).alias("bucket")).agg(F.count("*").alias("n"))


def action_counts(decisions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, action_counts): a map from action to its number of decisions; a null action is ``unknown``."""
    counted = decisions.groupBy(*by, F.coalesce("action", F.lit("unknown")).alias("action")).agg(F.count("*").alias("n"))
    return counted.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n")))).alias("action_counts"))


def _beside(rows: DataFrame, more: DataFrame, by: Sequence[str]) -> DataFrame:
    """Both tables have one row for each group; null groups meet too."""
    if not by:
        return rows.crossJoin(more)
    matched = rows.alias("l").join(more.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by], "left")
    return matched.select("l.*", *(F.col(f"r.{c}") for c in more.columns if c not in by))


def decision_summary(decisions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    positive = is_positive_action(F.col("action"), F.col("task_context")).cast("int")
    summary = decisions.groupBy(*by).agg(
        F.count("*").alias("decision_count"),
        safe_rate(F.sum(F.col("manual_review_required").cast("int")), F.count("*")).alias("manual_review_rate"),
        safe_rate(F.sum(positive), F.count("*")).alias("positive_action_rate"),
        F.coalesce(F.avg("outcome_delay_days"), F.lit(0.0)).alias("mean_label_delay_days"),
        F.coalesce(F.percentile("outcome_delay_days", F.lit(0.95)), F.lit(0.0)).alias("p95_label_delay_days"),
        F.count_distinct("prediction_id").alias("linked_predictions"),
    )
    return _beside(summary, action_counts(decisions, by), by)


def links(predictions: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: distinct linked ids over rows (for alerts) and over distinct ids (for display)."""
    p = predictions.agg(F.count("*").alias("predictions"), F.count_distinct("prediction_id").alias("distinct_predictions"))
    d = decisions.agg(F.count("*").alias("decisions"), F.count_distinct("prediction_id").alias("distinct_decided"))
    linked = predictions.select("prediction_id").distinct().join(decisions.select("prediction_id").distinct(), "prediction_id", "left_semi").agg(F.count("*").alias("linked"))
    return p.crossJoin(d).crossJoin(linked).select(
        "predictions", "decisions", "linked",
        safe_rate(F.col("linked"), F.col("predictions")).alias("prediction_link_rate"),
        safe_rate(F.col("linked"), F.col("decisions")).alias("decision_link_rate"),
        safe_rate(F.col("linked"), F.col("distinct_predictions")).alias("distinct_prediction_link_rate"),
        safe_rate(F.col("linked"), F.col("distinct_decided")).alias("distinct_decision_link_rate"),
        F.greatest(F.lit(0).cast("long"), F.col("decisions") - F.col("linked")).alias("unlinked_decisions"),
        F.lit(1.0).alias("availability"),
    )


def audit_coverage(predictions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Share of decisions whose prediction is in the log."""
    known = decisions.join(predictions.select("prediction_id").distinct(), "prediction_id", "left_semi")
    return known.agg(F.count("*").alias("covered")).crossJoin(decisions.agg(F.count("*").alias("decisions"))).select(
        "covered", "decisions", safe_rate(F.col("covered"), F.col("decisions")).alias("audit_log_coverage")
    )


def live_rows(decisions: DataFrame, context: str | None = None, probability: str = "calibrated_probability", raw: str | None = "raw_probability") -> DataFrame:
    """Labelled decisions with the probabilities that they carry themselves, each with weight one.

    A decision without a probability is left out; what the prediction log holds, repeats or has lost
    does not matter.  ``context`` is the primary one, to which live metrics are confined."""
    primary = for_context(decisions, context) if context else decisions
    kept = primary.filter(F.col("realized_label").isNotNull() & F.col(probability).isNotNull())
    found = {"score": F.col(probability), "label": F.col("realized_label"), "weight": F.lit(1.0)}
    return kept.withColumns(found | ({"raw_probability": F.col(raw)} if raw else {}))


def live_metrics(live: DataFrame) -> DataFrame:
    """(kind, metrics): of the calibrated probabilities, and of the raw ones where these are known."""
    found = metrics.report(live).select(F.lit("calibrated").alias("kind"), "*")
    if "raw_probability" not in live.columns:
        return found
    raw = metrics.report(live.filter("raw_probability is not null"), score="raw_probability").select(F.lit("raw").alias("kind"), "*")
    return found.unionByName(raw)


def governance(decisions: DataFrame, group: str = "task_context", probability: str = "calibrated_probability", bins: int = 10) -> DataFrame:
    """One row for each group; null and empty groups are ``unknown``.  Probabilities are those that the
    decisions carry; the calibration error is null without labelled ones."""
    rows = decisions.withColumn("group", F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit("unknown")))
    positive = is_positive_action(F.col("action"), F.col("task_context")).cast("int")
    base = rows.groupBy("group").agg(
        F.count("*").alias("decision_count"),
        safe_rate(F.sum(F.col("manual_review_required").cast("int")), F.count("*")).alias("manual_review_rate"),
        safe_rate(F.sum(positive), F.count("*")).alias("positive_action_rate"),
        F.avg(probability).alias("mean_probability"),
    )
    labelled = rows.filter(F.col("realized_label").isNotNull() & F.col(probability).isNotNull()).select(
        "group", F.col("realized_label").alias("label"), F.col(probability).alias("score"), F.lit(1.0).alias("weight")
    )
    errors = metrics.calibration_errors(metrics.bins_of_rows(labelled, ["group"], bins), ["group"], bins).select("group", "ece")
    return _beside(base, action_counts(rows, ["group"]), ["group"]).join(errors, "group", "left")


def gap(column: str) -> Column:
    """Largest minus smallest of the values that are there; 0 for fewer than two."""
    return F.when(F.count(column) >= 2, F.max(column) - F.min(column)).otherwise(0.0)


def governance_gaps(groups: DataFrame) -> DataFrame:
    return groups.agg(gap("ece").alias("subgroup_calibration_gap"), gap("positive_action_rate").alias("approval_rate_gap"))


#: Metric, threshold's name, and whether an alert fires above (or else below) it; in order of emission.
RULES = (
    ("prediction_p95_latency_ms", "max_p95_latency_ms", True),
    ("max_dense_psi", "max_dense_psi", True),
    ("sparse_bucket_psi", "max_sparse_psi", True),
    ("live_primary_calibrated_metrics.ece", "max_live_ece", True),
    ("manual_review_rate", "max_manual_review_rate", True),
    ("subgroup_calibration_gap", "max_subgroup_calibration_gap", True),
    ("approval_rate_gap", "max_approval_rate_gap", True),
    ("audit_log_coverage", "min_prediction_link_rate", False),
)


def alerts(wide: DataFrame, thresholds: AlertThresholds = AlertThresholds()) -> DataFrame:
    """(place, metric, value, threshold, severity) of the rules that fire on one row of metrics, whose
    columns are named as in RULES with ``.`` as ``_``.  The last rule reads the prediction link rate."""
    column = lambda metric: "prediction_link_rate" if metric == "audit_log_coverage" else metric.replace(".", "_")
    rows = [
        F.struct(F.lit(i).alias("place"), F.lit(metric).alias("metric"), F.col(column(metric)).cast("double").alias("value"), F.lit(float(getattr(thresholds, name))).alias("threshold"), F.lit(above).alias("above"))
        for i, (metric, name, above) in enumerate(RULES)
    ]
    fired = F.when(F.col("above"), F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter(fired).select("place", "metric", "value", "threshold", F.lit("critical").alias("severity"))


def readiness(fired: DataFrame, wide: DataFrame) -> DataFrame:
    """(ready, reasons): no critical alert and a link rate that is high enough (a low one counts twice)."""
    critical = fired.filter("severity = 'critical'").agg(F.array_sort(F.collect_list("metric")).alias("reasons"))
    low = F.when(F.col("prediction_link_rate") < 0.99, F.array(F.lit("prediction_link_rate"))).otherwise(F.array().cast("array<string>"))
    return critical.crossJoin(wide.select("prediction_link_rate")).select(F.concat("reasons", low).alias("reasons")).select((F.size("reasons") == 0).alias("ready"), "reasons")
