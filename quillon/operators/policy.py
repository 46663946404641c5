"""Threshold decisions and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import POLICIES
from ..functions.columns import is_positive_action, routed, safe_rate


def decide(rows: DataFrame, probability: str = "probability", context: str = "task_context") -> DataFrame:
    """Adds action, action_reason, threshold_value, manual_review_required and policy_version."""
    found = rows.withColumn("__r", routed(F.col(probability), F.col(context)))
    return found.withColumns(
        {
            "action": F.col("__r.action"),
            "action_reason": F.col("__r.reason"),
            "threshold_value": F.col("__r.threshold"),
            "manual_review_required": F.col("__r.review"),
            "decision_policy_version": F.col("__r.policy_version"),
        }
    ).drop("__r")


def simulate(rows: DataFrame, contexts: Sequence[str] = tuple(POLICIES), probability: str = "probability") -> DataFrame:
    """Every row decided in every context, in one pass over the rows."""
    every = F.explode(F.array(*map(F.lit, contexts)))
    return decide(rows.withColumn("task_context", every), probability)


def summarise(decisions: DataFrame, by: Sequence[str] = ("task_context",), label: str = "realized_label", probability: str = "probability") -> DataFrame:
    """(by, action, decisions, ...): one row for each action and one (action null) for all.

    The positive rate divides by all decisions, so a missing label counts as negative."""
    sets = [[*by, "action"], list(by)]
    # The context decides which action is positive, so it must be known of each row, named in ``by`` or not.
    positive = is_positive_action(F.col("action"), F.col("task_context")).cast("int")
    return decisions.withColumn("__positive", positive).groupingSets([[F.col(c) for c in s] for s in sets], *by, "action").agg(
        F.count("*").alias("decision_count"),
        safe_rate(F.sum(F.col("manual_review_required").cast("int")), F.count("*")).alias("manual_review_rate"),
        safe_rate(F.sum(label), F.count("*")).alias("positive_rate"),
        safe_rate(F.sum(probability), F.count("*")).alias("mean_calibrated_probability"),
        safe_rate(F.sum("__positive"), F.count("*")).alias("positive_action_rate"),
        F.grouping("action").alias("all_actions"),
    )


def summary_document(summary: DataFrame, by: Sequence[str] = ("split", "task_context")) -> dict:
    """A summary as nested documents by its groups, each with counts, rates and probabilities by action."""
    out: dict = {}
    for r in summary.collect():
        group = out
        for c in by:
            group = group.setdefault(str(r[c]), {})
        if r.all_actions:
            group.update({c: r[c] for c in ("decision_count", "manual_review_rate", "positive_rate", "mean_calibrated_probability", "positive_action_rate")})
        else:
            for name, value in (("action_counts", r.decision_count), ("action_positive_rates", r.positive_rate), ("action_mean_probability", r.mean_calibrated_probability)):
                group.setdefault(name, {})[r.action] = value
    return out
