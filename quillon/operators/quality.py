"""Rules that tables must keep, as counts of the rows that break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import POLICIES

ACTIONS = sorted({band.action for policy in POLICIES.values() for band in policy.bands})


def _broken(rows: DataFrame, table: str, **rules: Column) -> DataFrame:
    """(table, rule, broken): a rule is broken where its condition does not hold; null does not hold."""
    counted = rows.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))
    pairs = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("broken")) for name in rules))
    return counted.select(F.lit(table).alias("table"), F.explode(pairs).alias("r")).select("table", "r.rule", "r.broken")


def _repeated(rows: DataFrame, table: str, key: str) -> DataFrame:
    over = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("broken"))
    return over.select(F.lit(table).alias("table"), F.lit(f"{key}_unique").alias("rule"), "broken")


def contact_events(rows: DataFrame) -> DataFrame:
    present = {f"{c}_present": F.col(c).isNotNull() for c in ("event_id", "event_ts", "request_id", "contact_id")}
    return _repeated(rows, "raw_contact_event", "event_id").unionByName(_broken(rows, "raw_contact_event", **present))


def labels(rows: DataFrame, events: DataFrame) -> DataFrame:
    orphans = rows.join(events.select(F.col("event_id").alias("parent_event_id")).distinct(), "parent_event_id", "left_anti").agg(F.count("*").alias("broken"))
    orphans = orphans.select(F.lit("raw_subscription_label").alias("table"), F.lit("parent_event_exists").alias("rule"), "broken")
    return orphans.unionByName(_broken(rows, "raw_subscription_label", subscribed_is_binary=F.col("subscribed").isin(0, 1), delay_not_negative=F.col("label_delay_seconds") >= 0))


def training_rows(rows: DataFrame) -> DataFrame:
    return _broken(
        rows,
        "training_row",
        sparse_lengths_agree=F.size("sparse_feature_ids") == F.size("sparse_feature_values"),
        weight_positive=F.col("sample_weight") > 0,
        version_present=F.col("feature_set_version").isNotNull(),
    )


def predictions(rows: DataFrame) -> DataFrame:
    return _broken(
        rows, "prediction_log", score_is_probability=F.col("calibrated_score").between(0, 1), latency_not_negative=F.col("latency_ms") >= 0, model_version_present=F.col("model_version").isNotNull()
    )


def decisions(rows: DataFrame) -> DataFrame:
    return _broken(rows, "decision_outcome", action_known=F.col("action").isin(*ACTIONS), review_present=F.col("manual_review_required").isNotNull())
