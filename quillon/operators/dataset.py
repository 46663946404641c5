"""Event, label and training tables from contacts, with splits and feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CATEGORICAL, LEAKAGE, NUMERIC, DatasetConfig
from ..functions import columns as C
from . import profiling


def with_identity(rows: DataFrame, config: DatasetConfig) -> DataFrame:
    """Adds event_id, request_id and, where rows carry no time of their own, event_ts."""
    limited = rows if config.max_rows is None else rows.filter(F.col("row_id") < config.max_rows)
    named = limited.withColumns({"event_id": C.numbered("evt", F.col("row_id")), "request_id": C.numbered("req", F.col("row_id"))})
    return named if "event_ts" in rows.columns else named.withColumn("event_ts", C.event_time(F.col("row_id"), config.start, config.seconds_per_row))


def with_split(rows: DataFrame, config: DatasetConfig) -> DataFrame:
    if config.split_strategy == "hash":
        return rows.withColumn("split", C.split_of(C.stable_fraction(F.col("event_id")), config.train_ratio, config.validation_ratio))
    total = rows.count()
    if not total:
        raise ValueError("a contiguous split needs rows")
    return rows.withColumn("split", C.contiguous_split(F.col("row_id"), F.lit(total), config.train_ratio, config.validation_ratio))


def contact_events(rows: DataFrame, config: DatasetConfig) -> DataFrame:
    names = (*NUMERIC, *CATEGORICAL, *LEAKAGE)
    context = F.map_filter(F.create_map(*(x for n in names for x in (F.lit(n), F.col(n)))), lambda _, v: v.isNotNull())
    return rows.select(
        "event_id", "event_ts", F.to_date("event_ts").alias("event_date"), "request_id", C.numbered("contact", F.col("row_id")).alias("contact_id"),
        C.numbered("campaign", F.floor(F.col("row_id") / 100), 6).alias("campaign_id"), context.alias("context_features"), F.lit(config.source_name).alias("source_name"),
    )


def _label_ts(config: DatasetConfig):
    return F.col("event_ts") + F.make_dt_interval(secs=F.lit(config.label_delay_seconds))


def subscription_labels(rows: DataFrame, config: DatasetConfig, delay: Column | None = None) -> DataFrame:
    """A label for each row, late by the configured delay or by an interval of its own."""
    return rows.withColumn("label_ts", _label_ts(config) if delay is None else F.col("event_ts") + delay).select(
        C.numbered("lbl", F.col("row_id")).alias("label_event_id"), F.col("event_id").alias("parent_event_id"), "label_ts", F.to_date("label_ts").alias("label_date"), F.col("label").alias("subscribed"),
        F.lit(config.attribution_window_hours).alias("attribution_window_hours"), F.lit(config.label_delay_seconds).alias("label_delay_seconds"), F.lit(config.source_name).alias("source_name"),
    )


def training_rows(rows: DataFrame, config: DatasetConfig) -> DataFrame:
    """Contract columns and ``split``."""
    ids = C.hashed_tokens(C.sparse_tokens(config.features), config.features.hash_dimension)
    return with_split(rows, config).withColumn("sparse_feature_ids", ids).select(
        C.numbered("trn", F.col("row_id")).alias("training_row_id"), F.to_date("event_ts").alias("snapshot_date"), "event_id", "event_ts", _label_ts(config).alias("label_ts"),
        F.lit(True).alias("label_available"), "label", F.lit(1.0).alias("sample_weight"), C.dense_vector(config.features).alias("dense_features"), "sparse_feature_ids",
        F.array_repeat(F.lit(1.0), F.size("sparse_feature_ids")).alias("sparse_feature_values"), F.lit(config.feature_set_version).alias("feature_set_version"),
        F.lit(config.task_context).alias("task_context"), "split",
    )


def summary(training: DataFrame) -> DataFrame:
    return profiling.split_summary(training)


def labelled_events(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Events with the label that arrived within its attribution window."""
    joined = events.join(labels, events.event_id == labels.parent_event_id)
    return joined.filter(F.col("label_ts") - F.col("event_ts") <= F.make_dt_interval(hours=F.col("attribution_window_hours")))
