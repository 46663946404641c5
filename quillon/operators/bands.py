"""Threshold bands as a versioned table: a decision takes the bands in force at its time.

A row is one band of a context's policy from a time on: (task_context, valid_from, version, lower, below, action,
reason, threshold, review); ``lower`` is null in the lowest band and ``below`` in the highest.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import POLICIES

BANDS = "task_context string, valid_from timestamp, version string, lower double, below double, action string, reason string, threshold double, review boolean"
#: Most bands of a table, which is broadcast.
MOST_BANDS = 100_000


def fixed_bands(spark: SparkSession, valid_from: datetime = datetime(1970, 1, 1)) -> DataFrame:
    """The policies of the settings as a table with one version."""
    rows = []
    for context, policy in POLICIES.items():
        lower = None
        for b in policy.bands:
            rows.append((context, valid_from, policy.version, lower, b.below, b.action, b.reason, float(b.threshold), b.review))
            lower = b.below
    return spark.createDataFrame(rows, BANDS)


def checked(bands: DataFrame) -> DataFrame:
    """The bands with ``valid_to``, where the next version of their context begins.

    Gaps and overlaps of scores inside a version, two versions from one time and missing contexts or times are errors."""
    version = Window.partitionBy("task_context", "valid_from").orderBy(F.col("lower").asc_nulls_first(), "below")
    above, whole = F.lead("lower").over(version), Window.partitionBy("task_context", "valid_from")
    place = F.row_number().over(version)
    wrong = (
        F.when(F.col("task_context").isNull() | F.col("valid_from").isNull(), "lacks a context or time")
        .when(F.min("version").over(whole) != F.max("version").over(whole), "is one of two versions from the same time")
        .when((place == 1) & F.col("lower").isNotNull(), "is the lowest and has a lower end")
        .when(F.col("below").isNull() & (F.lead("version").over(version).isNotNull()), "has no upper end and another band above it")
        .when((place > 1) & F.col("lower").isNull(), "is one of two lowest bands")
        .when(F.col("lower") >= F.col("below"), "is empty")
        .when(above > F.col("below"), "leaves a gap above it")
        .when(above < F.col("below"), "overlaps the band above it")
        .when(F.lead("version").over(version).isNull() & F.col("below").isNotNull(), "is the highest and has an upper end")
    )
    text = F.concat(F.coalesce("task_context", F.lit("null")), F.lit(" from "), F.coalesce(F.col("valid_from").cast("string"), F.lit("null")), F.lit(": band "), F.coalesce("action", F.lit("null")), F.lit(" "), wrong)
    total, faults = bands.withColumn("fault", F.when(wrong.isNotNull(), text)).agg(F.count("*"), F.min("fault")).first()
    if faults is not None:
        raise ValueError(faults)
    if total > MOST_BANDS:
        raise ValueError(f"more than {MOST_BANDS} bands")
    times = bands.select("task_context", "valid_from").distinct()
    times = times.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("task_context").orderBy("valid_from")))
    return bands.join(times, ["task_context", "valid_from"])


def decide_by_version(rows: DataFrame, bands: DataFrame, probability: str = "probability", at: str = "event_ts", context: str = "task_context") -> DataFrame:
    """Adds action, action_reason, threshold_value, manual_review_required and decision_policy_version by the bands in force
    at ``at``; null without a probability or a time, in an unknown context and before its first version."""
    b = checked(bands).select(*(F.col(c).alias(f"__{c}") for c in ("task_context", "valid_from", "valid_to", "lower", "below", "version", "action", "reason", "threshold", "review")))
    p, t = F.col(probability), F.col(at)
    inside = (p >= F.coalesce("__lower", F.lit(float("-inf")))) & (F.col("__below").isNull() | (p < F.col("__below")))
    force = (t >= F.col("__valid_from")) & (F.col("__valid_to").isNull() | (t < F.col("__valid_to")))
    found = rows.join(F.broadcast(b), (F.col(context) == F.col("__task_context")) & force & inside, "left")
    named = {"action": "action", "action_reason": "reason", "threshold_value": "threshold", "manual_review_required": "review", "decision_policy_version": "version"}
    return found.withColumns({name: F.col(f"__{c}") for name, c in named.items()}).drop(*(c for c in b.columns))
