"""Profiles of raw columns and logs: summaries, histograms, category and missing counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_rate
from .prefix import percentiles


def numeric_long(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names))).alias("f")).select("f.*")


def text_long(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("string").alias("value")) for n in names))).alias("f")).select("f.*")


def numeric_summary(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    long = numeric_long(rows, names)
    found = long.groupBy("feature").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    points = percentiles(long, ["feature"], "value", (0.05, 0.5, 0.95)).select("feature", F.col("p0").alias("p05"), F.col("p1").alias("median"), F.col("p2").alias("p95"))
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("p05", "median", "p95")}
    return found.join(points, "feature", "left").withColumns(zero).select("feature", "count", "mean", "p05", "median", "p95", "min", "max")


def histogram(rows: DataFrame, value: str, bins: int = 12) -> DataFrame:
    """(bin, n): equal width, closed on the left, the largest value in the last bin; one bin for a constant."""
    x = F.col(value).cast("double")
    limits = rows.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((x - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    return rows.filter(x.isNotNull()).crossJoin(F.broadcast(limits)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def category_counts(rows: DataFrame, names: Sequence[str], top: int = 10) -> DataFrame:
    """(feature, value, n, place): the most frequent values of each column."""
    counts = text_long(rows, names).filter("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("feature").orderBy(F.col("n").desc(), "value"))).filter(F.col("place") <= top)


def missing_counts(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return text_long(rows, names).groupBy("feature").agg(F.count_if(F.col("value").isNull()).alias("missing"), F.count("*").alias("rows"))


def label_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))


def split_summary(rows: DataFrame, label: str = "label") -> DataFrame:
    """(split, rows, positives, positive_rate)."""
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.sum(label).alias("positives"), safe_rate(F.sum(label), F.count("*")).alias("positive_rate"))


def preview(rows: DataFrame, n: int = 3) -> DataFrame:
    """The first rows, with the lengths of their vectors where they have any."""
    lengths = {f"{c}_length": F.size(c) for c in ("dense_features", "sparse_feature_ids") if c in rows.columns}
    return rows.limit(n).withColumns(lengths) if lengths else rows.limit(n)
