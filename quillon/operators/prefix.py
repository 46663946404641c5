"""Sums over what comes earlier in an order, without one task that sorts a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stage


def sums_before(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], **sums: Column) -> DataFrame:
    """Adds, for each name, the sum of its column over the rows of the group that come earlier in a total order.

    Rows are range-partitioned by group and order (at quantiles that Spark samples, so ranges follow
    the data) and written, so that a row's partition stays the same; sums run inside the partitions
    and over the partitions' totals."""
    parts = stage(rows.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "ordered")
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*by, "__part").agg(*(F.sum(c).alias(name) for name, c in sums.items()))
    totals = totals.select(*by, "__part", *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"__{name}") for name in sums))
    matched = parts.withColumns({name: F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()}).alias("l").join(
        totals.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "__part")]
    )
    kept = [F.col(f"l.{c}") for c in parts.columns if c != "__part" and c not in sums]
    return matched.select(*kept, *((F.col(f"l.{name}") + F.col(f"r.__{name}")).alias(name) for name in sums))


def percentiles(rows: DataFrame, by: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """(by, n, p0, p1, ...): exact percentiles of the values that are there, interpolated linearly.

    Values are added up by value first; then those at the two places next to each point are picked."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("times"))
    sizes = counted.groupBy(*by).agg(F.sum("times").alias("n"))
    placed = sums_before(counted, by, ["value"], first=F.col("times"))
    met = placed.alias("l").join(sizes.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]) if by else placed.crossJoin(sizes)
    met = met.select(*((F.col(f"l.{c}") if by else F.col(c)).alias(c) for c in by), "value", "first", "times", "n")
    at = {i: (F.col("n") - 1) * F.lit(float(p)) for i, p in enumerate(points)}
    here = lambda place: (F.col("first") <= place) & (place < F.col("first") + F.col("times"))
    picked = {f"{side}{i}": F.max(F.when(here(rounding(at[i])), F.col("value"))) for i in at for side, rounding in (("lo", F.floor), ("hi", F.ceil))}
    found = met.groupBy(*by).agg(F.max("n").alias("n"), *(c.alias(name) for name, c in picked.items()))
    between = {f"p{i}": F.col(f"lo{i}") + (at[i] - F.floor(at[i])) * (F.col(f"hi{i}") - F.col(f"lo{i}")) for i in at}
    return found.withColumns(between).select(*by, "n", *between)
