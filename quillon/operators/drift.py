"""Population stability index and feature drift between a reference and a live population."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_rate, sparse_bucket
from ..sources.scratch import stage

#: Most groups whose ranges are broadcast.
MOST_GROUPS = 100_000


def psi(rows: DataFrame, by: Sequence[str] = (), value: str = "value", live: str = "live", bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """(by, psi) of a numeric column; ``live`` tells the live rows from the reference.

    Bins are of equal width over the range of both populations and closed on the right.  A
    constant column and an empty population have index 0."""
    x, is_live = F.col(value).cast("double"), F.col(live)
    known = rows.filter(x.isNotNull()).select(*by, x.alias("value"), is_live.alias("live"))
    # One row for each group, then counts by bin: nothing but these moves.
    limits = known.groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_if(~F.col("live")).alias("all_e"), F.count_if("live").alias("all_a"))
    edges = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / bins)
    limits = stage(limits.withColumn("edges", edges), "limits")
    few = F.broadcast(limits) if limits.count() <= MOST_GROUPS else limits
    joined = known.join(few, list(by)) if by else known.crossJoin(F.broadcast(limits))
    binned = joined.withColumn("bin", F.size(F.filter("edges", lambda e: F.col("value") > e))).groupBy(*by, "bin").agg(
        F.count_if(~F.col("live")).alias("e"), F.count_if("live").alias("a"), *(F.first(c).alias(c) for c in ("all_e", "all_a", "lo", "hi"))
    )
    e, a = (F.greatest(F.try_divide(F.col(c), F.col(f"all_{c}")), F.lit(floor)) for c in ("e", "a"))
    term = F.when((F.col("all_e") == 0) | (F.col("all_a") == 0) | (F.col("lo") == F.col("hi")), 0.0).otherwise((a - e) * F.log(a / e))
    return binned.groupBy(*by).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("psi"))


def dense_long(rows: DataFrame, names: Sequence[str], live: str = "live") -> DataFrame:
    """(feature, value, live): one row for each dense feature of each row."""
    return rows.select(F.col(live).alias("live"), F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names))).alias("f")).select("live", "f.feature", "f.value")


def dense_drift(rows: DataFrame, names: Sequence[str], live: str = "live", bins: int = 10) -> DataFrame:
    """(feature, psi, reference_zero_rate, live_zero_rate)."""
    long = dense_long(rows, names, live)
    zero = lambda side: safe_rate(F.count_if(side & (F.col("value") == 0)), F.count_if(side))
    rates = long.groupBy("feature").agg(zero(~F.col("live")).alias("reference_zero_rate"), zero(F.col("live")).alias("live_zero_rate"))
    return psi(long, ["feature"], bins=bins).join(rates, "feature")


def sparse_drift(rows: DataFrame, ids: str = "sparse_feature_ids", live: str = "live", buckets: int = 32) -> DataFrame:
    """(psi) of the buckets that feature ids fall into."""
    exploded = rows.select(F.col(live).alias("live"), F.explode(ids).alias("id")).select("live", sparse_bucket(F.col("id"), buckets).cast("double").alias("value"))
    return psi(exploded, bins=buckets)


def drift_summary(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """(max_dense_psi, mean_dense_psi, sparse_bucket_psi)."""
    return dense.agg(F.coalesce(F.max("psi"), F.lit(0.0)).alias("max_dense_psi"), F.coalesce(F.avg("psi"), F.lit(0.0)).alias("mean_dense_psi")).crossJoin(
        sparse.select(F.col("psi").alias("sparse_bucket_psi"))
    )
