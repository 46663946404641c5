"""Recalibration over rolling windows of event time.

As of each day, Platt's curve is fitted to the events of the days before it, but for the last few, whose
labels may not have matured.  Rows are added up by day and score once; every Newton step then is one
aggregate over them for all windows at once, and the steps of all windows that still move are taken together.
Windows are days by groups, so their table is small whatever the number of events; it is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import sigmoid
from ..sources import scratch

#: Days of a window and days in which labels mature.
WINDOW_DAYS, MATURITY_DAYS = 14, 2
#: Most windows (days by groups) of which a table is broadcast.
MOST_WINDOWS = 1_000_000


def daily_groups(rows: DataFrame, by: Sequence[str] = (), at: str = "event_ts", label: str = "label", score: str = "score", weight: str = "weight") -> DataFrame:
    """(by, day, score, pos, neg) of the rows with a label, a time and a score."""
    w, y = F.col(weight).cast("double"), F.col(label)
    known = rows.filter(y.isNotNull() & F.col(at).isNotNull() & F.col(score).isNotNull())
    return known.groupBy(*by, F.to_date(at).alias("day"), F.col(score).alias("score")).agg(F.sum(F.when(y == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(y == 1, 0.0).otherwise(w)).alias("neg"))


def _windows_of(days: DataFrame, window_days: int, maturity_days: int) -> DataFrame:
    """Adds ``as_of``, a row for each day whose window holds the row's day."""
    first, last = F.date_add("day", maturity_days + 1), F.date_add("day", maturity_days + window_days)
    return days.withColumn("as_of", F.explode(F.sequence(first, last)))


def fit_rolling(
    rows: DataFrame, by: Sequence[str] = (), window_days: int = WINDOW_DAYS, maturity_days: int = MATURITY_DAYS, max_iterations: int = 100, tolerance: float = 1e-6, l2: float = 1e-6, least: float = 0.0, **names: str
) -> DataFrame:
    """(by, as_of, slope, intercept, pos, neg, iterations): each as ``calibration.fit_platt`` on the rows of its window.

    There is a window for every day up to the first on which the last event has matured, unless it holds no rows.
    Unless the weights of both labels exceed ``least``, which keeps curves from chasing a few labels, the slope is 0
    and the intercept that of the smoothed share."""
    keys = [*by, "as_of"]
    groups = scratch.stage(daily_groups(rows, by, **names), "daily-scores")
    end = F.date_add(F.lit(groups.agg(F.max("day")).first()[0]).cast("date"), maturity_days + 1)
    totals = _windows_of(groups.groupBy(*by, "day").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), window_days, maturity_days)
    totals = totals.filter(F.col("as_of") <= end).groupBy(*keys).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    prior = (F.col("pos") + 1) / (F.col("pos") + F.col("neg") + 2)
    start = {"slope": F.lit(0.0), "intercept": F.log(prior) - F.log1p(-prior), "moving": (F.col("pos") > least) & (F.col("neg") > least), "iterations": F.lit(0)}
    fits = scratch.stage(totals.withColumns(start), "rolling-fits")
    if fits.count() > MOST_WINDOWS:
        raise ValueError(f"more than {MOST_WINDOWS} windows; fit fewer groups at once")
    for _ in range(max_iterations):
        moving = fits.filter("moving")
        if moving.isEmpty():
            break
        following = scratch.stage(_stepped(fits, _sums(groups, moving, by, window_days, maturity_days), keys, tolerance, l2), "rolling-fits")
        scratch.drop_table(fits)
        fits = following
    scratch.drop_table(groups)
    return fits.select(*keys, "slope", "intercept", "pos", "neg", "iterations")


def _matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Null-safe join on the keys, which stay those of the left side."""
    renamed = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    condition = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(F.broadcast(renamed), condition, how).drop(*(f"__{k}" for k in keys))


def _sums(groups: DataFrame, moving: DataFrame, by: Sequence[str], window_days: int, maturity_days: int) -> DataFrame:
    """The five sums of a Newton step of every window that moves."""
    keys = [*by, "as_of"]
    met = _matched(_windows_of(groups, window_days, maturity_days), moving.select(*keys, "slope", "intercept"), keys, "inner")
    s, w = F.col("score"), F.col("pos") + F.col("neg")
    p = sigmoid(F.col("slope") * s + F.col("intercept"))
    curve, error = w * p * (1 - p), w * p - F.col("pos")
    return met.groupBy(*keys).agg(F.sum(curve * s * s).alias("ss"), F.sum(curve * s).alias("s1"), F.sum(curve).alias("s0"), F.sum(error * s).alias("gs"), F.sum(error).alias("g0"))


def _stepped(fits: DataFrame, sums: DataFrame, keys: Sequence[str], tolerance: float, l2: float) -> DataFrame:
    """The fits after a step; one whose step is small, or cannot be taken, moves no more."""
    met = _matched(fits, sums, keys, "left")
    haa, hab, hbb = l2 + F.col("ss"), F.col("s1"), l2 + F.col("s0")
    ga, gb = l2 * F.col("slope") + F.col("gs"), l2 * F.col("intercept") + F.col("g0")
    determinant = haa * hbb - hab * hab
    possible = F.col("moving") & (F.abs(determinant) >= 1e-12)
    da, db = (hbb * ga - hab * gb) / determinant, (haa * gb - hab * ga) / determinant
    met = met.withColumns({"da": F.when(possible, da).otherwise(0.0), "db": F.when(possible, db).otherwise(0.0)})
    return met.select(
        *keys, "pos", "neg", (F.col("slope") - F.col("da")).alias("slope"), (F.col("intercept") - F.col("db")).alias("intercept"),
        (F.col("moving") & (F.abs("da") + F.abs("db") >= tolerance)).alias("moving"), (F.col("iterations") + F.col("moving").cast("int")).alias("iterations"),
    )


def recalibrated(rows: DataFrame, fits: DataFrame, by: Sequence[str] = (), at: str = "event_ts", score: str = "score", name: str = "probability") -> DataFrame:
    """Adds ``name``: the score under the fit as of the row's day; null on days without one."""
    keys = [*by, "as_of"]
    met = _matched(rows.withColumn("as_of", F.to_date(at)), fits.select(*keys, F.col("slope").alias("__slope"), F.col("intercept").alias("__intercept")), keys, "left")
    return met.withColumn(name, sigmoid(F.col("__slope") * F.col(score) + F.col("__intercept"))).drop("as_of", "__slope", "__intercept")
