"""Weighted metrics of scored rows, whole or by group.

Rows have ``label`` (0/1), ``score`` and ``weight``.  Rows of equal score are added up first; sums
over lower scores are taken inside ranges of scores and over the ranges, so no task sorts all
distinct scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clipped, cross_entropy, safe_rate
from ..sources.scratch import stage
from .prefix import sums_before


def score_groups(rows: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score", weight: str = "weight") -> DataFrame:
    """(by, score, pos, neg, n, ones): weight of either label, rows and positive rows at each distinct score."""
    w, y = F.col(weight).cast("double"), F.col(label)
    return rows.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.when(y == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(y == 1, 0.0).otherwise(w)).alias("neg"), F.count("*").alias("n"), F.count_if(y == 1).alias("ones")
    )


def cumulated(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``pos_before`` and ``neg_before``: sums over the lower scores of the group."""
    return sums_before(groups, by, ["score"], pos_before=F.col("pos"), neg_before=F.col("neg"))


def _with_totals(placed: DataFrame, by: Sequence[str]) -> DataFrame:
    totals = placed.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return placed.join(totals, list(by)) if by else placed.crossJoin(F.broadcast(totals))


def _roc_auc() -> Column:
    area = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    p, n = F.sum("pos"), F.sum("neg")
    return F.when(F.coalesce(p + n, F.lit(0.0)) <= 0, 0.0).when((p <= 0) | (n <= 0), 0.5).otherwise(F.try_divide(area, p * n))


def _pr_auc() -> Column:
    """Over descending scores: what comes at or before a score is all that is not below it."""
    taken = F.col("all_pos") - F.col("pos_before")
    precision = F.try_divide(taken, taken + F.col("all_neg") - F.col("neg_before"))
    return F.coalesce(F.try_divide(F.sum(precision * F.col("pos")), F.sum("pos")), F.lit(0.0))


def roc_auc(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ties count half; 0.5 where one label is missing, 0 where both are."""
    return cumulated(groups, by).groupBy(*by).agg(_roc_auc().alias("roc_auc"))


def pr_auc(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Step area over descending distinct scores; 0 without positives."""
    return _with_totals(cumulated(groups, by), by).groupBy(*by).agg(_pr_auc().alias("pr_auc"))


def curves(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both areas from one order of the scores."""
    return _with_totals(cumulated(groups, by), by).groupBy(*by).agg(_roc_auc().alias("roc_auc"), _pr_auc().alias("pr_auc"))


def bin_of(score: Column, bins: int) -> Column:
    """The product is truncated, so a score of 1 falls into the last bin."""
    return F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int")


def calibration_bins(groups: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """(by, bin, weight, count, mean_score, observed, gap) of the bins with weight; ``groups`` as from ``score_groups``
    or ``bins_of_rows``."""
    w = F.col("pos") + F.col("neg")
    placed = groups if "bin" in groups.columns else groups.withColumn("bin", bin_of(F.col("score"), bins))
    return (
        placed
        .groupBy(*by, "bin")
        .agg(F.sum(w).alias("weight"), F.sum(w * F.col("score")).alias("s"), F.sum("pos").alias("p"))
        .filter("weight > 0")
        .select(*by, "bin", "weight", F.floor("weight").cast("long").alias("count"), (F.col("s") / F.col("weight")).alias("mean_score"), (F.col("p") / F.col("weight")).alias("observed"))
        .withColumn("gap", F.abs(F.col("mean_score") - F.col("observed")))
    )


def bins_of_rows(rows: DataFrame, by: Sequence[str] = (), bins: int = 10, label: str = "label", score: str = "score", weight: str = "weight") -> DataFrame:
    """What ``calibration_bins`` needs, added up by bin instead of by score: a row for each bin."""
    w, y, p = F.col(weight).cast("double"), F.col(label), F.col(score)
    share = F.try_divide(F.sum(w * p), F.sum(w))
    return rows.groupBy(*by, bin_of(p, bins).alias("bin")).agg(F.sum(F.when(y == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(y == 1, 0.0).otherwise(w)).alias("neg"), share.alias("score"))


def calibration_errors(groups: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Expected and maximal calibration error."""
    table = calibration_bins(groups, by, bins)
    return table.groupBy(*by).agg(safe_rate(F.sum(F.col("gap") * F.col("weight")), F.sum("weight")).alias("ece"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("mce"))


def losses(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted log loss, Brier score, positive rate and mean score; the last two of rows as well, and
    the number of rows."""
    p, w = F.col("score"), F.col("pos") + F.col("neg")
    loss = -(F.col("pos") * F.log(clipped(p)) + F.col("neg") * F.log(1 - clipped(p)))
    brier = F.col("pos") * (1 - p) * (1 - p) + F.col("neg") * p * p
    return groups.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("example_count"),
        safe_rate(F.sum(loss), F.sum(w)).alias("log_loss"),
        safe_rate(F.sum(brier), F.sum(w)).alias("brier_score"),
        safe_rate(F.sum("pos"), F.sum(w)).alias("weighted_positive_rate"),
        safe_rate(F.sum(p * w), F.sum(w)).alias("weighted_mean_score"),
        safe_rate(F.sum("ones"), F.sum("n")).alias("positive_rate"),
        safe_rate(F.sum(p * F.col("n")), F.sum("n")).alias("mean_prediction"),
    )


def report(rows: DataFrame, by: Sequence[str] = (), bins: int = 10, **names: str) -> DataFrame:
    """One row for each group with all metrics, from one table of scores that are added up once."""
    groups = stage(score_groups(rows, by, **names), "scores")
    parts = [losses(groups, by), curves(groups, by), calibration_errors(groups, by, bins)]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, list(by), "left") if by else out.crossJoin(part)
    return out


def row_loss(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return rows.withColumn("cross_entropy", cross_entropy(F.col(label), F.col(score)))
