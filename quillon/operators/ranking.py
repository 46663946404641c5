"""Second-stage ranking: hybrid features, ranks, a shortlist with exploration, and its metrics.

Candidates have ``split``, ``candidate_id``, ``label``, ``stage1_raw_score``,
``stage1_calibrated_probability``, ``reranker_probability`` and ``uncertainty_score``.  Only the
first entries of each order matter, and Spark keeps no more of each task's rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DENSE_FEATURES
from ..functions.columns import safe_rate, uncertainty
from ..sources.scratch import stage

INTERACTIONS = (
    ("age_balance", "age", "balance"),
    ("balance_campaign", "balance", "campaign"),
    ("campaign_previous", "campaign", "previous"),
    ("pdays_flag", "pdays", "prior_contact_flag"),
    ("balance_flag", "balance", "prior_contact_flag"),
    ("raw_balance", "stage1_raw_score", "balance"),
    ("calibrated_campaign", "stage1_calibrated_probability", "campaign"),
    ("uncertainty_previous", "uncertainty_score", "previous"),
)
STAGE1 = ("stage1_raw_score", "stage1_probability", "stage1_calibrated_probability", "uncertainty_score")
HYBRID_FEATURES = (*STAGE1, *DENSE_FEATURES, *(name for name, _, _ in INTERACTIONS))


def compress(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def with_hybrid_features(rows: DataFrame) -> DataFrame:
    """``rows`` has the first three stage-one columns and one column for each dense feature."""
    scored = rows.withColumn("uncertainty_score", uncertainty(F.col("stage1_calibrated_probability")))
    return scored.withColumns({name: compress(F.col(a) * F.col(b)) for name, a, b in INTERACTIONS})


def _order(*columns: str) -> list[Column]:
    return [F.col(c).desc() for c in columns] + [F.col("candidate_id").asc()]


STAGE1_ORDER = ("stage1_calibrated_probability", "stage1_raw_score")
RERANKER_ORDER = ("reranker_probability", "stage1_calibrated_probability")


EXPLORE_ORDER = ("uncertainty_score", "reranker_probability")
#: The lists that are taken from all candidates: their orders, and how many times ``k`` of each are kept.  The shortlist
#: explores below its first entries, at most ``k`` of which may stand in front of the exploration order too.
LISTS = {"stage1": (STAGE1_ORDER, 1), "reranker": (RERANKER_ORDER, 1), "explore": (EXPLORE_ORDER, 2)}


#: Most rows of lists, and most splits' chosen keys, that are broadcast to the candidates.
MOST_BROADCAST, MOST_SPLITS = 1_000_000, 10_000


def top_lists(candidates: DataFrame, k: int = 25, lists: Sequence[str] = tuple(LISTS)) -> DataFrame:
    """(list, place, candidate columns): the first entries of each split in each order.

    Orders are taken over keys and ids alone, in one pass, in which each task keeps no more than these of its own
    rows; the chosen few then fetch their columns by id."""
    keys = [F.struct(F.lit(name).alias("list"), F.lit(k * LISTS[name][1]).alias("most"), *(F.col(c).cast("double").alias(f"key{i}") for i, c in enumerate(LISTS[name][0]))) for name in lists]
    entered = candidates.select("split", "candidate_id", F.inline(F.array(*keys)))
    order = Window.partitionBy("split", "list").orderBy(F.col("key0").desc(), F.col("key1").desc(), F.col("candidate_id").asc())
    found = entered.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k * max(LISTS[name][1] for name in lists)).filter(F.col("place") <= F.col("most"))
    found = stage(found.select("split", "candidate_id", "list", "place"), "top-lists")
    few = F.broadcast(found) if found.count() <= MOST_BROADCAST else found
    return candidates.join(few, ["split", "candidate_id"]).select(*candidates.columns, "place", "list")


def exploration_slots(k: Column, rate: float) -> Column:
    return F.least(k, F.bround(k * F.lit(rate)).cast("int"))


def _sizes(candidates: DataFrame, k: int, rate: float) -> DataFrame:
    sizes = candidates.groupBy("split").agg(F.count("*").alias("candidate_count"))
    return sizes.withColumn("k", F.least(F.col("candidate_count"), F.lit(k)).cast("int")).withColumn("slots", exploration_slots(F.col("k"), rate))


def _chosen(tops: DataFrame, sizes: DataFrame, rate: float) -> DataFrame:
    placed = tops.join(sizes, "split")
    exploit = placed.filter("list = 'reranker' and place <= k - slots").withColumn("was_explored", F.lit(False))
    rest = placed.filter("list = 'explore'").join(exploit.select("split", "candidate_id"), ["split", "candidate_id"], "left_anti")
    rest = rest.withColumn("place", F.row_number().over(Window.partitionBy("split").orderBy("place"))).filter("place <= slots").withColumn("was_explored", F.lit(True))
    bonus = F.when(F.col("was_explored"), F.col("uncertainty_score") * rate).otherwise(0.0)
    final = exploit.unionByName(rest).drop("list", "place").withColumn("exploration_bonus", bonus).withColumn("final_score", F.col("reranker_probability") + F.col("exploration_bonus"))
    return final.withColumn("final_rank", F.row_number().over(Window.partitionBy("split").orderBy(*_order("final_score", "reranker_probability"))))


def shortlist(candidates: DataFrame, k: int = 25, rate: float = 0.15) -> DataFrame:
    """The ``min(k, n)`` chosen candidates of each split: the best by the reranker and, in the
    exploration slots, the least certain of the others, whose score gets a bonus."""
    return _chosen(top_lists(candidates, k, ("reranker", "explore")), _sizes(candidates, k, rate), rate)


def first_by_stage1(candidates: DataFrame, k: int = 25) -> DataFrame:
    """The first candidates of each split by stage one, with both ranks."""
    return with_ranks_of(top_lists(candidates, k, ("stage1",)).drop("list", "place"), candidates)


def _gain(rank: Column) -> Column:
    return (F.pow(F.lit(2.0), F.col("label")) - 1) / F.log2(rank + 1)


def _list_metrics(rows: DataFrame, name: str, rank: str, expected: str) -> DataFrame:
    """Rates, expected positives and discounted gain of one list, by split."""
    ideal = F.row_number().over(Window.partitionBy("split").orderBy(F.col("label").desc(), rank))
    return rows.withColumn("ideal", ideal).groupBy("split").agg(
        F.sum("label").alias(f"{name}_positives"), F.avg(F.col("label").cast("double")).alias(f"{name}_positive_rate"), F.sum(expected).alias(f"{name}_expected_positives"),
        safe_rate(F.sum(_gain(F.col(rank))), F.sum(_gain(F.col("ideal")))).alias(f"{name}_ndcg"),
    )


def ranking_metrics(candidates: DataFrame, k: int = 25, rate: float = 0.15) -> DataFrame:
    """One row for each split: rates, expectations and discounted gains at k for the three orders, lifts,
    overlaps and shifts.  All candidates are read for the sizes, for the lists and for the ranks."""
    sizes, tops = _sizes(candidates, k, rate), stage(top_lists(candidates, k), "top-lists")
    final = _chosen(tops, sizes, rate)
    chosen = with_ranks_of(final, candidates).groupBy("split").agg(
        F.first("candidate_count").alias("candidate_count"), F.first("k").alias("k"), F.count_if("was_explored").alias("explored"),
        safe_rate(F.sum(F.when(F.col("was_explored"), F.col("label"))), F.count_if("was_explored")).alias("explored_positive_rate"),
        safe_rate(F.sum(F.when(~F.col("was_explored"), F.col("label"))), F.count_if(~F.col("was_explored"))).alias("exploited_positive_rate"),
        F.avg("final_score").alias("mean_final_score"),
        safe_rate(F.count_if(F.col("stage1_rank") <= F.col("k")), F.first("k")).alias("overlap_with_stage1"),
        safe_rate(F.count_if(F.col("reranker_rank") <= F.col("k")), F.first("k")).alias("overlap_with_reranker"),
        F.avg(F.col("stage1_rank") - F.col("final_rank")).alias("mean_shift_from_stage1"),
        F.avg(F.col("reranker_rank") - F.col("final_rank")).alias("mean_shift_from_reranker"),
        safe_rate(F.count_if("was_explored"), F.lit(k)).alias("exploration_rate"),
    )
    lists = [
        _list_metrics(tops.filter("list = 'stage1'"), "stage1", "place", "stage1_calibrated_probability"), _list_metrics(tops.filter("list = 'reranker'"), "reranker", "place", "reranker_probability"),
        _list_metrics(final, "final", "final_rank", "stage1_calibrated_probability"),
    ]
    out = chosen
    for part in lists:
        out = out.join(part, "split")
    out = out.withColumn("ndcg", F.col("final_ndcg"))
    return out.withColumns({"lift_vs_stage1": F.col("final_positive_rate") - F.col("stage1_positive_rate"), "lift_vs_reranker": F.col("final_positive_rate") - F.col("reranker_positive_rate")})


def with_ranks_of(chosen: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds both full ranks to chosen candidates (at most ``k`` a split): each candidate finds its place
    among its split's sorted chosen keys, candidates are counted by place, and the counts added up.
    No split is sorted as a whole and no row is multiplied."""
    orders = {"stage1_rank": STAGE1_ORDER, "reranker_rank": RERANKER_ORDER}
    key = lambda order: F.struct(*((-F.col(c).cast("double")).alias(f"k{i}") for i, c in enumerate(order)), F.col("candidate_id").alias("id"))
    keys = chosen.groupBy("split").agg(*(F.array_sort(F.collect_list(key(order))).alias(f"__{name}") for name, order in orders.items()))
    keys = stage(keys, "chosen-keys")
    few = F.broadcast(keys) if keys.count() <= MOST_SPLITS else keys
    placed = candidates.select("split", *(key(order).alias(f"__row_{name}") for name, order in orders.items())).join(few, "split")
    # Counted by the number of chosen keys in front: those with no more than j stand at or before the j-th key.
    before = lambda name: lambda x: x < F.col(f"__row_{name}")
    fronts = [F.size(F.filter(f"__{name}", before(name))).alias(name) for name in orders]
    counts = placed.select("split", *fronts).groupBy("split", *orders).agg(F.count("*").alias("n"))
    out = chosen
    for name in orders:
        sums = counts.groupBy("split", name).agg(F.sum("n").alias("n")).withColumn("rank", F.sum("n").over(Window.partitionBy("split").orderBy(name)))
        entries = keys.select("split", F.posexplode(f"__{name}").alias("j", "entry")).select("split", "j", F.col("entry.id").alias("candidate_id"))
        met = entries.join(sums, "split").filter(F.col(name) <= F.col("j")).groupBy("split", "candidate_id").agg(F.max("rank").alias(name))
        out = out.join(met, ["split", "candidate_id"])
    return out


OVERALL = (
    "final_positive_rate", "stage1_positive_rate", "reranker_positive_rate", "ndcg", "stage1_ndcg", "reranker_ndcg", "final_ndcg", "lift_vs_stage1", "lift_vs_reranker", "exploration_rate",
)


def overall(metrics: DataFrame, columns: Sequence[str] = OVERALL) -> DataFrame:
    """Means over splits, weighted by candidates (an empty split weighs one)."""
    w = F.when(F.col("candidate_count") > 0, F.col("candidate_count")).otherwise(1).cast("double")
    return metrics.agg(*(safe_rate(F.sum(F.col(c) * w), F.sum(w)).alias(c) for c in columns))


def readiness(metrics: DataFrame) -> DataFrame:
    """Ready if the shortlist's lift is not negative on validation and above -0.02 on test."""
    lift = lambda split: F.coalesce(F.max(F.when(F.col("split") == split, F.col("lift_vs_stage1"))), F.lit(0.0))
    reasons = F.array_compact(F.array(F.when(F.col("validation_lift") < 0, "validation_reranker_lift_vs_stage1"), F.when(F.col("test_lift") < -0.02, "test_reranker_lift_vs_stage1")))
    return metrics.agg(lift("validation").alias("validation_lift"), lift("test").alias("test_lift")).withColumn("reasons", reasons).withColumn("ready", F.size("reasons") == 0)
