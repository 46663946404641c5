"""Platt and isotonic calibration, and the choice between them.

Fits work on rows added up by distinct score.  Platt's Newton steps each take five sums from the
cluster; isotonic blocks are pooled inside ranges of scores and the ranges are merged pairwise, the
blocks staying in a table.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import sigmoid, step_lookup
from ..sources import scratch
from . import metrics, prefix, steps

#: Most steps of an isotonic fit that is held as a literal, and most blocks that one task pools.
MOST_STEPS, FEW_BLOCKS = 10_000, 100_000


@dataclass(frozen=True)
class Platt:
    slope: float
    intercept: float
    method: str = "platt"

    def apply(self, score: Column) -> Column:
        return sigmoid(self.slope * score + self.intercept)


@dataclass(frozen=True)
class Isotonic:
    thresholds: tuple[float, ...]
    values: tuple[float, ...]
    method: str = "isotonic"

    def apply(self, score: Column) -> Column:
        return step_lookup(score, self.thresholds, self.values)


@dataclass(frozen=True)
class StepTable:
    """An isotonic fit too long for a literal: a Parquet table of (upper, value) in a shared folder."""

    path: str
    steps: int
    method: str = "isotonic_table"


def fit_platt(groups: DataFrame, max_iterations: int = 100, tolerance: float = 1e-6, l2: float = 1e-6) -> Platt:
    """``groups`` as from ``metrics.score_groups``."""
    groups = groups.persist()
    try:
        pos, neg = (float(v or 0.0) for v in groups.agg(F.sum("pos"), F.sum("neg")).first())
        prior = (pos + 1) / (pos + neg + 2)
        a, b = 0.0, math.log(prior) - math.log1p(-prior)
        if pos <= 0 or neg <= 0:
            return Platt(a, b)
        s, w = F.col("score"), F.col("pos") + F.col("neg")
        for _ in range(max_iterations):
            p = sigmoid(F.lit(a) * s + F.lit(b))
            curve, error = w * p * (1 - p), w * p - F.col("pos")
            ss, s1, s0, gs, g0 = groups.agg(F.sum(curve * s * s), F.sum(curve * s), F.sum(curve), F.sum(error * s), F.sum(error)).first()
            haa, hab, hbb, ga, gb = l2 + ss, s1, l2 + s0, l2 * a + gs, l2 * b + g0
            determinant = haa * hbb - hab * hab
            if abs(determinant) < 1e-12:
                break
            da, db = (hbb * ga - hab * gb) / determinant, (haa * gb - hab * ga) / determinant
            a, b = a - da, b - db
            if abs(da) + abs(db) < tolerance:
                break
        return Platt(a, b)
    finally:
        groups.unpersist()


def pool(blocks: Iterable[tuple[float, float, float]], stack: list[tuple[float, float, float]] | None = None) -> list[tuple[float, float, float]]:
    """Adjacent violators pooled: (upper score, positive weight, weight) in order of score, after those of ``stack``."""
    stack = [] if stack is None else stack
    for upper, positive, weight in blocks:
        while stack and stack[-1][1] * weight > positive * stack[-1][2]:
            _, p, w = stack.pop()
            positive, weight = positive + p, weight + w
        stack.append((upper, positive, weight))
    return stack


BLOCKS = "range int, upper double, positive double, weight double"


def _pooled_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a partition that is sorted by score."""
    stack, number = [], 0
    for batch in batches:
        if batch.num_rows:
            number = batch.column(0)[0].as_py()
            pool(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True), stack)
    columns = list(zip(*stack, strict=True)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array([number] * len(stack), pa.int32()), *(pa.array(c, pa.float64()) for c in columns)], ["range", "upper", "positive", "weight"])


def isotonic_table(groups: DataFrame, ranges: int | None = None, few_blocks: int = FEW_BLOCKS) -> DataFrame:
    """(upper, value, weight) of the isotonic fit, a row for each block, in a table from first to last.

    Scores are cut into ranges (at quantiles that Spark samples) and each is pooled by itself.  Then
    neighbouring ranges are merged pairwise, all pairs of a level together.  Where the left range ends
    higher than the right one begins, one block arises: that of the value m for which what the left blocks exceed m
    weighs as much as what the right blocks fall short of it.  Its members are the left blocks above m and
    the right blocks below; the balance is found from sums over the blocks between both ends in order of
    their values.  Only those blocks move; all others stay as they are.  What ``few_blocks`` bounds is pooled
    by one task, with the same result."""
    kept = groups.filter("pos + neg > 0").select(F.col("score").cast("double").alias("score"), "pos", (F.col("pos") + F.col("neg")).alias("weight"))
    ranged = kept.repartitionByRange(ranges, "score") if ranges else kept.repartitionByRange("score")
    local = ranged.sortWithinPartitions("score").select(F.spark_partition_id().alias("range"), "score", "pos", "weight").mapInArrow(_pooled_ranges, BLOCKS)
    blocks = scratch.stage(local, "isotonic-blocks")
    last, count = blocks.agg(F.coalesce(F.max("range"), F.lit(0)), F.count("*")).first()
    if last and count <= few_blocks:
        one = blocks.coalesce(1).sortWithinPartitions("upper").select(F.lit(0).alias("range"), "upper", "positive", "weight").mapInArrow(_pooled_ranges, BLOCKS)
        pooled = scratch.stage(one, "isotonic-blocks")
        scratch.drop_table(blocks)
        blocks, last = pooled, 0
    level = 0
    while last >> level:
        merged = _merge_level(blocks, level)
        if merged is not None:
            scratch.drop_table(blocks)
            blocks = merged
        level += 1
    return blocks.select("upper", (F.col("positive") / F.col("weight")).alias("value"), "weight")


def _merge_level(blocks: DataFrame, level: int) -> DataFrame | None:
    """The blocks after merging the pairs of a level; None where all pairs are in order already."""
    paired = blocks.withColumns({"pair": F.shiftright("range", level + 1), "left": F.shiftright("range", level).bitwiseAND(1) == 0, "v": F.col("positive") / F.col("weight")})
    ends = paired.groupBy("pair").agg(F.max(F.when(F.col("left"), F.col("v"))).alias("top"), F.min(F.when(~F.col("left"), F.col("v"))).alias("low"))
    crossed = scratch.stage(ends.filter("top > low"), "isotonic-pairs")
    if crossed.isEmpty():
        scratch.drop_table(crossed)
        return None
    between = paired.join(crossed, "pair").filter((F.col("left") & (F.col("v") > F.col("low"))) | (~F.col("left") & (F.col("v") < F.col("top"))))
    side = lambda own, column: F.sum(F.when(F.col("left") == own, F.col(column)).otherwise(0.0))
    values = between.groupBy("pair", "v").agg(side(True, "weight").alias("lw"), side(True, "positive").alias("lp"), side(False, "weight").alias("rw"), side(False, "positive").alias("rp"))
    names = ("lw", "lp", "rw", "rp")
    placed = prefix.sums_before(values, ["pair"], ["v"], **{f"{n}_before": F.col(n) for n in names})
    totals = placed.groupBy("pair").agg(F.sum("lw").alias("all_lw"), F.sum("lp").alias("all_lp"))
    upto = {n: F.col(f"{n}_before") + F.col(n) for n in names}
    above = (F.col("all_lp") - upto["lp"]) - F.col("v") * (F.col("all_lw") - upto["lw"])
    below = F.col("v") * upto["rw"] - upto["rp"]
    # The excess over v falls and the shortfall rises with v: m lies just above the last value where the former is larger.
    cuts = placed.join(totals, "pair").groupBy("pair").agg(F.coalesce(F.max(F.when(above >= below, F.col("v"))), F.min("v")).alias("cut"))
    marked = paired.join(scratch.stage(cuts, "isotonic-cuts"), "pair", "left")
    member = F.coalesce(F.when(F.col("left"), F.col("v") > F.col("cut")).otherwise(F.col("v") <= F.col("cut")), F.lit(False))
    names = ("range", "upper", "positive", "weight")
    pooled = marked.filter(member).groupBy("pair").agg(F.max("upper").alias("upper"), F.sum("positive").alias("positive"), F.sum("weight").alias("weight"))
    pooled = pooled.select(F.shiftleft("pair", level + 1).cast("int").alias("range"), *names[1:])
    return scratch.stage(marked.filter(~member).select(*names).unionByName(pooled), "isotonic-blocks")


def fit_isotonic(groups: DataFrame, most_steps: int = MOST_STEPS) -> Isotonic | StepTable:
    """A fit of at most ``most_steps`` blocks as a literal; a longer one stays in a table, with the same results."""
    table = isotonic_table(groups)
    count = table.count()
    if count > most_steps:
        path = scratch.new_path(groups.sparkSession, "calibrator")
        table.write.parquet(path)
        return StepTable(path, count)
    if not count:
        return Isotonic((0.0,), (0.5,))
    found = table.orderBy("upper").collect()
    return Isotonic(tuple(r.upper for r in found), tuple(r.value for r in found))


def calibrated(rows: DataFrame, calibrator: Platt | Isotonic | StepTable, source: str, name: str) -> DataFrame:
    """Adds ``name``, the calibrated ``source``, by an expression or by a join to the table of steps."""
    if isinstance(calibrator, StepTable):
        return steps.asof_join(rows, rows.sparkSession.read.parquet(calibrator.path), source, name)
    return rows.withColumn(name, calibrator.apply(F.col(source)))


def calibrator_from(found: dict) -> Platt | Isotonic | StepTable:
    """The calibrator of a document; an unknown method is an error."""
    if found["method"] == "platt":
        return Platt(float(found["slope"]), float(found["intercept"]))
    if found["method"] == "isotonic":
        return Isotonic(tuple(map(float, found["thresholds"])), tuple(map(float, found["values"])))
    if found["method"] == "isotonic_table":
        return StepTable(found["path"], int(found["steps"]))
    raise ValueError(f"unknown calibration method {found['method']}")


@dataclass(frozen=True)
class Selection:
    """The chosen calibrator, what it was chosen by, and which model it belongs to."""

    calibrator: Platt | Isotonic | StepTable
    method: str
    metric: str
    reports: dict[str, dict[str, float]]
    raw: dict[str, float] = field(default_factory=dict)
    calibration_version: str = "calibration_v1"
    model_version: str = ""
    feature_set_version: str = ""
    task_context: str = ""

    @property
    def source(self) -> str:
        """What the calibrator reads: Platt the raw score, isotonic the probability."""
        return "score" if self.method == "platt" else "probability"

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Selection:
        found = json.loads(text)
        return Selection(**(found | {"calibrator": calibrator_from(found["calibrator"])}))


def select(rows: DataFrame, methods: Sequence[str] = ("platt", "isotonic"), metric: str = "validation_ece", label: str = "label", score: str = "score", probability: str = "probability", weight: str = "weight", **stamps: str) -> Selection:
    """Fit every method on the rows and keep the one with the best metric (the first of equals).

    Platt reads the raw score, isotonic the probability.  ``stamps`` are versions that the choice carries."""
    key, reports, fitted, best = metric.removeprefix("validation_"), {}, {}, None
    raw = metrics.report(rows, label=label, score=probability, weight=weight).first().asDict()
    for method in methods:
        if method == "platt":
            source, made = score, fit_platt(metrics.score_groups(rows, label=label, score=score, weight=weight))
        elif method == "isotonic":
            source, made = probability, fit_isotonic(metrics.score_groups(rows, label=label, score=probability, weight=weight))
        else:
            raise ValueError(f"unknown calibration method {method}")
        fitted[method] = made
        found = metrics.report(calibrated(rows, made, source, "__p"), label=label, score="__p", weight=weight).first()
        reports[method] = found.asDict()
        value = reports[method][key]
        better = best is None or (value > reports[best][key] if key in ("roc_auc", "pr_auc") else value < reports[best][key])
        best = method if better else best
    return Selection(fitted[best], best, metric, reports, raw, **stamps)


def evaluate(rows: DataFrame, by: Sequence[str] = (), raw: str = "raw_probability", calibrated: str = "probability", label: str = "label", weight: str = "weight") -> DataFrame:
    """(by, kind, metrics) of raw and calibrated probabilities."""
    found = [metrics.report(rows, by, label=label, score=c, weight=weight).withColumn("kind", F.lit(kind)) for kind, c in (("raw", raw), ("calibrated", calibrated))]
    return found[0].unionByName(found[1])


def method_rows(selection: Selection) -> list[tuple]:
    """(method, selected, log_loss, brier_score, ece, mce, roc_auc, pr_auc) of the raw probabilities and of each method, by name."""
    names = ("log_loss", "brier_score", "ece", "mce", "roc_auc", "pr_auc")
    found = [("raw", selection.raw), *sorted(selection.reports.items())]
    return [(method, method == selection.method, *(report[n] for n in names)) for method, report in found]
