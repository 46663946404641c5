"""Isotonic fits merged over ranges, and as-of joins, against one pass over everything."""

import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import calibration, steps

ORDERS = {
    "rising": lambda i, n, rng: i / n,
    "falling": lambda i, n, rng: 1 - i / n,
    "noise": lambda i, n, rng: rng.random(),
    "saw": lambda i, n, rng: (i % 37) / 37,
    "hill": lambda i, n, rng: 1 - abs(2 * i / n - 1),
    "valley": lambda i, n, rng: abs(2 * i / n - 1),
    "halves": lambda i, n, rng: (2 * i % n) / n,
    "flat": lambda i, n, rng: 0.5,
    "labels": lambda i, n, rng: float(rng.random() < i / n),
    "last block low": lambda i, n, rng: i / n if i < n - 1 else 0.0,
    "first block high": lambda i, n, rng: i / n if i else 1.0,
}


def groups_of(spark, rows):
    return spark.createDataFrame(rows, "score double, pos double, neg double").repartition(5)


@pytest.mark.parametrize(("name", "ranges"), [*((name, 7) for name in sorted(ORDERS)), ("falling", 1), ("saw", 2), ("noise", 16)])
def test_merged_ranges_equal_one_pool(spark, name, ranges):
    rng, n = random.Random(3), 400
    weights = [rng.choice([0.5, 1.0, 3.0]) for _ in range(n)]
    rows = [(float(i), w * ORDERS[name](i, n, rng), 0.0) for i, w in enumerate(weights)]
    rows = [(s, p, w - p) for (s, p, _), w in zip(rows, weights, strict=True)]
    found = calibration.isotonic_table(groups_of(spark, rows + [(-5.0, 0.0, 0.0)]), ranges, few_blocks=rng.choice([0, 0, 0, 1000])).orderBy("upper").collect()
    expected = calibration.pool((s, p, p + q) for s, p, q in rows)
    at = lambda blocks, score: blocks[min(bisect.bisect_left([b[0] for b in blocks], score), len(blocks) - 1)]
    whole, merged = [(u, p / w) for u, p, w in expected], [(r.upper, r.value) for r in found]
    assert np.allclose([at(merged, s)[1] for s, _, _ in rows], [at(whole, s)[1] for s, _, _ in rows], atol=1e-12)
    assert np.isclose(sum(r.weight for r in found), sum(weights)) and all(a.value <= b.value + 1e-12 for a, b in zip(found, found[1:]))


def test_many_steps_stay_in_a_table(spark):
    """A function that rises all the way keeps every score as a block; none of them passes the driver."""
    n = 300_000
    groups = spark.range(n).select((F.col("id") / n).alias("score"), (F.col("id") + 0.5).alias("pos"), (n - F.col("id") - 0.5).alias("neg"))
    fitted = calibration.fit_isotonic(groups, most_steps=1000)
    assert isinstance(fitted, calibration.StepTable) and fitted.steps == n
    again = calibration.calibrator_from({"method": fitted.method, "path": fitted.path, "steps": fitted.steps})
    found = calibration.calibrated(groups.select("score"), again, "score", "p")
    assert found.count() == n and found.agg(F.max(F.abs(F.col("p") - F.col("score") - 0.5 / n))).first()[0] < 1e-9


def test_a_literal_and_a_table_agree(spark):
    rng = random.Random(8)
    groups = groups_of(spark, [(round(rng.random(), 3), float(rng.random() < 0.5), 1.0) for _ in range(500)]).groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([None, -1.0, 2.0, *(rng.random() for _ in range(300))])], "i int, s double")
    few, many = calibration.fit_isotonic(groups), calibration.fit_isotonic(groups, most_steps=0)
    a, b = (dict(calibration.calibrated(rows, c, "s", "p").select("i", "p").collect()) for c in (few, many))
    assert a.keys() == b.keys() and a[0] is None and b[0] is None
    assert all(abs(a[i] - b[i]) < 1e-12 for i in a if i)
    assert isinstance(calibration.fit_isotonic(groups.limit(0), most_steps=0), calibration.Isotonic)


@pytest.mark.parametrize("count", [0, 1, 3, 400])
def test_asof_join_equals_bisection(spark, count):
    rng = random.Random(count)
    uppers = sorted({round(rng.uniform(-5, 5), 2) for _ in range(count)})
    ladder = [(u, float(k)) for k, u in enumerate(uppers)]
    scores = [None] * 50 + [0.5] * 3000 + [-9.0, 9.0, float("inf"), -float("inf")] + uppers + [round(rng.uniform(-6, 6), 2) for _ in range(800)]
    rows = spark.createDataFrame([(i, s, "kept") for i, s in enumerate(scores)], "i int, s double, value string").repartition(6)
    table = spark.createDataFrame(ladder, "upper double, value double").repartition(3)
    found = {r.i: r for r in steps.asof_join(rows, table, "s", "p").collect()}
    assert len(found) == len(scores) and all(r.value == "kept" for r in found.values())
    for i, s in enumerate(scores):
        want = None if s is None else 0.5 if not uppers else float(min(bisect.bisect_left(uppers, s), len(uppers) - 1))
        assert found[i].p == want


def test_hot_keys_join_whole(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(5000)], "i int, k string")
    table = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(0, 5000, 12)), ("nobody", 7)], "k string, v int")
    counted = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    found = {r.i: r.v for r in steps.join_by_key(rows, table, "k", counted).collect()}
    known = dict(table.collect())
    assert found == {r.i: known.get(r.k) for r in rows.collect()}
