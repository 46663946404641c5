"""Rolling recalibration, versioned bands, label maturity on streams and stage timers."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.config import DENSE_FEATURES, RAW_COLUMNS
from quillon.operators import bands, calibration, metrics, policy, rolling, training
from quillon.streaming import serving

START = datetime(2026, 1, 1, 12)


def timed_rows(spark):
    rng, rows = random.Random(4), []
    for day in range(40):
        for context in ("a", "b", None):
            if context == "b" and 10 <= day < 32:
                continue
            for _ in range(12):
                score = rng.gauss(0, 1)
                label = int(rng.random() < 1 / (1 + np.exp(-(0.5 + day / 40) * score - 0.3))) if context else 1
                rows.append((context, START + timedelta(days=day, minutes=rng.randint(0, 600)), round(score, 2), label, rng.choice([1.0, 2.5])))
    rows += [("a", None, 0.1, 1, 1.0), ("a", START, None, 1, 1.0), ("a", START, 0.5, None, 1.0)]
    return rows, spark.createDataFrame(rows, "context string, event_ts timestamp, score double, label int, weight double").repartition(4)


def test_every_window_equals_a_fit_on_its_rows(spark):
    rows, frame = timed_rows(spark)
    found = {(r.context, r.as_of): r for r in rolling.fit_rolling(frame, ["context"]).collect()}
    expected = {}
    for context, at, score, label, _ in rows:
        if at is not None and score is not None and label is not None:
            for lag in range(3, 17):
                as_of = at.date() + timedelta(days=lag)
                if as_of <= (START + timedelta(days=42)).date():
                    expected.setdefault((context, as_of), 0)
                    expected[context, as_of] += 1
    assert found.keys() == expected.keys()
    for key in [k for i, k in enumerate(sorted(found, key=str)) if i % 9 == 0] + [("b", (START + timedelta(days=25)).date())]:
        context, as_of = key
        lo, hi = as_of - timedelta(days=16), as_of - timedelta(days=2)
        own = frame.filter(F.col("context").eqNullSafe(context)).filter((F.to_date("event_ts") >= F.lit(lo)) & (F.to_date("event_ts") < F.lit(hi))).filter("score is not null and label is not null")
        one = calibration.fit_platt(metrics.score_groups(own))
        assert np.isclose(found[key].slope, one.slope, atol=1e-9) and np.isclose(found[key].intercept, one.intercept, atol=1e-9)
    # One label only: the smoothed share.
    alone = [r for (c, _), r in found.items() if c is None]
    assert alone and all(r.slope == 0 and r.neg == 0 and r.iterations == 0 for r in alone)
    fits = rolling.fit_rolling(frame, ["context"])
    applied = rolling.recalibrated(frame, fits, ["context"]).filter("score is not null and event_ts is not null").collect()
    for r in applied[::50]:
        fit = found.get((r.context, r.event_ts.date()))
        assert (r.probability is None) == (fit is None)
        if fit:
            assert np.isclose(r.probability, 1 / (1 + np.exp(-(fit.slope * r.score + fit.intercept))))
    assert rolling.fit_rolling(frame.limit(0), ["context"]).count() == 0


def test_one_version_equals_the_fixed_bands(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["bank_marketing", "fraud_policy", "loan_policy"]), START, p) for p in [0.0, 1.0, *(round(rng.random(), 2) for _ in range(300))]]
    frame = spark.createDataFrame(rows, "task_context string, event_ts timestamp, probability double")
    columns = ["task_context", "probability", "action", "action_reason", "threshold_value", "manual_review_required", "decision_policy_version"]
    one, two = (sorted(map(tuple, d.select(*columns).collect())) for d in (policy.decide(frame), bands.decide_by_version(frame, bands.fixed_bands(spark))))
    assert one == two


def version(since, *ends, context="c", name="v", skip=None):
    edges = [None, *ends, None]
    rows = [(context, since, name, lo, hi, f"a{i}", "r", 0.5, False) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
    return [r for i, r in enumerate(rows) if i != skip]


def test_decisions_take_the_bands_in_force(spark):
    later = START + timedelta(days=5)
    table = spark.createDataFrame(version(START, 0.5) + version(later, 0.2, 0.8, name="w"), bands.BANDS)
    rows = [("c", START - timedelta(seconds=1), 0.4), ("c", START, 0.4), ("c", later - timedelta(seconds=1), 0.5), ("c", later, 0.5), ("c", later, 0.8), ("c", later, 0.1), ("c", later, None), ("c", None, 0.3), ("d", later, 0.3), (None, later, 0.3)]
    found = bands.decide_by_version(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, task_context string, event_ts timestamp, probability double"), table).orderBy("i").collect()
    assert [(r.action, r.decision_policy_version) for r in found] == [(None, None), ("a0", "v"), ("a1", "v"), ("a1", "w"), ("a2", "w"), ("a0", "w"), *[(None, None)] * 4]


@pytest.mark.parametrize(
    ("rows", "fault"),
    [
        (version(START, 0.3, 0.6, skip=1), "gap"),
        (version(START, 0.3) + [("c", START, "v", 0.1, 0.3, "x", "r", 0.5, False)], "overlaps"),
        (version(START, 0.3, skip=1), "highest"),
        (version(START, 0.3, skip=0), "lowest"),
        (version(START, 0.3) + version(START, 0.3, name="w"), "two versions"),
        (version(START, 0.6, 0.3), "empty|overlaps|gap"),
        (version(None, 0.3), "lacks"),
    ],
)
def test_gaps_and_overlaps_are_errors(spark, rows, fault):
    with pytest.raises(ValueError, match=fault):
        bands.checked(spark.createDataFrame(rows, bands.BANDS))


def write_lines(folder, name, rows, keys):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(keys, r, strict=True))) for r in rows) + "\n")


def test_label_maturity_over_batches(spark, tmp_path):
    """Late, missing and repeated labels, in files that come one by one, against a batch over all of them."""
    at = lambda hours: (START + timedelta(hours=hours)).strftime("%Y-%m-%d %H:%M:%S")
    for k in range(6):
        write_lines(tmp_path / "events", f"f{k}", [(f"e{k}{i}", at(24 * k + i)) for i in range(8)], ("event_id", "event_ts"))
        # Of each eight events: labels in time (one of them twice), at the last moment, too late, and none.
        labels = [(f"l{k}{i}", f"e{k}{i}", at(24 * k + i + d), i % 2) for i, d in enumerate((1, 5, 24, 25, 39))]
        write_lines(tmp_path / "labels", f"f{k}", labels + labels[:1], ("label_event_id", "parent_event_id", "label_ts", "label"))
    write_lines(tmp_path / "events", "f9", [("last", at(24 * 9))], ("event_id", "event_ts"))
    write_lines(tmp_path / "labels", "f9", [("l9", "nobody", at(24 * 9), 1)], ("label_event_id", "parent_event_id", "label_ts", "label"))
    stream = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/{name}")
    events, labels = stream("events", "event_id string, event_ts timestamp"), stream("labels", "label_event_id string, parent_event_id string, label_ts timestamp, label int")
    found = serving.run_to_files(spark, serving.matched_labels(events, labels, unlabelled=True).select("event_id", "label"), "maturity").collect()
    expected = {(f"e{k}{i}", i % 2 if i < 3 else None) for k in range(6) for i in range(8)}
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    matched = serving.run_to_files(spark, serving.matched_labels(events, labels).select("event_id", "label"), "matched").collect()
    assert {tuple(r) for r in matched} == {e for e in expected if e[1] is not None} and len(matched) == 18


def test_timed_steps_of_a_request_stream(spark, tmp_path):
    cells = {n: "1" if n in ("age", "balance", "day", "duration", "campaign", "pdays", "previous") else "x" for n in RAW_COLUMNS if n != "y"}
    for k in range(3):
        rows = [json.dumps({"request_id": f"r{i % 2}", "event_id": f"e{k}{i}", "event_ts": "2026-01-01T00:00:00Z", "features": cells}) for i in range(4 + k)] + ["{}"]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join(rows))
    model = training.Model(0.1, [0.01] * 7, dense_names=list(DENSE_FEATURES), model_version="m")
    folder, out = f"file://{tmp_path}/in", {}
    for timed in (True, False):
        target = f"file://{tmp_path}/out{timed}"
        query = serving.serve(spark, folder, target, f"{target}/checkpoint", model, calibration.Platt(1.0, 0.0), timed=timed, files_per_batch=1)
        query.awaitTermination()
        out[timed] = sorted(map(tuple, spark.read.json(f"{target}/decisions").select("decision_id", "action", "calibrated_probability").collect()))
    assert out[True] == out[False] and len(out[True]) == 15
    latencies = serving.stage_latencies(spark, f"file://{tmp_path}/outTrue")
    assert latencies.count() == 15 and latencies.filter("batch_ms <= 0").count() == 0
    found = serving.stage_percentiles(latencies).orderBy("place").collect()
    assert [r.stage for r in found] == list(serving.STAGES) and all(r.batches == 3 and r.requests == 18 and r.p50_ms <= r.p99_ms for r in found)
    steps = {r.step for r in serving.progress_rows(spark, query).collect()}
    assert {"addBatch", "triggerExecution"} <= steps
