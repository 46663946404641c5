"""Values worked out by hand, and invariants."""

import bisect
import json
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.config import DENSE_FEATURES, POLICIES, AlertThresholds, DatasetConfig, FeatureConfig, RankingConfig, TrainingConfig
from quillon.functions import columns as C
from quillon.operators import calibration, dataset, drift, metrics, monitoring, policy, prefix, profiling, ranking, training
from quillon.plans import jobs
from quillon.sources import files
from quillon.streaming import serving

CSV = """30;admin.;married;secondary;no;1787;no;no;cellular;19;oct;79;1;-1;0;unknown;yes
33;technician;single;tertiary;no;4789;yes;no;cellular;11;may;220;1;339;4;failure;no
41;blue-collar;married;primary;no;150;yes;no;telephone;5;jul;340;2;-1;0;unknown;yes
"""
HEADER = "age;job;marital;education;default;balance;housing;loan;contact;day;month;duration;campaign;pdays;previous;poutcome;y\n"


def scored(spark, labels, scores, weights=None):
    return spark.createDataFrame(list(zip(labels, map(float, scores), weights or [1.0] * len(labels), strict=True)), "label int, score double, weight double")


def made_rows(n=12):
    """The generated rows: one yes in three."""
    lines = []
    for s in range(1, n + 1):
        lines.append(
            f"{25 + s};{'admin.' if s % 2 == 0 else 'technician'};{'married' if s % 3 == 0 else 'single'};secondary;no;{1000 + 10 * s};{'yes' if s % 2 == 0 else 'no'};no;cellular;{10 + s};oct;{60 + s};{1 + s % 3};{-1 if s % 2 == 0 else 42};{s % 4};unknown;{'yes' if s % 3 == 0 else 'no'}"
        )
    return "\n".join(lines) + "\n"


@pytest.fixture
def raw(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(HEADER + CSV.replace("\n", "\n\n", 1) + "; ;;;;;;;;;;;;;;;\n" + HEADER.upper())
    return files.read_raw_csv(spark, str(tmp_path / "raw.csv"))


def test_raw_file(spark, tmp_path, raw):
    assert [(r.row_id, r.age, r.label) for r in raw.orderBy("row_id").collect()] == [(0, "30", 1), (1, "33", 0), (2, "41", 1)]
    assert files.count_raw_rows(spark, str(tmp_path / "raw.csv")) == 3
    (tmp_path / "bad.csv").write_text(CSV + "1;2;3\n" + CSV.splitlines()[0].replace(";yes", ";maybe") + "\n" + '40;"a;b";married;primary;no;;yes;no;telephone;5;jul;340;2;-1;0;unknown; YES \n')
    rows = files.read_raw_csv(spark, str(tmp_path / "bad.csv"), "quarantine").orderBy("row_id").collect()
    assert [r.is_bad for r in rows] == [False] * 3 + [True, True, False]
    assert (rows[5].job, rows[5].balance, rows[5].label) == ("a;b", None, 1)
    with pytest.raises(Exception, match="bad row"):
        files.read_raw_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_dense_vectors(raw):
    expected = [
        [3.433987, 7.488853, 2.995732, 0.693147, 0, 0, 0], [3.526361, 8.474286, 2.484907, 0.693147, 5.828946, 1.609438, 1], [3.737670, 5.017280, 1.791759, 1.098612, 0, 0, 0],
    ]
    for row, want in zip(raw.orderBy("row_id").select(C.dense_vector(FeatureConfig()).alias("d")).collect(), expected, strict=True):
        assert all(abs(a - b) < 1e-6 for a, b in zip(row.d, want, strict=True))


def test_sparse_ids(spark, raw):
    ids = [r.i for r in raw.orderBy("row_id").select(C.hashed_tokens(C.sparse_tokens(FeatureConfig()), 256).alias("i")).collect()]
    assert ids == [[216, 161, 227, 162, 143, 96, 94, 233, 185], [161, 122, 140, 162, 219, 96, 94, 183, 54], [67, 161, 183, 162, 219, 96, 22, 175, 185]]
    large = raw.filter("row_id = 0").select(C.hashed_tokens(C.sparse_tokens(FeatureConfig()), 1_048_576).alias("i")).first().i
    assert large == [732120, 907937, 951011, 851874, 917903, 458592, 959326, 512489, 1009337]
    assert [C.hash_token("job=__MISSING__", n) for n in (256, 1024, 1 << 20)] == [224, 480, 846304]
    pairs = spark.createDataFrame([([161, 5, 161], [1.0, 2.0, 1.0])], "i array<long>, v array<double>").select(C.compressed_pairs(F.col("i"), F.col("v")).alias("p")).first().p
    assert [(p.id, p.value) for p in pairs] == [(161, 2.0), (5, 2.0)]
    with pytest.raises(ValueError):
        C.hashed_tokens(F.col("i"), 0)


def test_splits(spark, raw):
    fractions = spark.createDataFrame([(i,) for i in (0, 1, 2, 9, 10, 100, 1000)], "row_id long").select(C.stable_fraction(C.numbered("evt", F.col("row_id"))).alias("f"))
    assert [r.f for r in fractions.collect()] == [0.4696, 0.4697, 0.4698, 0.4705, 0.4827, 0.1857, 0.2787]
    thirds = DatasetConfig(split_strategy="contiguous", train_ratio=0.34, validation_ratio=0.33, test_ratio=0.33)
    rows = dataset.with_split(dataset.with_identity(raw, thirds), thirds).orderBy("row_id").collect()
    assert [r.split for r in rows] == ["train", "validation", "test"]
    with pytest.raises(ValueError):
        DatasetConfig(train_ratio=0.9)


def test_metrics(spark):
    rows = scored(spark, [0, 1, 0, 1], [0.1, 0.9, 0.2, 0.8])
    found = metrics.report(rows, bins=4).first()
    assert (found.roc_auc, found.pr_auc) == (1.0, 1.0)
    for value, want in ((found.log_loss, 0.164252033486), (found.brier_score, 0.025), (found.ece, 0.15), (found.mce, 0.15)):
        assert abs(value - want) < 1e-9
    auc = lambda y, s, w=None: metrics.roc_auc(metrics.score_groups(scored(spark, y, s, w))).first().roc_auc
    assert auc([0, 1, 1, 0], [0.5, 0.5, 0.9, 0.1]) == 0.875
    assert auc([1, 1], [0.2, 0.3]) == 0.5
    empty = metrics.report(rows.limit(0)).first()
    assert (empty.roc_auc, empty.pr_auc, empty.log_loss, empty.ece) == (0.0, 0.0, 0.0, 0.0)


def test_areas_against_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), rng.choice([-0.5, 0.1, 0.15, 0.5, 0.50001, 0.9, 1.7]), rng.choice([1.0, 2.0, 0.5])) for _ in range(80)]
    pos, neg = [r for r in rows if r[0]], [r for r in rows if not r[0]]
    wins = sum(p[2] * n[2] * (1.0 if p[1] > n[1] else 0.5 if p[1] == n[1] else 0.0) for p in pos for n in neg)
    want = wins / (sum(p[2] for p in pos) * sum(n[2] for n in neg))
    area, precision_area, seen_p, seen, total = 0.0, 0.0, 0.0, 0.0, sum(p[2] for p in pos)
    for s in sorted({r[1] for r in rows}, reverse=True):
        p = sum(r[2] for r in pos if r[1] == s)
        seen_p, seen = seen_p + p, seen + sum(r[2] for r in rows if r[1] == s)
        precision_area += seen_p / seen * p / total
    groups = metrics.score_groups(scored(spark, *zip(*rows, strict=True)))
    area = metrics.roc_auc(groups).first().roc_auc
    assert abs(area - want) < 1e-9 and abs(metrics.pr_auc(groups).first().pr_auc - precision_area) < 1e-9
    flipped = metrics.roc_auc(metrics.score_groups(scored(spark, *zip(*[(y, 1 - s, w) for y, s, w in rows], strict=True)))).first().roc_auc
    assert abs(flipped - (1 - area)) < 1e-9


def test_isotonic(spark):
    fit = lambda s, y: calibration.fit_isotonic(metrics.score_groups(scored(spark, y, s)))
    plain = fit([0.1, 0.2, 0.3, 0.4], [0, 0, 1, 1])
    assert (plain.thresholds, plain.values) == ((0.1, 0.2, 0.3, 0.4), (0, 0, 1, 1))
    at = spark.createDataFrame([(x,) for x in (0.05, 0.15, 0.25, 0.35, 0.45)], "s double").select(plain.apply(F.col("s")).alias("v"))
    assert [r.v for r in at.collect()] == [0, 0, 1, 1, 1]
    pooled = fit([0.1, 0.2, 0.3, 0.35, 0.4], [0, 0, 1, 0, 1])
    assert (pooled.thresholds, pooled.values) == ((0.1, 0.2, 0.35, 0.4), (0, 0, 0.5, 1))
    rng = random.Random(2)
    s = [rng.random() for _ in range(200)]
    found = fit(s, [int(rng.random() < x) for x in s]).values
    assert list(found) == sorted(found) and 0 <= found[0] and found[-1] <= 1
    nothing = calibration.fit_isotonic(metrics.score_groups(scored(spark, [1], [0.5])).limit(0))
    assert (nothing.thresholds, nothing.values) == ((0.0,), (0.5,))


def test_platt(spark):
    rng = random.Random(3)
    s = [rng.uniform(-3, 3) for _ in range(400)]
    y = [int(rng.random() < 1 / (1 + math.exp(-(0.8 * x - 0.3)))) for x in s]
    fit = calibration.fit_platt(metrics.score_groups(scored(spark, y, s)))
    residual = [1 / (1 + math.exp(-(fit.slope * x + fit.intercept))) - v for x, v in zip(s, y, strict=True)]
    assert abs(sum(residual)) < 1e-3 and abs(sum(r * x for r, x in zip(residual, s, strict=True))) < 1e-3
    one = calibration.fit_platt(metrics.score_groups(scored(spark, [1, 1], [0.1, 0.2])))
    assert one.slope == 0.0 and abs(one.intercept - math.log(3)) < 1e-12


def test_routing(spark):
    rows = [("bank_marketing", 0.05), ("bank_marketing", 0.10), ("bank_marketing", 0.30), ("fraud_policy", 0.10), ("fraud_policy", 0.20), ("fraud_policy", 0.80), ("loan_policy", 0.10), ("loan_policy", 0.15), ("loan_policy", 0.25)]
    found = policy.decide(spark.createDataFrame(rows, "task_context string, probability double")).collect()
    assert [r.action for r in found] == ["suppress", "nurture", "prioritize_contact", "approve", "review", "block", "approve", "review", "decline"]
    assert [r.manual_review_required for r in found] == [False, False, False, False, True, True, False, True, True]
    with pytest.raises(Exception, match="unknown context"):
        policy.decide(spark.createDataFrame([("other", 0.1)], "task_context string, probability double")).collect()


def test_drift(spark):
    rows = [(float(v), False) for v in range(1, 11)] + [(float(v), True) for v in (1, 1, 2, 3, 5, 8, 8, 9, 10, 10)]
    frame = spark.createDataFrame(rows, "value double, live boolean")
    assert abs(drift.psi(frame).first().psi - 3.6617872549) < 1e-9
    assert drift.psi(frame.withColumn("value", F.lit(2.0))).first().psi == 0.0
    assert drift.psi(frame.filter("live")).first().psi == 0.0


def test_percentiles_and_links(spark):
    log = spark.createDataFrame([("p1", 1.0), ("p2", 2.0), ("p3", 4.0)], "prediction_id string, latency_ms double")
    assert abs(monitoring.prediction_summary(log).first().p95_latency_ms - 3.8) < 1e-9
    decided = spark.createDataFrame([("p1",), ("other",)], "prediction_id string")
    found = monitoring.links(log.filter("prediction_id = 'p1'"), decided).first()
    assert (found.prediction_link_rate, found.decision_link_rate, found.unlinked_decisions) == (1.0, 0.5, 1)


def test_alerts(spark):
    row = {"prediction_p95_latency_ms": 10.0, "max_dense_psi": 0.3, "sparse_bucket_psi": 0.0, "live_primary_calibrated_metrics_ece": None, "manual_review_rate": 0.9, "subgroup_calibration_gap": 0.0, "approval_rate_gap": 0.0, "prediction_link_rate": 0.5}
    wide = spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} double" for n in row))
    fired = monitoring.alerts(wide)
    assert [r.metric for r in fired.orderBy("place").collect()] == ["max_dense_psi", "manual_review_rate", "audit_log_coverage"]
    ready = monitoring.readiness(fired, wide).first()
    assert not ready.ready and ready.reasons.count("prediction_link_rate") == 1 and len(ready.reasons) == 4
    good = wide.withColumns({"max_dense_psi": F.lit(0.0), "manual_review_rate": F.lit(0.0), "prediction_link_rate": F.lit(1.0)})
    assert monitoring.readiness(monitoring.alerts(good), good).first().ready


def test_exploration_slots(spark):
    cases = [(25, 0.15, 4), (10, 0.25, 2), (2, 0.5, 1), (3, 0.5, 2), (5, 0.5, 2)]
    for k, rate, want in cases:
        assert spark.range(1).select(ranking.exploration_slots(F.lit(k), rate).alias("n")).first().n == want
    with pytest.raises(ValueError):
        RankingConfig(exploration_rate=1.5)


TRAINING = "training_row_id string, split string, label int, sample_weight double, dense_features array<double>, sparse_feature_ids array<bigint>, sparse_feature_values array<double>"


def training_rows(n=300, seed=4):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        x = rng.gauss(0, 1)
        split = "train" if i < n * 2 // 3 else "validation"
        made.append((f"trn_{i:06d}", split, int(x + 0.5 * rng.gauss(0, 1) > 0.4), rng.choice([0.5, 1.0, 2.0]), [x, rng.gauss(0, 1)], [i % 3, 7, i % 3][: i % 4], [1.0, 0.5, 2.0][: i % 4]))
    return made


def plain_training(rows, config, epochs):
    """Steps row by row, written out: (bias, dense, sparse), and the weighted train loss of each epoch."""
    n, ones = len(rows), sum(r[2] for r in rows)
    share = {0: n / (2 * (n - ones)), 1: n / (2 * ones)} if config.class_weighting else {0: 1.0, 1: 1.0}
    if config.oversample:
        share[1 if ones < n - ones else 0] *= max(ones, n - ones) / min(ones, n - ones)
    weights, squares, losses = {}, {}, []

    def move(key, gradient):
        rate = config.learning_rate
        if config.optimizer == "adagrad":
            squares[key] = squares.get(key, 0.0) + gradient**2
            rate /= math.sqrt(squares[key] + config.epsilon)
        weights[key] = weights.get(key, 0.0) - rate * gradient

    for _ in range(epochs):
        total = mass = 0.0
        for _, _, y, weight, dense, ids, values in sorted(rows):
            found = {("d", j): x for j, x in enumerate(dense)}
            for i, v in zip(ids, values):
                found["s", i] = found.get(("s", i), 0.0) + v
            p = 1 / (1 + math.exp(-(weights.get("bias", 0.0) + sum(weights.get(k, 0.0) * x for k, x in found.items()))))
            weight *= share[y]
            total += weight * (-math.log(p if y else 1 - p) if config.loss == "cross_entropy" else 0.5 * (p - y) ** 2)
            mass += weight
            error = weight * (p - y) * (p * (1 - p) if config.loss == "mse" else 1.0)
            now = dict(weights)
            move("bias", error)
            for k, x in found.items():
                w = now.get(k, 0.0)
                move(k, error * x + config.l2 * w + config.l1 * ((w > 0) - (w < 0)))
        losses.append(total / mass)
    return weights, losses


CONFIGS = {
    "adagrad": TrainingConfig(max_epochs=3, learning_rate=0.2, l1=1e-3, shuffle=False),
    "sgd_mse": TrainingConfig(max_epochs=4, learning_rate=0.1, loss="mse", optimizer="sgd", l2=0.01, class_weighting=False, shuffle=False),
    "oversampled": TrainingConfig(max_epochs=2, oversample=True, class_weighting=False, shuffle=False),
    "both": TrainingConfig(max_epochs=2, oversample=True, shuffle=False),
}


def test_trainer_with_one_shard_goes_row_by_row(spark):
    rows = [r for r in training_rows() if r[1] == "train"]
    fits = training.fit_all(spark.createDataFrame(rows, TRAINING).repartition(3), CONFIGS, batch_rows=1)
    for name, config in CONFIGS.items():
        weights, losses = plain_training(rows, config, config.max_epochs)
        model = fits[name].model
        assert math.isclose(model.bias, weights["bias"], rel_tol=1e-9), name
        assert all(math.isclose(x, weights["d", j], rel_tol=1e-9) for j, x in enumerate(model.dense))
        assert set(model.sparse) == {0, 1, 2, 7} and all(math.isclose(x, weights["s", i], rel_tol=1e-9) for i, x in model.sparse.items())
        assert [math.isclose(h["train_loss"], loss, rel_tol=1e-9) for h, loss in zip(fits[name].history, losses, strict=True)].count(False) == 0
        assert model.best_epoch == config.max_epochs


def test_trainer_with_plain_rates_is_gradient_descent_over_all_shards(spark):
    rows = [r for r in training_rows() if r[1] == "train"]
    config = TrainingConfig(max_epochs=5, learning_rate=0.7, optimizer="sgd", l2=0.02, class_weighting=False)
    model = training.fit_all(spark.createDataFrame(rows, TRAINING).repartition(5), {"a": config}, shard_rows=17, batch_rows=None)["a"].model
    x = np.zeros((len(rows), 2 + 8))
    for i, (_, _, _, _, dense, ids, values) in enumerate(rows):
        x[i, :2] = dense
        np.add.at(x[i], 2 + np.array(ids, int), values)
    y, weight = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    b, w = 0.0, np.zeros(10)
    seen = (x != 0).any(axis=0)
    for _ in range(5):
        error = weight * (1 / (1 + np.exp(-(b + x @ w))) - y) / len(rows)
        b, w = b - 0.7 * error.sum(), w - 0.7 * (x.T @ error + 0.02 * w * seen)
    assert math.isclose(model.bias, b, rel_tol=1e-9) and np.allclose(model.dense, w[:2], rtol=1e-9)
    # A shard without a sparse id does not shrink its weight, so the penalty may differ in shards that lack it.
    assert set(model.sparse) == {0, 1, 2, 7} and all(math.isclose(v, w[2 + i], rel_tol=0.02) for i, v in model.sparse.items())


def test_trainer_stops_early_and_keeps_its_best_model(spark):
    rows = spark.createDataFrame(training_rows(), TRAINING)
    configs = {"long": TrainingConfig(max_epochs=12, learning_rate=2.0, patience=2), "short": TrainingConfig(max_epochs=3), "patient": TrainingConfig(max_epochs=9, learning_rate=2.0, patience=0)}
    fits = training.fit_all(rows, configs, shard_rows=60)
    for name, fit in fits.items():
        best = min(fit.history, key=lambda h: h["validation_log_loss"])
        assert fit.model.best_epoch == best["epoch"] and all("train_log_loss" in h for h in fit.history)
        # The loss in the history is that of the model, measured on its own.
        if best["epoch"] == fit.history[-1]["epoch"] or name == "long":
            scored = training.with_probability(rows.filter("split = 'validation'"), fit.model).withColumn("weight", F.col("sample_weight"))
            assert math.isclose(metrics.losses(metrics.score_groups(scored, score="probability")).first().log_loss, best["validation_log_loss"], rel_tol=1e-9)
    assert len(fits["short"].history) == 3 and len(fits["patient"].history) == 9
    assert len(fits["long"].history) in (12, fits["long"].model.best_epoch + 2)
    assert fits["short"].model.dense[0] > abs(fits["short"].model.dense[1])
    again = training.fit_all(rows.repartition(7), configs, shard_rows=60)["long"]
    assert again.model.best_epoch == fits["long"].model.best_epoch and np.allclose(again.model.dense, fits["long"].model.dense)
    assert training.Model.from_json(again.model.to_json()) == again.model
    runs = training.fit_all(rows, {f"run{i}": TrainingConfig(max_epochs=2, seed=i) for i in range(3)}, bootstrap=["run0", "run1"])
    assert len({r.model.bias for r in runs.values()}) == 3
    with pytest.raises(ValueError):
        training.fit_all(rows.filter("split = 'test'"), configs)


def test_phases(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(made_rows())
    config = DatasetConfig(features=FeatureConfig(hash_dimension=256), split_strategy="contiguous", train_ratio=0.5, validation_ratio=0.25, test_ratio=0.25)
    out = str(tmp_path / "out")
    found = jobs.run_all(spark, str(tmp_path / "raw.csv"), out, config, TrainingConfig(max_epochs=3))
    summary = json.loads((tmp_path / "out/dataset/dataset_summary.json").read_text())["splits"]
    assert {k: v["rows"] for k, v in summary.items()} == {"train": 5, "validation": 3, "test": 4}
    assert (tmp_path / "out/model/model.json").exists() and (tmp_path / "out/calibration/calibration.json").exists()
    total = found["summary"].filter("action is null").agg(F.sum("decision_count")).first()[0]
    assert total == 3 * (3 + 4)
    stamps = found["ranking"]["candidates"].select("feature_set_version", "task_context").distinct().collect()
    assert [tuple(r) for r in stamps] == [("bank_marketing_hybrid_v1", "hybrid_ranking")] and found["ranking"]["reranker"].task_context == "hybrid_ranking"
    short = found["ranking"]["shortlist"].groupBy("split").count().collect()
    assert {r.split: r["count"] for r in short} == {"train": 5, "validation": 3, "test": 4}
    ranks = found["ranking"]["shortlist"].filter("split = 'test'").select("final_rank").collect()
    assert sorted(r.final_rank for r in ranks) == [1, 2, 3, 4]


def test_artifacts_are_read_back(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(made_rows(60))
    out = str(tmp_path / "out")
    config = DatasetConfig(features=FeatureConfig(hash_dimension=256), split_strategy="contiguous", train_ratio=0.5, validation_ratio=0.25, test_ratio=0.25)
    jobs.build_dataset(files.read_raw_csv(spark, str(tmp_path / "raw.csv")), config, f"{out}/dataset")
    rows = files.read_splits(spark, f"{out}/dataset/training")
    model, _ = jobs.train_model(rows, TrainingConfig(max_epochs=2), f"{out}/model")
    chosen, decided, summary = jobs.calibrate_and_route(rows, model, out=f"{out}/calibration")
    paths = f"{out}/model/model.json", f"{out}/calibration/calibration.json"
    bundle = jobs.load_bundle(spark, *paths)
    assert bundle.model == model and bundle.calibrator == chosen.calibrator and bundle.selection.source == chosen.source
    document = files.read_document(spark, paths[1])
    assert [r[:2] for r in calibration.method_rows(bundle.selection)] == [("raw", False), *((m, m == chosen.method) for m in sorted(chosen.reports))]
    assert set(document["reports"]) == {"platt", "isotonic"} and document["raw"]["example_count"] == 15
    for name in ("model_version", "feature_set_version", "task_context"):
        files.write_document(spark, document | {name: "other"}, f"{out}/other.json")
        with pytest.raises(ValueError, match=name):
            jobs.load_bundle(spark, paths[0], f"{out}/other.json")
    with pytest.raises(ValueError):
        calibration.calibrator_from({"method": "none"})
    report = files.read_document(spark, f"{out}/calibration/policy_summary.json")
    assert set(report) == {"validation", "test"} and set(report["test"]) == set(POLICIES)
    group = report["test"]["fraud_policy"]
    assert group["decision_count"] == 16 == sum(group["action_counts"].values()) and set(group["action_counts"]) == set(group["action_positive_rates"])
    split = files.read_document(spark, f"{out}/calibration/calibrated_validation.json")
    assert split["example_count"] == 15 and math.isclose(split["raw_metrics"]["log_loss"], document["raw"]["log_loss"]) and math.isclose(split["calibrated_metrics"]["ece"], document["reports"][chosen.method]["ece"], abs_tol=1e-12)
    assert set(files.read_document(spark, f"{out}/model/metrics.json")) == {"train", "validation", "test"}
    found = jobs.run_experiments(rows, TrainingConfig(max_epochs=2, seed=7), repeats=3, out=out)
    assert json.loads(json.dumps(found)) == files.read_document(spark, f"{out}/experiment_report.json")
    assert set(found["ablation_runs"]) == {"baseline", "mse_loss", "oversampling", "no_class_weighting", "no_l2"} and found["ablation_runs"]["baseline"] == found["baseline"]
    weights = {r["feature"]: r for r in found["stability_report"]["weights"] if r["kind"] == "dense"}
    assert set(weights) == set(DENSE_FEATURES) and all(r["runs"] == 3 and r["stdev"] > 0 for n, r in weights.items() if n == "age")
    # Without the context among the groups, the rates are there all the same.
    whole = policy.summarise(decided, ("split",)).filter("action is null and split = 'test'").first()
    assert whole.decision_count == 3 * 16 and whole.positive_action_rate > 0


def test_summary_rates_unweighted_and_weighted(spark):
    found = metrics.losses(metrics.score_groups(scored(spark, [1, 0, 0, 1], [0.9, 0.2, 0.4, 0.2], [3.0, 1.0, 1.0, 1.0]))).first()
    assert math.isclose(found.positive_rate, 0.5) and math.isclose(found.weighted_positive_rate, 4 / 6)
    assert math.isclose(found.mean_prediction, 1.7 / 4) and math.isclose(found.weighted_mean_score, (2.7 + 0.2 + 0.4 + 0.2) / 6)


def test_live_metrics_are_those_of_the_decisions(spark):
    """Three labelled decisions; the log has one of them twice and has lost another."""
    schema = "prediction_id string, task_context string, action string, manual_review_required boolean, realized_label int, outcome_delay_days int, calibrated_probability double, raw_probability double"
    rows = [
        ("p1", "bank_marketing", "target", False, 1, 1, 0.9, 0.8), ("p2", " Bank_Marketing", "suppress", False, 0, 2, 0.2, None), ("p3", "bank_marketing", "target", True, 1, None, 0.6, 0.5),
        ("p4", "bank_marketing", None, False, None, None, 0.7, 0.6), ("p5", "bank_marketing", "target", False, 1, None, None, 0.6), ("p6", "loan_policy", "approve", True, 0, None, 0.4, 0.4),
    ]
    decisions = spark.createDataFrame(rows, schema)
    found = {r.kind: r for r in monitoring.live_metrics(monitoring.live_rows(decisions, "bank_marketing")).collect()}
    assert found["calibrated"].example_count == 3 and found["raw"].example_count == 2
    assert math.isclose(found["calibrated"].log_loss, -(math.log(0.9) + math.log(0.8) + math.log(0.6)) / 3)
    assert math.isclose(found["raw"].log_loss, -(math.log(0.8) + math.log(0.5)) / 2)
    assert [r.kind for r in monitoring.live_metrics(monitoring.live_rows(decisions, "bank_marketing", raw=None).drop("raw_probability")).collect()] == ["calibrated"]
    predictions = spark.createDataFrame([("p1", 1.0), ("p1", 1.0), ("p2", 2.0)], "prediction_id string, latency_ms double")
    dense, sparse = spark.createDataFrame([(0.1,)], "psi double"), spark.createDataFrame([(0.0,)], "psi double")
    model = training.Model(0.0, [], model_version="m1", task_context="bank_marketing")
    chosen = calibration.Selection(calibration.Platt(1.0, 0.0), "platt", "validation_ece", {}, model_version="m1", task_context="bank_marketing")
    made = jobs.monitor(predictions, decisions, dense, sparse, bundle=jobs.Bundle(model, chosen), trained={"validation": {"ece": 0.1}})
    # Live metrics and coverage are of the primary context, the other summaries of the whole logs.
    assert made["live"].filter("kind = 'calibrated'").first().example_count == 3
    assert (made["coverage"].first().covered, made["coverage"].first().decisions) == (2, 5)
    summary = made["decisions"].first()
    assert summary.decision_count == 6 and summary.action_counts == {"target": 3, "suppress": 1, "approve": 1, "unknown": 1}
    groups = {r.group: r for r in made["governance"].collect()}
    assert groups["bank_marketing"].action_counts == {"target": 3, "unknown": 1} and groups["loan_policy"].decision_count == 1
    assert math.isclose(groups["bank_marketing"].mean_probability, (0.9 + 0.6 + 0.7) / 3)
    with pytest.raises(ValueError, match="model_version"):
        jobs.monitor(predictions, decisions, dense, sparse, bundle=jobs.Bundle(replace(model, model_version="m2"), chosen))
    with pytest.raises(ValueError, match="validation"):
        jobs.check_versions(model, chosen, {})
    with pytest.raises(ValueError, match="task_context"):
        jobs.rank_candidates(predictions, replace(model, task_context="loan_policy"), chosen)


@pytest.mark.parametrize("count", [200, 300])
def test_scores_do_not_depend_on_keys_or_on_the_number_of_weights(spark, count):
    """Repeated and null keys, unknown, null and unpaired features, with a map, with arrays and with a joined table."""
    rows = [("r1", [1.0], [5], [1.0]), ("r1", [1.0], [5], [1.0]), (None, [1.0], [6, 5], [2.0, 0.5]), ("r2", [0.0], [10_000, None], [1.0, 1.0]), (None, [0.0], [], []), ("r3", [2.0], None, None), ("r4", [0.0], [7, 7], [None, 1.0]), ("r5", [0.0], [8, 9], [1.0])]
    frame = spark.createDataFrame(rows, "training_row_id string, dense_features array<double>, sparse_feature_ids array<long>, sparse_feature_values array<double>").repartition(3)
    model = training.Model(0.5, [0.25], {i: i / 100 for i in range(count)})
    expected = sorted((str(k), round(0.5 + 0.25 * d[0] + sum((i or 0) / 100 * (v or 0) for i, v in zip(ids or [], values or []) if i is not None and i < count), 9)) for k, d, ids, values in rows)
    one = training.with_logit(frame, model)
    linear = F.lit(0.5) + F.col("dense_features")[0] * 0.25
    for found in (one, training.with_table_logit(frame, model.weights_table(spark), linear)):
        assert sorted((str(r.training_row_id), round(r.raw_score, 9)) for r in found.collect()) == expected
    assert training.with_logit(frame.limit(0), model).count() == 0


@pytest.mark.parametrize("count", [1, 32, 33, 500])
def test_a_null_score_has_no_step(spark, count):
    frame = spark.createDataFrame([(1, None), (2, 0.0), (3, 9.0)], "i int, s double")
    steps = [k / count for k in range(count)]
    found = dict(frame.select("i", C.step_lookup(F.col("s"), steps, [v / 2 + 0.1 for v in steps])).collect())
    assert found[1] is None and found[2] == 0.1 and found[3] == steps[-1] / 2 + 0.1


def test_percentiles_by_group(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([1.0, 2.5, 2.5, rng.random() * 9])) for g in ("a", "b", None) for _ in range(rng.randint(50, 90))] + [("a", None), ("c", 7.0), ("d", None)]
    found = {r.g: r for r in prefix.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", (0.0, 0.05, 0.5, 0.95, 1.0)).collect()}
    for g in ("a", "b", None, "c"):
        values = [v for h, v in rows if h == g and v is not None]
        assert found[g].n == len(values) and np.allclose([found[g][f"p{i}"] for i in range(5)], np.percentile(values, (0, 5, 50, 95, 100)))
    assert "d" not in found


def test_long_step_functions(spark):
    rng = random.Random(6)
    thresholds = sorted({round(rng.random(), 6) for _ in range(3000)})
    values = sorted(rng.random() for _ in thresholds)
    scores = [0.0, -1.0, 2.0, thresholds[0], thresholds[-1], None, *thresholds[5:40], *(rng.random() for _ in range(300))]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, s double")
    found = dict(frame.select("i", C.step_lookup(F.col("s"), thresholds, values)).collect())
    few = dict(frame.select("i", C.step_lookup(F.col("s"), thresholds[:9], values[:9])).collect())
    for i, s in enumerate(scores):
        if s is not None:
            assert found[i] == values[min(bisect.bisect_left(thresholds, s), len(thresholds) - 1)]
            assert few[i] == values[min(bisect.bisect_left(thresholds[:9], s), 8)]
    assert found[5] is None


def test_stream_of_requests(spark, tmp_path):
    features = dict(zip(HEADER.strip().split(";")[:-1], CSV.splitlines()[0].split(";")[:-1], strict=True))
    requests = [
        {"request_id": "r1", "event_id": "e1", "event_ts": "2026-01-01T00:00:00Z", "features": features},
        {"request_id": "r2", "event_id": "e2", "event_ts": "2026-01-01T00:00:00Z", **features},
        {"request_id": "r3", "event_id": "e3", "event_ts": "2026-01-01T00:00:00Z", "task_context": " Fraud_Policy ", "calibrated_probability": 0.8},
        {"request_id": " ", "event_id": "e4", "event_ts": "2026-01-01T00:00:00Z", "features": features},
        {"request_id": "r5", "event_id": "e5", "event_ts": "2026-01-01T00:00:00Z"},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, requests)))
    model = training.Model(-1.0, [0.1] * 7, {3: 0.5}, task_context="bank_marketing", feature_set_version="v1")
    serving.serve(spark, str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "check"), model, calibration.Platt(1.0, 0.0), config=FeatureConfig(hash_dimension=256)).awaitTermination()
    predictions = spark.read.json(str(tmp_path / "log/predictions")).collect()
    decisions = {r.decision_id: r.action for r in spark.read.json(str(tmp_path / "log/decisions")).collect()}
    rejected = {r.event_id: r.error for r in spark.read.json(str(tmp_path / "log/rejected")).collect()}
    assert all(p.latency_ms > 0 for p in predictions)
    assert sorted(p.event_id for p in predictions) == ["e1", "e2"] and predictions[0].calibrated_score == predictions[1].calibrated_score
    assert set(decisions) == {"decision_e1", "decision_e2", "decision_e3"} and decisions["decision_e3"] == "block"
    assert set(rejected) == {"e4", "e5"}


def test_small_readers(spark, tmp_path):
    log = "a string, n int"
    assert files.head_or_empty(spark, str(tmp_path / "none"), log, 2).count() == 0
    files.write_json(spark.createDataFrame([("x", 1), ("y", None), ("z", 3)], log), str(tmp_path / "log"), single=True)
    assert [tuple(r) for r in files.head_or_empty(spark, str(tmp_path / "log"), log, 2).collect()] == [("x", 1), ("y", None)]
    assert '"n":null' in "".join(p.read_text() for p in (tmp_path / "log").glob("*.json"))
    (tmp_path / "d").mkdir()
    for name in ("b", "a", "c"):
        (tmp_path / "d" / f"{name}.jsonl").write_text(json.dumps({"decision_id": name, "action": "approve"}) + "\n")
    found = files.read_decision_files(spark, str(tmp_path / "d")).collect()
    assert [(r.file_name, r.decision_id) for r in found] == [("a.jsonl", "a"), ("b.jsonl", "b"), ("c.jsonl", "c")]
    (tmp_path / "raw.csv").write_text(made_rows(40))
    split, whole = (files.read_raw_csv(spark, str(tmp_path / "raw.csv"), quoted_breaks=q).orderBy("row_id").collect() for q in (False, True))
    assert split == whole and [r.row_id for r in whole] == list(range(40))
    snapshot = jobs.calibration_snapshot(metrics.report(scored(spark, [1, 0, 1, 0], [0.9, 0.2, 0.8, 0.1])), {"ece": 0.05, "log_loss": 0.1}).first()
    assert math.isclose(snapshot.ece_delta, 0.15 - 0.05) and math.isclose(snapshot.log_loss_delta, 0.164252033486 - 0.1, rel_tol=1e-9)
    none = jobs.calibration_snapshot(metrics.report(scored(spark, [1], [0.5]).limit(0)), {"ece": 0.05, "log_loss": 0.1}).first()
    assert none.ece_delta is None and none.log_loss_delta is None
    lengths = profiling.preview(spark.createDataFrame([([1.0, 2.0], [3])], "dense_features array<double>, sparse_feature_ids array<bigint>")).first()
    assert (lengths.dense_features_length, lengths.sparse_feature_ids_length) == (2, 1)


def test_alert_thresholds_file(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("other:\n  max_dense_psi: 9\nalerts:\n  max_dense_psi: 0.4  # note\n  unknown: 3\nend:\n  max_live_ece: 1\n")
    found = files.read_alert_thresholds(spark, str(tmp_path / "m.yaml"))
    assert found.max_dense_psi == 0.4 and found.max_live_ece == AlertThresholds().max_live_ece
    assert files.read_alert_thresholds(spark, str(tmp_path / "none.yaml")) == AlertThresholds()


def test_displayed_numbers(spark):
    rows = [(0.123456, "1234567.9", -0.256), (None, None, None), (2.0, "abc", 1.0), (-1.5, "-1234.9", 0.0)]
    found = spark.createDataFrame(rows, "a double, b string, c double").select(C.show_float(F.col("a")), C.show_int(F.col("b")), C.show_percent(F.col("c"))).collect()
    assert [tuple(r) for r in found] == [("0.1235", "1,234,567", "-25.6%"), ("—", "—", "—"), ("2.0000", "abc", "100.0%"), ("-1.5000", "-1,234", "0.0%")]


def test_artifacts_by_phase(spark, tmp_path):
    out = f"file://{tmp_path}"
    assert not any(r.ready for r in jobs.artifact_status(spark, out).collect())
    for name in jobs.REQUIRED["training"]:
        files.write_document(spark, {}, f"{out}/{name}")
    files.write_document(spark, {}, f"{out}/ranking/metrics.json")
    found = {r.phase: r for r in jobs.artifact_status(spark, out).orderBy("place").collect()}
    assert list(found) == list(jobs.REQUIRED) and found["training"].ready and not found["training"].missing
    assert found["ranking"].missing == list(jobs.REQUIRED["ranking"][1:])


def test_bins_of_rows_and_of_scores_agree(spark):
    rng = random.Random(3)
    rows = scored(spark, [rng.randint(0, 1) for _ in range(400)], [0.0, 1.0, 0.1, *(rng.random() for _ in range(397))], [rng.choice([0.0, 1.0, 2.5]) for _ in range(400)])
    one, two = (metrics.calibration_errors(g).first() for g in (metrics.score_groups(rows), metrics.bins_of_rows(rows)))
    assert math.isclose(one.ece, two.ece) and math.isclose(one.mce, two.mce)
