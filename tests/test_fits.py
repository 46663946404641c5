"""The registered fits against plain loops, and the weights held in a table against those held in memory."""

import json
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.config import DENSE_FEATURES, TrainingConfig
from quillon.operators import draws, training, weight_table
from quillon.plans import catalog, jobs

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def table(spark):
    rows = catalog._training_table(spark, DATA).select("training_row_id", "split", "label", "sample_weight", "dense_features", "sparse_feature_ids", "sparse_feature_values")
    return sorted(rows.collect())


def plain_fit(rows, config, boot=False, batch=32):
    """One shard, row by row in dictionaries: (bias, dense, sparse, best epoch, validation losses)."""
    train, validation = ([r for r in rows if r.split == s] for s in ("train", "validation"))
    n, positives = len(train), sum(r.label for r in train)
    zero, one = 1.0, 1.0
    if config.class_weighting:
        zero, one = n / (2 * (n - positives)), n / (2 * positives)
    if config.oversample:
        few = max(positives, n - positives) / min(positives, n - positives)
        zero, one = (zero, one * few) if positives < n - positives else (zero * few, one)
    own = np.random.default_rng([config.seed, 0, 1]).poisson(1.0, n) if boot else np.ones(n)
    known = {i for r in train for i in r.sparse_feature_ids}
    w, seen = {}, {}
    parts = lambda r: [("b", 1.0), *((("d", j), x) for j, x in enumerate(r.dense_features)), *((i, v) for i, v in zip(r.sparse_feature_ids, r.sparse_feature_values, strict=True) if i in known)]
    probability = lambda r: 1 / (1 + np.exp(-sum(w.get(k, 0.0) * x for k, x in parts(r))))
    best, waited, losses = (np.inf, 0, {}), 0, []
    for epoch in range(1, config.max_epochs + 1):
        order = np.random.default_rng([config.seed + epoch, 0]).permutation(n) if config.shuffle else np.arange(n)
        order = [k for k in order if own[k] > 0]
        for at in range(0, len(order), batch):
            chosen, gradient = order[at : at + batch], {}
            for k in chosen:
                r, p = train[k], probability(train[k])
                scale = r.sample_weight * own[k] * (one if r.label else zero) * (p - r.label) * (p * (1 - p) if config.loss == "mse" else 1.0) / len(chosen)
                for key, x in parts(r):
                    gradient[key] = gradient.get(key, 0.0) + scale * x
            for key, g in gradient.items():
                if key != "b":
                    g += config.l2 * w.get(key, 0.0) + config.l1 * np.sign(w.get(key, 0.0))
                if config.optimizer == "adagrad":
                    seen[key] = seen.get(key, 0.0) + g * g
                    g /= np.sqrt(seen[key] + config.epsilon)
                w[key] = w.get(key, 0.0) - config.learning_rate * g
        if validation:
            weights = np.array([r.sample_weight for r in validation])
            p = np.clip([probability(r) if r.label else 1 - probability(r) for r in validation], 1e-15, 1)
            losses.append(float(weights @ -np.log(p) / weights.sum()))
            waited += 1
            if losses[-1] < best[0]:
                best, waited = (losses[-1], epoch, dict(w)), 0
            if config.patience and waited >= config.patience:
                break
        else:
            best = (np.inf, epoch, dict(w))
    return best[2], best[1], losses


def agree(model, history, w, epoch, losses):
    assert model["best_epoch"] == epoch
    found = {"b": model["bias"], **{("d", j): x for j, x in enumerate(model["dense"])}, **{int(i): x for i, x in model["sparse"].items()}}
    assert all(abs(found.get(k, 0.0) - w.get(k, 0.0)) < 1e-8 for k in found.keys() | w.keys())
    assert np.allclose([h["validation_log_loss"] for h in history if "validation_log_loss" in h], losses, atol=1e-9)


@needs_data
def test_registered_runs_equal_plain_loops(spark, table, monkeypatch):
    """``lr_train_minibatch``, ``ablation_suite`` and ``bootstrap_stability``, with the settings they are registered with."""
    kept = {}
    original = training.train_all

    def record(rows, configs, bootstrap=(), *args, **sizes):
        runs = original(rows, configs, bootstrap, *args, **sizes)
        kept.update({r.config: (configs[r.config], r.config in set(bootstrap), json.loads(r.model), json.loads(r.history)) for r in runs.collect()})
        return runs

    monkeypatch.setattr(catalog.training, "train_all", record)
    catalog.QUERIES["lr_train_minibatch"](spark, DATA)
    single = dict(kept)
    catalog.QUERIES["ablation_suite"](spark, DATA)
    assert kept["baseline"][2] == single["baseline"][2]
    found = {r.feature: r for r in catalog.QUERIES["bootstrap_stability"](spark, DATA).collect() if r.kind == "dense"}
    assert len(kept) == 9
    plain = {name: plain_fit(table, config, boot) for name, (config, boot, _, _) in kept.items()}
    for name, (_, _, model, history) in kept.items():
        agree(model, history, *plain[name])
    runs = [plain[f"run{i}"][0] for i in range(4)]
    for j, feature in enumerate(DENSE_FEATURES):
        weights = [w[("d", j)] for w in runs]
        assert np.isclose(found[feature]["mean"], np.mean(weights)) and np.isclose(found[feature]["stdev"], np.std(weights, ddof=1))


@needs_data
def test_distributed_fit_reaches_the_minimum(spark, table):
    found = {r.feature: r.weight for r in catalog.QUERIES["lr_train_distributed"](spark, DATA).collect()}
    train, config = [r for r in table if r.split == "train"], TrainingConfig()
    x = np.zeros((len(train), 7 + 1024 + 1))
    for k, r in enumerate(train):
        x[k, :7], x[k, -1] = r.dense_features, 1.0
        np.add.at(x[k], 7 + np.array(r.sparse_feature_ids) % 1024, r.sparse_feature_values)
    y = np.array([r.label for r in train], float)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    weight *= np.array([r.sample_weight for r in train])
    penalty = np.full(1032, config.l2)
    penalty[-1] = 0.0
    assert config.l1 == 0
    loss = lambda b: (weight @ np.logaddexp(0, -(2 * y - 1) * (x @ b))) / weight.sum() + penalty @ b**2 / 2
    b = np.zeros(1032)
    for _ in range(25):
        p = 1 / (1 + np.exp(-(x @ b)))
        gradient = x.T @ (weight * (p - y)) / weight.sum() + penalty * b
        b -= np.linalg.solve((x * (weight * p * (1 - p) / weight.sum())[:, None]).T @ x + np.diag(penalty + 1e-10), gradient)
    mine = np.array([*(found[n] for n in DENSE_FEATURES), *(found.get(f"sparse_{i}", 0.0) for i in range(1024)), found["bias"]])
    assert loss(b) <= loss(mine) + 1e-9 and loss(mine) - loss(b) < 2e-3


def made_rows(spark, n, ids, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        found = rng.integers(0, ids, 3).tolist() if i % 9 else []
        rows.append((f"r{i:06d}", "validation" if i % 6 == 0 else "train", int(rng.random() < 0.4), float(rng.random() + 0.5), rng.normal(size=2).tolist(), found, [1.0] * len(found)))
    return spark.createDataFrame(rows, "training_row_id string, split string, label int, sample_weight double, dense_features array<double>, sparse_feature_ids array<long>, sparse_feature_values array<double>").repartition(4)


@pytest.mark.parametrize(
    ("config", "sizes"),
    [(TrainingConfig(max_epochs=3), {}), (TrainingConfig(max_epochs=4, optimizer="sgd", l1=0.001, patience=1), {"shard_rows": 150}), (TrainingConfig(max_epochs=2, loss="mse", shuffle=False), {"batch_rows": None, "shard_rows": 90})],
)
def test_weights_in_a_table_equal_those_in_memory(spark, config, sizes):
    rows = made_rows(spark, 500, 60)
    one, two = training.fit_all(rows, {"x": config}, **sizes)["x"], weight_table.fit_table(rows, config, **sizes)
    found = {(r.kind, r.id): r.weight for r in two.weights.collect()}
    assert two.best_epoch == one.model.best_epoch and np.isclose(found[weight_table.BIAS, 0], one.model.bias)
    assert np.allclose([found[weight_table.DENSE, j] for j in range(2)], one.model.dense)
    assert all(np.isclose(found[weight_table.SPARSE, i], one.model.sparse.get(i, 0.0)) for i in range(60) if (weight_table.SPARSE, i) in found)
    assert len(two.history) == len(one.history) and all(np.isclose(a[k], b[k]) for a, b in zip(one.history, two.history, strict=True) for k in a)
    a, b = (dict(s.select("training_row_id", "raw_score").collect()) for s in (training.with_logit(rows, one.model), weight_table.with_logit(rows, two)))
    assert a.keys() == b.keys() and all(np.isclose(a[k], b[k]) for k in a)
    two.drop()


def test_many_ids_never_reach_the_driver(spark, monkeypatch):
    rows = made_rows(spark, 6000, 1 << 20)
    sizes, collect = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda self: sizes.append(len(out := collect(self))) or out)
    fitted = weight_table.fit_table(rows, TrainingConfig(max_epochs=2), shard_rows=1000)
    assert fitted.weights.count() > 12_000 and max(sizes) <= 3


def test_rows_without_features_and_lone_splits(spark):
    rows = made_rows(spark, 40, 5).filter("split = 'train'").withColumns({"sparse_feature_ids": F.array().cast("array<long>"), "sparse_feature_values": F.array().cast("array<double>")})
    config = TrainingConfig(max_epochs=2)
    one, two = training.fit_all(rows, {"x": config})["x"].model, weight_table.fit_table(rows, config)
    assert two.weights.count() == 3 and two.best_epoch == 2
    assert np.isclose({r.kind: r.weight for r in two.weights.collect()}[weight_table.BIAS], one.bias)
    with pytest.raises(ValueError, match="no training rows"):
        weight_table.fit_table(rows.limit(0))


def test_folds_equal_fits_on_their_rows(spark):
    """Each origin's model is the one that a fit on its own rows gives, whatever other folds hold."""
    days = F.expr("timestamp '2026-01-01' + make_interval(0, 0, 0, cast(substring(training_row_id, 2) as int) % 40)")
    rows = made_rows(spark, 400, 30).withColumn("event_ts", F.when(F.col("training_row_id") != "r000007", days))
    origins = [datetime(2026, 1, 10), datetime(2026, 1, 20), datetime(2026, 2, 5)]
    config = TrainingConfig(max_epochs=4, patience=2)
    found = training.fit_folds(rows, config, origins)
    assert list(found) == [1, 2, 3]
    for k, origin in enumerate(origins):
        until = F.lit(origins[k + 1]) if k + 1 < len(origins) else F.lit(datetime(2100, 1, 1))
        own = rows.withColumn("split", F.when(F.col("event_ts") < F.lit(origin), "train").when(F.col("event_ts") < until, "validation"))
        one = training.fit_all(own, {"x": config})["x"]
        mine = found[k + 1]
        assert mine.model.best_epoch == one.model.best_epoch and np.isclose(mine.model.bias, one.model.bias) and np.allclose(mine.model.dense, one.model.dense)
        assert all(np.isclose(mine.model.sparse.get(i, 0.0), one.model.sparse.get(i, 0.0)) for i in range(30))
        assert np.allclose([h.get("validation_log_loss", 0) for h in mine.history], [h.get("validation_log_loss", 0) for h in one.history])
    for wrong in ([], origins[::-1], [datetime(2020, 1, 1)]):
        with pytest.raises(ValueError, match="ascend|no training rows"):
            training.fit_folds(rows, config, wrong)


@pytest.mark.parametrize("n", [None, 0, 10, 50_000])
def test_draws_are_exact_and_repeat(spark, n):
    rows = spark.range(5300).select(F.format_string("k%06d", "id").alias("key"), F.when(F.col("id") % 3 == 0, 1.5).alias("draws"), F.lit("x").alias("other"))
    one, two = (dict(draws.with_draws(part, n, ["key"], seed=4).select("key", "draws").collect()) for part in (rows.repartition(3), rows.repartition(7, "key")))
    assert one == two and len(one) == 5300 and sum(one.values()) == (5300 if n is None else n) and min(one.values()) >= 0
    assert one != dict(draws.with_draws(rows, n, ["key"], seed=5).select("key", "draws").collect()) or n == 0
    if n == 50_000:
        values = np.array(list(one.values()))
        # Variance of a multinomial draw, within and between leaves of a thousand rows.
        assert abs(values.var() / values.mean() - 1) < 0.1
        leaves = values[np.argsort(list(one))][:5000].reshape(5, 1000).sum(axis=1)
        assert np.abs(leaves - 50_000 * 1000 / 5300).max() < 5 * np.sqrt(50_000 * 0.19 * 0.81)


def test_draws_over_many_branches(spark, monkeypatch):
    monkeypatch.setattr(draws, "LEAF", 10)
    monkeypatch.setattr(draws, "BRANCH", 7)
    found = draws.with_draws(spark.range(733).repartition(4), 4000, ["id"]).collect()
    assert len(found) == 733 and sum(r.draws for r in found) == 4000
    assert draws.with_draws(spark.range(0), 4, ["id"]).count() == 0
    repeated = spark.createDataFrame([(None, i) for i in range(40)], "id long, i int")
    assert sum(r.draws for r in draws.with_draws(repeated, 100, ["id"]).collect()) == 100


def test_resampled_and_oversampled_rows(spark):
    rows = made_rows(spark, 600, 9)
    train = rows.filter("split = 'train'")
    n, ones = train.count(), train.filter("label = 1").count()
    unit = rows.withColumn("sample_weight", F.lit(1.0))
    total = lambda frame, where: frame.filter(where).agg(F.sum("sample_weight")).first()[0]
    again = draws.resampled(unit, seed=2)
    assert total(again, "split = 'train'") == n and again.filter("split = 'train'").count() < 0.75 * n and total(again, "split = 'validation'") == 600 - n
    level = draws.oversampled(unit, seed=2)
    assert total(level, "split = 'train' and label = 1") == total(level, "split = 'train' and label = 0") == max(ones, n - ones)
    assert level.count() == 600 and draws.oversampled(unit.filter("label = 1")).count() == unit.filter("label = 1").count()
    report = jobs.run_experiments(rows.withColumns({"feature_set_version": F.lit("f"), "task_context": F.lit("t")}), TrainingConfig(max_epochs=1), repeats=2, exact_draws=True)
    assert {r["runs"] for r in report["stability_report"]["weights"] if r["kind"] == "dense"} == {2}
    assert report["ablation_runs"]["oversampling"]["history"] != report["baseline"]["history"]
