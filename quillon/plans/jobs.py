"""The phases as jobs of one session: dataset, training, calibration and routing, monitoring, ranking.

Each returns DataFrames; with ``out`` it also writes the artifacts of its phase under that folder.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DENSE_FEATURES, POLICIES, AlertThresholds, DatasetConfig, RankingConfig, TrainingConfig
from ..operators import calibration, dataset, draws, drift, metrics, monitoring, policy, ranking, training
from ..sources import files, scratch


def build_dataset(contacts: DataFrame, config: DatasetConfig = DatasetConfig(), out: str | None = None) -> dict[str, DataFrame]:
    rows = dataset.with_identity(contacts, config)
    if out:
        # Every sink below reads the rows: the source is read and parsed once.
        rows = scratch.stage(rows, "contacts")
    made = {"events": dataset.contact_events(rows, config), "labels": dataset.subscription_labels(rows, config), "training": dataset.training_rows(rows, config)}
    made["summary"] = dataset.summary(made["training"])
    if out:
        files.write_json(made["events"], f"{out}/events")
        files.write_json(made["labels"], f"{out}/labels")
        files.write_splits(made["training"], f"{out}/training")
        spark = contacts.sparkSession
        splits = {r.split: r.asDict() for r in dataset.summary(files.read_splits(spark, f"{out}/training")).collect()}
        files.write_document(spark, {"splits": splits, **asdict(config)}, f"{out}/dataset_summary.json")
    return made


def check_uniform(rows: DataFrame, columns: Sequence[str] = ("feature_set_version", "task_context")) -> dict[str, str]:
    """The one value of each column; more than one is an error."""
    found = rows.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in columns)).first().asDict()
    for name, values in found.items():
        if len(values) != 1:
            raise ValueError(f"{name} must have one value, found {values}")
    return {name: values[0] for name, values in found.items()}


def train_model(rows: DataFrame, config: TrainingConfig = TrainingConfig(), out: str | None = None) -> tuple[training.Model, list[dict]]:
    stamps = check_uniform(rows)
    model, history = training.train(rows, config, **stamps, dense_names=list(DENSE_FEATURES))
    if out:
        spark = rows.sparkSession
        files.write_document(spark, asdict(model), f"{out}/model.json")
        files.write_document(spark, _by_split(rows, model), f"{out}/metrics.json")
        files.write_document(spark, {"history": history}, f"{out}/history.json")
    return model, history


def _by_split(rows: DataFrame, model: training.Model) -> dict[str, dict]:
    scored = training.with_probability(rows, model).withColumnRenamed("sample_weight", "weight")
    return {r.split: r.asDict() for r in metrics.report(scored, ["split"], score="probability").collect()}


def run_experiments(rows: DataFrame, config: TrainingConfig = TrainingConfig(), repeats: int = 0, out: str | None = None, exact_draws: bool = False) -> dict:
    """The baseline and its ablations, all fitted together, with their metrics by split; with more than one
    repeat also how stable the weights are over bootstrap draws.

    Oversampling and bootstrap are weights and Poisson draws in the common passes, or with ``exact_draws`` rows drawn with
    replacement, exactly as many as asked for, each sample fitted by itself."""
    stamps, spark = check_uniform(rows), rows.sparkSession
    configs = training.suite(config)
    fits = training.fit_all(rows, configs)
    if exact_draws:
        drawn = scratch.stage(draws.oversampled(rows, seed=config.seed), "oversampled")
        fits["oversampling"] = training.fit_all(drawn, {"oversampling": replace(configs["oversampling"], oversample=False)})["oversampling"]
        scratch.drop_table(drawn)
    runs = {name: {"best_epoch": f.model.best_epoch, "history": f.history, "metrics": _by_split(rows, f.model), "top": f.model.top(10), "top_sparse": f.model.top(10, sparse=True)} for name, f in fits.items()}
    report = {**stamps, "baseline": runs["baseline"], "ablation_runs": runs, "stability_report": None}
    if repeats > 1:
        runs_of, train = {f"run{i}": replace(config, seed=config.seed + i, patience=0) for i in range(repeats)}, rows.filter("split = 'train'")
        if exact_draws:
            models = [(name, training.fit_all(draws.resampled(train, seed=c.seed), {name: c})[name].model.to_json(), "[]") for name, c in runs_of.items()]
            fitted = spark.createDataFrame(models, training.RUN)
        else:
            fitted = training.train_all(train, runs_of, bootstrap=list(runs_of))
        found = training.stability(fitted, DENSE_FEATURES)
        report["stability_report"] = {"repeats": repeats, "weights": [r.asDict() for r in found.collect()]}
    if out:
        files.write_document(spark, report, f"{out}/experiment_report.json")
    return report


def calibrate_and_route(rows: DataFrame, model: training.Model, contexts: Sequence[str] = tuple(POLICIES), metric: str = "validation_ece", out: str | None = None) -> tuple[calibration.Selection, DataFrame, DataFrame]:
    """(selection, decisions, summary): calibrated on validation, then validation and test routed in
    every context (the other contexts reuse the same probabilities: a simulation)."""
    scored = training.with_probability(rows.filter("split <> 'train'"), model).withColumnRenamed("sample_weight", "weight").withColumn("score", F.col("raw_score"))
    stamps = {c: getattr(model, c) for c in ("model_version", "feature_set_version", "task_context")}
    chosen = calibration.select(scored.filter("split = 'validation'"), metric=metric, **stamps)
    calibrated = calibration.calibrated(scored, chosen.calibrator, chosen.source, "__calibrated")
    calibrated = calibrated.withColumns({"raw_probability": F.col("probability"), "probability": F.col("__calibrated")}).drop("__calibrated")
    decided = policy.simulate(calibrated.drop("task_context"), contexts).withColumns(
        {"decision_id": F.concat(F.lit("decision_"), F.col("event_id")), "prediction_id": F.concat(F.lit("prediction_"), F.col("event_id")), "realized_label": F.col("label"),
         "decision_ts": F.col("event_ts"), "decision_date": F.to_date("event_ts"), "realized_value": F.lit(None).cast("double"),
         "outcome_delay_days": F.datediff("label_ts", "event_ts"), "calibrated_probability": F.col("probability")}
    )
    summary = policy.summarise(decided, ("split", "task_context"))
    if out:
        from ..schemas import DECISION_OUTCOME

        spark = rows.sparkSession
        files.write_json(decided.select(*DECISION_OUTCOME.names, "split"), f"{out}/decisions")
        files.write_document(spark, json.loads(chosen.to_json()), f"{out}/calibration.json")
        files.write_document(spark, policy.summary_document(summary), f"{out}/policy_summary.json")
        reports: dict[str, dict] = {}
        for r in calibration.evaluate(calibrated, ["split"]).collect():
            reports.setdefault(r.split, {"example_count": r.example_count})[f"{r.kind}_metrics"] = r.asDict()
        for split, report in reports.items():
            files.write_document(spark, report, f"{out}/calibrated_{split}.json")
    return chosen, decided, summary


@dataclass(frozen=True)
class Bundle:
    """What serving needs: a model and the calibrator that was chosen for it."""

    model: training.Model
    selection: calibration.Selection

    @property
    def calibrator(self) -> calibration.Platt | calibration.Isotonic | calibration.StepTable:
        return self.selection.calibrator


def load_bundle(spark: SparkSession, model_path: str, calibration_path: str) -> Bundle:
    """Reads both artifacts back; a calibrator of another model, feature set or context is an error."""
    model = training.Model.from_json(json.dumps(files.read_document(spark, model_path)))
    selection = calibration.Selection.from_json(json.dumps(files.read_document(spark, calibration_path)))
    check_versions(model, selection)
    return Bundle(model, selection)


def check_versions(model: training.Model, selection: calibration.Selection, trained: dict | None = None) -> None:
    """A calibrator of another model, feature set or context is an error, as is a metrics document
    without those of the validation split."""
    for name in ("model_version", "feature_set_version", "task_context"):
        if getattr(model, name) != getattr(selection, name):
            raise ValueError(f"{name} of the model is {getattr(model, name)!r}, of the calibrator {getattr(selection, name)!r}")
    if trained is not None and not trained.get("validation"):
        raise ValueError("the metrics of the model lack those of the validation split")


def monitor(
    predictions: DataFrame,
    decisions: DataFrame,
    dense: DataFrame,
    sparse: DataFrame,
    context: str | None = None,
    thresholds: AlertThresholds = AlertThresholds(),
    bundle: Bundle | None = None,
    trained: dict | None = None,
) -> dict[str, DataFrame]:
    """All summaries of the logs; ``dense`` and ``sparse`` are results of ``drift``.

    The primary context (that of the bundle's model, unless named) confines live metrics and audit coverage;
    all other summaries are of the whole logs.  With a bundle its versions are checked first."""
    if bundle is not None:
        check_versions(bundle.model, bundle.selection, trained)
        context = context or bundle.model.task_context
    # Every summary reads the logs: they are joined and narrowed once.
    predictions, decisions = scratch.stage(predictions, "predictions"), scratch.stage(decisions, "decisions")
    primary = monitoring.for_context(decisions, context) if context else decisions
    live = monitoring.live_rows(primary)
    groups = monitoring.governance(decisions)
    made = {
        "predictions": monitoring.prediction_summary(predictions),
        "decisions": monitoring.decision_summary(decisions),
        "live": monitoring.live_metrics(live),
        "drift": drift.drift_summary(dense, sparse),
        "governance": groups,
        "gaps": monitoring.governance_gaps(groups),
        "links": monitoring.links(predictions, decisions),
        "coverage": monitoring.audit_coverage(predictions, primary),
    }
    wide = (
        made["predictions"].select(F.col("p95_latency_ms").alias("prediction_p95_latency_ms"))
        .crossJoin(made["decisions"].select("manual_review_rate"))
        .crossJoin(made["live"].filter("kind = 'calibrated'").select(F.when(F.col("example_count") > 0, F.col("ece")).alias("live_primary_calibrated_metrics_ece")))
        .crossJoin(made["drift"].select("max_dense_psi", "sparse_bucket_psi"))
        .crossJoin(made["gaps"])
        .crossJoin(made["links"].select("prediction_link_rate"))
    )
    made["wide"] = wide
    made["alerts"] = monitoring.alerts(wide, thresholds)
    made["readiness"] = monitoring.readiness(made["alerts"], wide)
    return made


def calibration_snapshot(live: DataFrame, baseline: dict[str, float]) -> DataFrame:
    """Live minus baseline of calibration error and log loss; null without live rows."""
    seen = F.col("example_count") > 0
    return live.select(*(F.when(seen, F.col(c) - F.lit(baseline[c])).alias(f"{c}_delta") for c in ("ece", "log_loss")))


def rank_candidates(rows: DataFrame, model: training.Model, calibrator, source: str = "score", config: RankingConfig = RankingConfig()) -> dict[str, DataFrame]:
    """Stage-one scores, a reranker trained on the hybrid features, ranks, shortlist and metrics.

    ``calibrator`` may be a selection: then its versions must be those of the model, and it tells what it reads."""
    if isinstance(calibrator, calibration.Selection):
        check_versions(model, calibrator)
        calibrator, source = calibrator.calibrator, calibrator.source
    scored = calibration.calibrated(training.with_probability(rows, model), calibrator, "raw_score" if source == "score" else "probability", "stage1_calibrated_probability")
    staged = scored.withColumns(
        {"stage1_raw_score": F.col("raw_score"), "stage1_probability": F.col("probability")}
        | {name: F.col("dense_features")[i] for i, name in enumerate(DENSE_FEATURES)}
    )
    hybrid = ranking.with_hybrid_features(staged).withColumn("dense_features", F.array(*ranking.HYBRID_FEATURES))
    stamps = {"feature_set_version": config.feature_set_version, "task_context": config.task_context}
    hybrid = hybrid.withColumns({name: F.lit(value) for name, value in stamps.items()})
    empty = {"sparse_feature_ids": F.array().cast("array<bigint>"), "sparse_feature_values": F.array().cast("array<double>")}
    reranker, history = training.train(hybrid.withColumns(empty), config.reranker, dense_names=list(ranking.HYBRID_FEATURES), **stamps)
    probability = F.lit(1.0) / (1 + F.exp(-training.score_column(reranker, ranking.HYBRID_FEATURES)))
    candidates = scratch.stage(hybrid.withColumns({"reranker_probability": probability, "candidate_id": F.col("training_row_id")}), "candidates")
    found = ranking.ranking_metrics(candidates, config.k, config.exploration_rate)
    return {
        "candidates": candidates, "shortlist": ranking.shortlist(candidates, config.k, config.exploration_rate), "metrics": found, "overall": ranking.overall(found), "readiness": ranking.readiness(found),
        "history": rows.sparkSession.createDataFrame(history), "reranker": reranker,
    }


#: What each phase leaves under the folder of ``run_all``.
REQUIRED = {
    "dataset": ("dataset/dataset_summary.json", "dataset/events", "dataset/labels", "dataset/training"),
    "training": ("model/model.json", "model/metrics.json", "model/history.json"),
    "calibration": ("calibration/calibration.json", "calibration/policy_summary.json", "calibration/decisions"),
    "serving": ("serving/predictions", "serving/decisions"),
    "monitoring": ("monitoring/report.json", "monitoring/alerts"),
    "ranking": ("ranking/metrics.json", "ranking/shortlist", "ranking/reranker.json", "ranking/history.json"),
}


def artifact_status(spark: SparkSession, out: str, required: dict[str, Sequence[str]] = REQUIRED) -> DataFrame:
    """(place, phase, ready, required, missing): which artifacts of each phase are there, in order of the phases."""
    rows = []
    for place, (phase, names) in enumerate(required.items(), 1):
        missing = [name for name in names if not files.exists(spark, f"{out}/{name}")]
        rows.append((place, phase, not missing, list(names), missing))
    return spark.createDataFrame(rows, "place int, phase string, ready boolean, required array<string>, missing array<string>")


def write_monitoring(made: dict[str, DataFrame], out: str) -> None:
    """The report of ``monitor``: one document, and the alerts as lines."""
    spark = made["alerts"].sparkSession
    single = ("predictions", "decisions", "drift", "gaps", "links", "coverage", "readiness")
    report = {name: made[name].first().asDict(recursive=True) for name in single}
    report["live"] = {r.kind: r.asDict() for r in made["live"].collect()}
    report["governance"] = {r.group: r.asDict(recursive=True) for r in made["governance"].collect()}
    files.write_document(spark, report, f"{out}/report.json")
    files.write_json(made["alerts"], f"{out}/alerts", single=True)


def write_ranking(ranked: dict[str, DataFrame], out: str) -> None:
    """Metrics by split and overall, the shortlists by split, the reranker and its history."""
    spark = ranked["metrics"].sparkSession
    splits = {r.split: r.asDict() for r in ranked["metrics"].collect()}
    files.write_document(spark, {"splits": splits, "overall": ranked["overall"].first().asDict(), "readiness": ranked["readiness"].first().asDict()}, f"{out}/metrics.json")
    files.write_json(ranked["shortlist"], f"{out}/shortlist", by="split")
    files.write_document(spark, asdict(ranked["reranker"]), f"{out}/reranker.json")
    files.write_document(spark, {"history": [r.asDict() for r in ranked["history"].collect()]}, f"{out}/history.json")


def run_all(spark: SparkSession, raw_path: str, out: str, dataset_config: DatasetConfig = DatasetConfig(), training_config: TrainingConfig = TrainingConfig()) -> dict:
    """All batch phases in one session, each reading what the one before it wrote."""
    build_dataset(files.read_raw_csv(spark, raw_path), dataset_config, f"{out}/dataset")
    rows = files.read_splits(spark, f"{out}/dataset/training")
    model, history = train_model(rows, training_config, f"{out}/model")
    chosen, decided, summary = calibrate_and_route(rows, model, out=f"{out}/calibration")
    bundle = load_bundle(spark, f"{out}/model/model.json", f"{out}/calibration/calibration.json")
    ranked = rank_candidates(rows, bundle.model, bundle.selection)
    write_ranking(ranked, f"{out}/ranking")
    return {"model": model, "history": history, "selection": chosen, "summary": summary, "ranking": ranked}
