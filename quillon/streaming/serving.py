"""Online paths as streams: score and route requests, count events, drop repeats, match labels.

Streams share the column functions of the batch jobs.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import POLICIES, FeatureConfig
from ..functions import columns as C
from ..functions.columns import safe_rate
from ..operators import calibration, policy, training
from ..operators.prefix import percentiles
from ..sources import files, scratch


def look_up_features(requests: DataFrame, config: FeatureConfig) -> DataFrame:
    """Adds dense and sparse features and their counts; stateless."""
    ids = C.hashed_tokens(C.sparse_tokens(config), config.hash_dimension)
    found = requests.withColumns({"dense_features": C.dense_vector(config), "sparse_feature_ids": ids})
    return found.withColumns(
        {"sparse_feature_values": F.array_repeat(F.lit(1.0), F.size("sparse_feature_ids")), "dense_feature_count": F.size("dense_features"), "sparse_feature_count": F.size("sparse_feature_ids")}
    )


def checked(requests: DataFrame) -> DataFrame:
    """Requests with ``error`` where the context is unknown or there is nothing to decide by."""
    known = F.col("task_context").isin(*POLICIES)
    return requests.withColumn(
        "error",
        F.coalesce(
            "error", F.when(~known, F.concat(F.lit("unknown context "), F.col("task_context"))),
            F.when(~F.col("has_features") & F.col("calibrated_probability").isNull(), "features or calibrated_probability required"),
        ),
    )


def calibrate(scored: DataFrame, calibrator, source: str = "score") -> DataFrame:
    """A probability that comes with the request overrides the model's."""
    scored = calibration.calibrated(scored, calibrator, "raw_score" if source == "score" else "probability", "__own")
    own = F.when(F.col("has_features"), F.col("__own"))
    return scored.withColumns({"raw_probability": F.when(F.col("has_features"), F.col("probability")), "probability": F.coalesce("calibrated_probability", own)}).drop("__own")


def route(calibrated: DataFrame) -> DataFrame:
    """Decisions of the requests without an error."""
    good = policy.decide(calibrated.withColumn("task_context", F.when(F.col("error").isNull(), F.col("task_context")).otherwise(F.lit("bank_marketing"))))
    blank = {c: F.when(F.col("error").isNull(), F.col(c)) for c in ("action", "action_reason", "threshold_value", "manual_review_required", "decision_policy_version")}
    return good.withColumns(blank | {"prediction_id": F.concat(F.lit("prediction_"), F.col("event_id")), "decision_id": F.concat(F.lit("decision_"), F.col("event_id"))})


def predict(requests: DataFrame, model: training.Model, calibrator, source: str = "score", config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Scored and routed requests.  A request without features needs a probability of its own.  Requests in
    error keep ``error`` and are not routed."""
    scored = training.with_probability(look_up_features(checked(requests), config), model)
    return route(calibrate(scored, calibrator, source))


def prediction_log(rows: DataFrame, model: training.Model, config: FeatureConfig = FeatureConfig(), latency_ms: float | None = None) -> DataFrame:
    """Contract rows of the prediction log (requests with features only).  ``latency_ms`` is the time that
    the batch of requests took, which each of them waited for; null where it was not measured."""
    stamps = {"feature_set_version": F.lit(model.feature_set_version), "hash_dimension": F.lit(config.hash_dimension).cast("long"), "dense_feature_names": F.array(*map(F.lit, config.dense_names))}
    ts = F.col("event_ts").cast("timestamp")
    full = rows.filter("error is null and has_features").withColumns(stamps)
    return full.withColumns(
        {
            "feature_vector": F.struct(*schemas.FEATURE_VECTOR.names), "prediction_ts": ts, "prediction_date": F.to_date(ts), "model_version": F.lit(model.model_version),
            "calibration_version": F.lit("calibration_v1"), "calibrated_score": F.col("probability"), "latency_ms": F.lit(latency_ms).cast("double"),
        }
    ).select(*schemas.PREDICTION_LOG.names)


def decision_log(rows: DataFrame) -> DataFrame:
    ts = F.col("event_ts").cast("timestamp")
    return rows.filter("error is null").withColumns({"decision_ts": ts, "decision_date": F.to_date(ts), "outcome_delay_days": F.lit(None).cast("int"), "calibrated_probability": F.col("probability")}).select(*schemas.DECISION_OUTCOME.names)


#: Steps of a request that ``serve`` can time, in their order.
STAGES = ("lookup", "score", "calibrate", "route", "log")
STAGE_LATENCY = "batch_id long, stage string, requests long, batch_ms double"


def serve(spark: SparkSession, folder: str, out: str, checkpoint: str, model: training.Model, calibrator, source: str = "score", config: FeatureConfig = FeatureConfig(), timed: bool = False, files_per_batch: int | None = None):
    """Start a stream over files of request lines; each batch is appended to both logs and to the
    rejected requests, under its batch id, so that a repeated batch replaces its own files.  The logs repeat names in every
    line, so they are compressed.

    With ``timed`` each step of a batch is carried out by itself and its time appended to ``stages``, which costs a pass
    over the batch for each step; without, a batch is one plan."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else spark.readStream
    requests = files.parse_requests(reader.text(folder))
    steps = (
        lambda rows: look_up_features(checked(rows), config), lambda rows: training.with_probability(rows, model), lambda rows: calibrate(rows, calibrator, source), route,
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        began, times, held = time.perf_counter(), [], []
        rows = batch
        for stage, step in zip(STAGES, steps, strict=False):
            at, rows = time.perf_counter(), step(rows)
            if timed:
                held.append(rows := rows.persist())
                times.append((batch_id, stage, rows.count(), (time.perf_counter() - at) * 1000))
                # The step before has been read.
                for table in held[:-1]:
                    table.unpersist()
                held = held[-1:]
        if not timed:
            held.append(rows := rows.persist())
            rows.count()
        took, at = (time.perf_counter() - began) * 1000, time.perf_counter()
        for name, part in (("predictions", prediction_log(rows, model, config, took)), ("decisions", decision_log(rows)), ("rejected", rows.filter("error is not null").select("request_id", "event_id", "error"))):
            part.write.mode("overwrite").option("ignoreNullFields", False).option("compression", "gzip").json(f"{out}/{name}/batch={batch_id}")
        if timed:
            times.append((batch_id, "log", times[-1][2], (time.perf_counter() - at) * 1000))
            spark.createDataFrame(times, STAGE_LATENCY).coalesce(1).write.mode("overwrite").json(f"{out}/stages/batch={batch_id}")
        for table in held:
            table.unpersist()

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_latencies(spark: SparkSession, out: str) -> DataFrame:
    """(batch_id, stage, requests, batch_ms) of the batches that were timed."""
    return spark.read.schema(STAGE_LATENCY).json(f"{out}/stages/batch=*")


def stage_percentiles(latencies: DataFrame) -> DataFrame:
    """(stage, batches, requests, p50_ms, p95_ms, p99_ms, mean_ms_per_request), in order of the stages: every request waits for
    its batch, so percentiles are over batches and the mean is by request."""
    found = percentiles(latencies, ["stage"], "batch_ms", (0.5, 0.95, 0.99)).select("stage", *(F.col(f"p{i}").alias(f"p{n}_ms") for i, n in enumerate((50, 95, 99))))
    sums = latencies.groupBy("stage").agg(F.count("*").alias("batches"), F.sum("requests").alias("requests"), safe_rate(F.sum("batch_ms"), F.sum("requests")).alias("mean_ms_per_request"))
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    return sums.join(found, "stage").withColumn("place", place).select("place", "stage", "batches", "requests", "p50_ms", "p95_ms", "p99_ms", "mean_ms_per_request")


def progress_rows(spark: SparkSession, query) -> DataFrame:
    """(batch_id, rows, step, ms): what a query's progress events say of its own steps."""
    found = [(p.batchId, p.numInputRows, step, float(ms)) for p in query.recentProgress for step, ms in sorted(p.durationMs.items())]
    return spark.createDataFrame(found, "batch_id long, rows long, step string, ms double")


# Event streams
def as_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(folder)


def daily_counts(events: DataFrame, at: str = "ts", lateness: str = "1 day", window: str = "1 day") -> DataFrame:
    """(window start, event_type, n, value) over event time."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, lateness).groupBy(F.window(at, window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("day"), "event_type", "n", "value")


def first_seen(events: DataFrame, key: str = "event_id", at: str = "ts", lateness: str = "1 day") -> DataFrame:
    """Events whose key has not come before within the lateness."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def matched_labels(events: DataFrame, labels: DataFrame, hours: int = 24, lateness: str = "1 hour", unlabelled: bool = False) -> DataFrame:
    """Stream-stream join of events (event_id, event_ts) with labels (parent_event_id, label_ts) that come within the
    attribution window.

    With ``unlabelled`` also the events without one, once and with null labels, as soon as both streams are past the
    window and the lateness.  A label that comes again (the same ``label_event_id``, where there is one) counts once."""
    left, right = events.withWatermark("event_ts", lateness), labels.withWatermark("label_ts", lateness)
    if "label_event_id" in labels.columns:
        right = right.dropDuplicatesWithinWatermark(["label_event_id"])
    inside = F.expr(f"event_id = parent_event_id and label_ts >= event_ts and label_ts <= event_ts + interval {hours} hours")
    return left.join(right, inside, "leftOuter" if unlabelled else "inner")


def run_to_files(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there now into Parquet files of the shared folder, with the checkpoint beside them,
    and read these back.  No row passes through the driver.  In modes that send all results again, each
    batch's are a folder of their own and the last one counts."""
    path = scratch.new_path(spark, f"stream-{name}")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{path}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")
    last = {"batch": None}

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/{batch_id}")
        last["batch"] = batch_id

    writer.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows/{last['batch']}") if last["batch"] is not None else spark.createDataFrame([], stream.schema)
