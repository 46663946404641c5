"""The shared test tables in the shapes that jobs work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import POLICIES
from ..operators.policy import decide


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contact for each order: raw columns as text, row_id, event_ts and label."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    history = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = F.col("o_orderdate").cast("date")
    flag = lambda c: F.when(c, "yes").otherwise("no")
    earlier = orders.withColumns({
        "gap": F.coalesce(F.datediff(day, F.lag(day).over(history)), F.lit(-1)), "n_before": F.row_number().over(history) - 1, "last_status": F.lag("o_orderstatus").over(history),
    })
    rows = earlier.join(counts, "o_orderkey", "left").join(people, F.col("o_custkey") == F.col("c_custkey"))
    text = lambda c: c.cast("string")
    return rows.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").cast("timestamp").alias("event_ts"), (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        text(18 + F.col("o_custkey") % 60).alias("age"), F.col("c_mktsegment").alias("job"), F.col("o_orderpriority").alias("marital"), F.col("n_name").alias("education"),
        flag(F.col("o_orderkey") % 2 == 0).alias("default"), text(F.col("c_acctbal")).alias("balance"), flag(F.col("o_custkey") % 2 == 0).alias("housing"),
        flag(F.col("o_custkey") % 3 == 0).alias("loan"), F.col("r_name").alias("contact"), text(F.dayofmonth(day)).alias("day"), F.lower(F.date_format(day, "MMM")).alias("month"),
        text(F.col("o_orderkey") % 600).alias("duration"), text(F.coalesce("lines", F.lit(0))).alias("campaign"), text(F.col("gap")).alias("pdays"), text(F.col("n_before")).alias("previous"),
        F.col("last_status").alias("poutcome"),
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction for each event: probability, label, weight, context, latency."""
    events = table(spark, sf_dir, "events")
    context = F.element_at(F.array(*map(F.lit, POLICIES)), (F.col("user_id") % 3 + 1).cast("int"))
    probability = (F.get_json_object("props", "$.k").cast("int") + 0.5) / 100
    return events.select(
        "event_id", F.concat(F.lit("prediction_"), F.col("event_id").cast("string")).alias("prediction_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type",
        context.alias("task_context"), probability.alias("probability"), probability.alias("score"), probability.alias("calibrated_score"),
        (F.col("event_type") == "purchase").cast("int").alias("label"), (1.0 + F.col("event_id") % 3).alias("weight"), F.col("value").alias("latency_ms"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for nine of ten predictions, the label where it is known, some without a prediction and
    some that carry no probability."""
    events = scored_events(spark, sf_dir).filter("event_id % 10 <> 0")
    decided = decide(events).withColumns({
        "prediction_id": F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("lost_"), F.col("prediction_id"))).otherwise(F.col("prediction_id")),
        "realized_label": F.when(F.col("event_id") % 7 != 0, F.col("label")), "outcome_delay_days": F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 30).cast("int")),
        "calibrated_probability": F.when(F.col("event_id") % 11 != 0, F.col("probability")), "raw_probability": F.when(F.col("event_id") % 13 != 0, F.col("probability") * 0.9 + 0.02),
    })
    return decided.withColumn("decision_id", F.concat(F.lit("decision_"), F.col("event_id").cast("string")))
