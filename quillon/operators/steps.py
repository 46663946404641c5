"""As-of joins to step tables, and joins by keys of which a few may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stage

#: A key with this share of all rows is joined by broadcast, so there are at most as many of these.
HOT_SHARE = 1000


def join_by_key(rows: DataFrame, table: DataFrame, key: str, counted: DataFrame) -> DataFrame:
    """Left join of rows to a table with one row for each key, whatever share of the rows a key has.

    ``counted`` has (key, n), the rows of each key.  The few keys that hold a large share are broadcast,
    the others meet by their key, and rows without a key stay where they are."""
    added = [c for c in table.columns if c != key]
    total = counted.agg(F.sum("n")).first()[0] or 0
    heavy = counted.filter(F.col("n") * HOT_SHARE >= total).select(F.col(key).alias("__key"), F.lit(True).alias("__hot"))
    # Rows of a heavy key take its values along with the mark.
    hot = table.join(F.broadcast(heavy), F.col(key) == F.col("__key")).select("__key", "__hot", *(F.col(c).alias(f"__{c}") for c in added))
    marked = rows.join(F.broadcast(hot), rows[key] == F.col("__key"), "left")
    kept = [F.col(c) for c in rows.columns]
    done = marked.filter(F.col("__hot") | F.col(key).isNull()).select(*kept, *(F.col(f"__{c}").alias(c) for c in added))
    rest = marked.filter(F.col("__hot").isNull() & F.col(key).isNotNull()).select(*kept)
    return done.unionByName(rest.join(table, key, "left").select(*kept, *added))


def step_values(scores: DataFrame, steps: DataFrame) -> DataFrame:
    """(score, value) for distinct ``score``: the value of the first ``upper`` of ``steps`` that is not below it, or of the last
    step above all.

    Scores and steps are range-partitioned together and written, so that a row's partition stays the
    same; inside a partition the next step is found from the right, and a partition's first step is
    carried to those before it."""
    both = scores.select(F.col("score").cast("double").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("value")).unionByName(
        steps.select(F.col("upper").cast("double").alias("at"), F.lit(1).alias("kind"), F.col("value").cast("double").alias("value"))
    )
    parts = stage(both.repartitionByRange("at", "kind").withColumn("part", F.spark_partition_id()), "steps")
    is_step, step = F.col("kind") == 1, F.struct("value")
    right = Window.partitionBy("part").orderBy(F.col("at").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ends = parts.groupBy("part").agg(*(pick(F.when(is_step, step), F.when(is_step, F.col("at"))).alias(name) for name, pick in (("first", F.min_by), ("last", F.max_by))))
    # One row for each partition.
    order = Window.orderBy(F.col("part").desc())
    later, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = ends.select("part", F.last("first", ignorenulls=True).over(later).alias("next"), F.first("last", ignorenulls=True).over(every).alias("top"))
    found = parts.withColumn("inside", F.last(F.when(is_step, step), ignorenulls=True).over(right)).filter("kind = 0").join(carried, "part")
    return found.select(F.col("at").alias("score"), F.coalesce("inside", "next", "top")["value"].alias("value"))


def asof_join(rows: DataFrame, steps: DataFrame, score: str = "score", name: str = "value", empty: float = 0.5) -> DataFrame:
    """Adds ``name``: the value of the first step (upper, value) that is not below the score, as ``step_lookup`` does
    with a literal, for tables of any length.  A null score has a null value; without steps it is ``empty``.

    Steps are met by the distinct scores only, and rows take the value of their score."""
    key = "__score"
    keyed = rows.withColumn(key, F.col(score).cast("double"))
    counted = stage(keyed.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")), "distinct-scores")
    found = step_values(counted.select(F.col(key).alias("score")), steps).select(F.col("score").alias(key), F.coalesce("value", F.lit(empty)).alias("__value"))
    return join_by_key(keyed, found, key, counted).drop(key, name).withColumnRenamed("__value", name)
