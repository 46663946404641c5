"""Fits make their rows once, however many passes they take."""

import pytest
from pyspark.sql import functions as F

from quillon.config import TrainingConfig
from quillon.operators import training, weight_table

N = 300


def counted_rows(spark, seen):
    """Training rows that count how often one of them is made."""

    @F.udf("double")
    def dense(i):
        seen.add(1)
        return float(i % 7)

    split = F.when(F.col("id") % 5 < 4, "train").otherwise("validation")
    return spark.range(N).select(
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("training_row_id"), split.alias("split"), (F.col("id") % 3 == 0).cast("int").alias("label"), F.lit(1.0).alias("sample_weight"),
        F.array(dense("id"), F.lit(1.0)).alias("dense_features"), F.array(F.col("id") % 11).alias("sparse_feature_ids"), F.array(F.lit(1.0)).alias("sparse_feature_values"),
    )


@pytest.mark.parametrize("fit", ["fit_all", "fit_table", "train_distributed"])
def test_rows_of_a_fit_are_made_once(spark, fit):
    seen = spark.sparkContext.accumulator(0)
    rows, config = counted_rows(spark, seen), TrainingConfig(max_epochs=2)
    if fit == "fit_all":
        training.fit_all(rows, {"a": config, "b": TrainingConfig(max_epochs=3, seed=4)}, bootstrap=["b"], shard_rows=50)
    elif fit == "train_distributed":
        training.train_distributed(rows, config, hash_dimension=16)
    else:
        weight_table.fit_table(rows, config, shard_rows=50)
    # The distributed fit has no validation rows.
    assert seen.value == (rows.filter("split = 'train'").count() if fit == "train_distributed" else N)


def test_a_task_of_a_fit_holds_one_shard(spark):
    table = training.narrow(training.by_split(counted_rows(spark, spark.sparkContext.accumulator(0))), "training_row_id")
    dealt = training.sharded_rows(table, 9).select("shard", F.spark_partition_id().alias("part")).distinct().collect()
    assert len(dealt) == 9 == len({r.part for r in dealt}) == len({r.shard for r in dealt})
