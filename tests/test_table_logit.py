"""Scores against a table of weights, by blocks of rows."""

from pyspark.sql import functions as F

from quillon.operators import training


def test_blocks_score_every_row_in_partitions_that_grow(spark, monkeypatch):
    monkeypatch.setattr(training, "BLOCK_BITS", 4)
    monkeypatch.setattr(training, "BLOCKS", 1)
    weights = {i: (i % 7 - 3) / 10 for i in range(50)}
    made = [([i % 60, None, (i * 7) % 60, i % 60], [1.0, 5.0, 0.5, None if i % 3 else 2.0]) if i % 10 else (None, None) for i in range(400)]
    rows = spark.createDataFrame([(i // 2, ids, values) for i, (ids, values) in enumerate(made)], "key long, sparse_feature_ids array<long>, sparse_feature_values array<double>")
    table = training.Model(0.0, [], weights).weights_table(spark)
    # A weight in two parts counts as their sum; a null one as nothing.
    table = table.withColumn("weight", F.col("weight") / 2).unionAll(table.withColumn("weight", F.col("weight") / 2)).unionAll(spark.createDataFrame([(3, None), (None, 4.0)], table.schema))
    found = training.with_table_logit(rows, table, 0.25)
    score = lambda ids, values: 0.25 + sum(weights.get(k, 0.0) * (v or 0.0) for k, v in zip(ids or [], values or [], strict=True) if k is not None)
    assert sorted(round(r.raw_score, 9) for r in found.collect()) == sorted(round(score(*m), 9) for m in made)
    # More rows, more partitions: 400 rows in blocks of at most 16, at least one to a partition.
    monkeypatch.setattr(training, "BLOCKS", 4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert training.with_table_logit(rows, table).rdd.getNumPartitions() == -(-400 // 64)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
