"""Exact draws with replacement: so many rows in all, the same ones on every run.

Draws are dealt down a tree.  Rows have consecutive numbers in a total order, a thousand numbers are a leaf
and a thousand leaves a branch, so all sizes are known without counting.  The driver deals the draws to the branches
(a number for each million rows), a task deals a branch's share to its leaves, and the rows of
a leaf take theirs from a generator that is seeded by the leaf.  Each step is a multinomial draw by size, which makes
the whole one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files

LEAF, BRANCH = 1000, 1000


def _shares(total: int, size: int) -> np.ndarray:
    """Sizes of the parts that so many items are cut into."""
    return np.diff(np.append(np.arange(0, total, size), total))


def _deal(seed: Sequence[int], draws: int, sizes: np.ndarray) -> np.ndarray:
    return np.random.default_rng(seed).multinomial(draws, sizes / sizes.sum())


def with_draws(rows: DataFrame, n: int | None, order: Sequence[str], seed: int = 0, name: str = "draws") -> DataFrame:
    """Adds how often each row is drawn: ``n`` times in all (as many as there are rows, where None).

    ``order`` should tell rows apart; rows that it does not take their numbers in any order.  No rows, no draws."""
    spark = rows.sparkSession
    numbered = files.with_row_id(rows, order, "__n")
    total = numbered.agg(F.max("__n")).first()[0]
    if total is None:
        return rows.withColumn(name, F.lit(0).cast("long"))
    total, branch = total + 1, LEAF * BRANCH
    sizes = _shares(total, branch)
    dealt = _deal([seed, 0], total if n is None else n, sizes)
    branches = spark.createDataFrame([(i, int(size), int(k)) for i, (size, k) in enumerate(zip(sizes, dealt, strict=True))], "branch long, size long, draws long")

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, size, draws in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes = _shares(size, LEAF)
                numbers = b * BRANCH + np.arange(len(sizes))
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(sizes.astype(np.int64)), pa.array(_deal([seed, 1, b], draws, sizes))], ["__leaf", "__size", "__share"])

    dealt_leaves = branches.repartition("branch").mapInArrow(leaves, "__leaf long, __size long, __share long")
    met = numbered.withColumn("__leaf", F.floor(F.col("__n") / LEAF)).join(dealt_leaves, "__leaf")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf_of, values = None, None
        for batch in batches:
            number, leaf, size, share = (batch.column(c).to_numpy() for c in ("__n", "__leaf", "__size", "__share"))
            out = np.zeros(batch.num_rows, np.int64)
            for at in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(leaf)) + 1):
                if len(at):
                    if leaf[at[0]] != leaf_of:
                        leaf_of = leaf[at[0]]
                        values = _deal([seed, 2, int(leaf_of)], int(share[at[0]]), np.ones(size[at[0]]))
                    out[at] = values[number[at] % LEAF]
            kept = [batch.column(c) for c in batch.schema.names if c not in ("__n", "__leaf", "__size", "__share")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out)], [*(c for c in batch.schema.names if c not in ("__n", "__leaf", "__size", "__share")), name])


    schema = T.StructType([*(f for f in rows.schema.fields if f.name != name), T.StructField(name, T.LongType())])
    narrow = met.select(*(c for c in rows.columns if c != name), "__n", "__leaf", "__size", "__share").sortWithinPartitions("__leaf")
    return narrow.mapInArrow(own, schema)


def resampled(rows: DataFrame, order: str = "training_row_id", seed: int = 0, weight: str = "sample_weight") -> DataFrame:
    """A bootstrap sample of the training rows, exactly as many as there are, as weights; other splits stay."""
    train = with_draws(rows.filter("split = 'train'"), None, [order], seed).filter("draws > 0")
    return train.withColumn(weight, F.col(weight) * F.col("draws")).drop("draws").unionByName(rows.filter("split <> 'train'"))


def oversampled(rows: DataFrame, order: str = "training_row_id", seed: int = 0, weight: str = "sample_weight") -> DataFrame:
    """Training rows with the rarer label drawn (on top of each once) until both are equally many, as weights."""
    train = rows.filter("split = 'train'")
    counts = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    if len(counts) < 2 or counts[0] == counts[1]:
        return rows
    rare = min(counts, key=lambda label: (counts[label], label))
    few = with_draws(train.filter(F.col("label") == rare), max(counts.values()) - counts[rare], [order], seed)
    few = few.withColumn(weight, F.col(weight) * (1 + F.col("draws"))).drop("draws")
    return few.unionByName(train.filter(F.col("label") != rare)).unionByName(rows.filter("split <> 'train'"))
