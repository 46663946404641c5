"""Logistic regression whose weights are a table, for models that no driver or task should hold.

The method is that of ``training.fit_all`` with one configuration: in each epoch every shard of rows
walks from the common model and hands back its moves.  Here the model is a table of weights.  A
shard fetches the weights of the ids that its rows hold (a join on the id), walks, and its moves are
added up by id and then to the table, which is written anew.  The driver sees three losses an
epoch, a task its shard and that shard's weights.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TrainingConfig
from ..sources import scratch
from . import training

#: Kinds of rows of the table: losses (in moves only), the bias, dense features by place, sparse features by id.
LOSS, BIAS, DENSE, SPARSE = -1, 0, 1, 2
KEY = ["kind", "id"]


@dataclass
class TableFit:
    """``weights`` has (kind, id, weight, squares) and lies in the shared folder until ``drop`` is called."""

    weights: DataFrame
    history: list[dict]
    best_epoch: int

    def sparse(self) -> DataFrame:
        """(feature_id, weight), as ``training.with_table_logit`` takes it."""
        return self.weights.filter(F.col("kind") == SPARSE).select(F.col("id").alias("feature_id"), "weight")

    def drop(self) -> None:
        scratch.drop_table(self.weights)


def fit_table(rows: DataFrame, config: TrainingConfig = TrainingConfig(), order: str = "training_row_id", shard_rows: int = training.SHARD_ROWS, batch_rows: int | None = training.BATCH_ROWS) -> TableFit:
    """One configuration fitted as ``training.fit_all`` does, with any number of sparse ids."""
    table = training.narrow(training.by_split(rows), order)
    sharded = None
    try:
        periods, d = training._checked(table, 1)
        n, positives = periods[0]
        # By the hash of the shard, which the rows' meetings with their weights keep.
        shard = F.pmod(F.xxhash64("order"), F.lit(max(1, -(-n // shard_rows)))).cast("int")
        sharded = table.select(shard.alias("shard"), *table.columns).repartition("shard").sortWithinPartitions("shard").persist(StorageLevel.DISK_ONLY)
        factors = training._factors(n, positives, config)
        held = scratch.stage(_held(sharded, d), "held-ids")
        # Ids that only validation rows hold are no part of the model.
        weights = scratch.stage(held.filter("learnt").select(*KEY).distinct().withColumns({"weight": F.lit(0.0), "squares": F.lit(0.0)}), "weights")
        best, best_loss, best_epoch, waited, history = weights, math.inf, 0, 0, []
        for epoch in range(1, config.max_epochs + 2):
            moves = scratch.stage(_moves(sharded, held, weights, d, config, factors, epoch, epoch > config.max_epochs, batch_rows), "moves")
            losses = {r.id: r.first / r.second if r.second else 0.0 for r in moves.filter(F.col("kind") == LOSS).collect()}
            if epoch > 1:
                # The losses of the model that this pass started from: that of the epoch before.
                history[-1]["train_log_loss"] = losses.get(training.ON_TRAIN, 0.0)
                seen = losses.get(training.ON_VALIDATION)
                if seen is not None:
                    history[-1]["validation_log_loss"] = seen
                waited += 1
                if seen is None or seen < best_loss:
                    if best is not weights:
                        scratch.drop_table(best)
                    best, best_loss, best_epoch, waited = weights, math.inf if seen is None else seen, epoch - 1, 0
            if epoch > config.max_epochs or (config.patience and waited >= config.patience):
                scratch.drop_table(moves)
                break
            following = scratch.stage(_moved(weights, moves, n), "weights")
            for table in (moves, *([weights] if weights is not best else [])):
                scratch.drop_table(table)
            weights = following
            history.append({"epoch": epoch, "train_loss": losses.get(training.ON_THE_WAY, 0.0)})
        for table in (held, *([weights] if weights is not best else [])):
            scratch.drop_table(table)
    finally:
        if sharded is not None:
            sharded.unpersist()
        scratch.drop_table(table)
    return TableFit(best, history, best_epoch)


def _held(sharded: DataFrame, d: int) -> DataFrame:
    """(shard, kind, id, learnt): what each shard needs of the model; ``learnt`` where its training rows hold the id."""
    ids = sharded.select("shard", (F.col("period") == 0).alias("train"), F.explode("ids").alias("id")).filter("id is not null").groupBy("shard", F.lit(SPARSE).alias("kind"), "id").agg(F.max("train").alias("learnt"))
    fixed = F.array(F.struct(F.lit(BIAS).alias("kind"), F.lit(0).cast("long").alias("id")), *(F.struct(F.lit(DENSE).alias("kind"), F.lit(j).cast("long").alias("id")) for j in range(d)))
    return sharded.select("shard").distinct().select("shard", F.inline(fixed)).withColumn("learnt", F.lit(True)).unionByName(ids)


def _moves(sharded: DataFrame, held: DataFrame, weights: DataFrame, d: int, config: TrainingConfig, factors: tuple[float, float], epoch: int, last: bool, batch: int | None) -> DataFrame:
    """(kind, id, first, second): moves of weights and squares times rows, and losses with weights, over all shards."""
    fetched = held.join(weights, KEY).select("shard", *KEY, "weight", "squares")

    def run(rows: pa.Table, model: pa.Table) -> pa.Table:
        number = rows["shard"][0].as_py() if rows.num_rows else 0
        rows, model = rows.sort_by("order"), model.sort_by([(k, "ascending") for k in KEY])
        kind, ids = (model[k].to_numpy() for k in KEY)
        # Bias, dense and sparse weights, in this order; one more place where a shard has no sparse id.
        pad = np.zeros(1 if len(ids) == 1 + d else 0)
        w, squares = (np.concatenate([model[c].to_numpy(), pad]) for c in ("weight", "squares"))
        period, whole = rows["period"].to_numpy(), training._parsed(rows, ids[1 + d :], d)
        sides = (training._part(whole, np.flatnonzero(period == k)) for k in (0, 1))
        out = []
        for places, first, second in training.shard_moves(number, *sides, w, squares, config, False, factors, epoch, last, batch):
            places = np.asarray(places)
            loss = places < 0
            at = np.where(loss, 0, np.minimum(places, len(ids) - 1))
            out.append((np.where(loss, LOSS, kind[at]), np.where(loss, places, ids[at]), first, second))
        columns = [np.concatenate([np.asarray(o[i]) for o in out]) if out else [] for i in range(4)]
        return pa.table({name: pa.array(v, kind) for name, v, kind in zip((*KEY, "first", "second"), columns, (pa.int32(), pa.int64(), pa.float64(), pa.float64()), strict=True)})

    moves = sharded.groupBy("shard").cogroup(fetched.groupBy("shard")).applyInArrow(run, "kind int, id long, first double, second double")
    return moves.groupBy(*KEY).agg(F.sum("first").alias("first"), F.sum("second").alias("second"))


def _moved(weights: DataFrame, moves: DataFrame, n: int) -> DataFrame:
    plus = lambda c, move: (F.col(c) + F.coalesce(move, F.lit(0.0)) / n).alias(c)
    return weights.join(moves, KEY, "left").select(*KEY, plus("weight", F.col("first")), plus("squares", F.col("second")))


def with_logit(rows: DataFrame, fit: TableFit, dense: str = "dense_features", name: str = "raw_score") -> DataFrame:
    """Adds the linear score of a fit, from its table; the few dense weights and the bias are read first."""
    few = {(r.kind, r.id): r.weight for r in fit.weights.filter(F.col("kind") != SPARSE).collect()}
    linear: Column = F.lit(few[BIAS, 0])
    for j in range(len(few) - 1):
        linear = linear + F.col(dense)[j] * F.lit(few[DENSE, j])
    return training.with_table_logit(rows, fit.sparse(), linear, name=name)
