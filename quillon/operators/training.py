"""Logistic regression on dense and hashed sparse features.

``fit_all`` fits any number of configurations together (``fit_table``, in ``weight_table``, one of any size).  Rows are dealt by hash into shards of
bounded size.  In each epoch every shard starts from the common model, walks through its rows in
mini-batches (steps of plain or per-coordinate rates, penalties, either loss) and hands back by how
much each weight has moved; the moves are averaged by rows in Spark.  With one shard and batches of
one row this is the sequential method; with one batch a shard and plain rates it is gradient
descent on all rows.  The same pass measures the losses of the model it starts from, on which early
stopping rests.  ``train_distributed`` fits the same model class by another optimizer.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TrainingConfig
from ..functions.columns import sigmoid
from ..sources import scratch

#: Most sparse weights that scoring takes as a literal map, and as arrays that are broadcast.
MAP_WEIGHTS = 256
BROADCAST_WEIGHTS = 2_000_000


@dataclass
class Model:
    bias: float
    dense: list[float]
    sparse: dict[int, float] = field(default_factory=dict)
    dense_names: list[str] = field(default_factory=list)
    feature_set_version: str = ""
    task_context: str = ""
    model_version: str = "logistic_regression_v1"
    best_epoch: int = 0

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Model:
        found = json.loads(text)
        return Model(**(found | {"sparse": {int(k): v for k, v in found["sparse"].items()}}))

    def top(self, n: int = 10, sparse: bool = False) -> list[tuple[str | int, float]]:
        pairs = list(self.sparse.items()) if sparse else list(zip(self.dense_names or range(len(self.dense)), self.dense, strict=True))
        return sorted(pairs, key=lambda p: (-abs(p[1]), str(p[0])))[:n]

    def weights_table(self, spark) -> DataFrame:
        return spark.createDataFrame(list(self.sparse.items()) or [(-1, 0.0)], "feature_id long, weight double")


def _pairs(ids: str, values: str) -> Column:
    """Array of (id, value) of a row; what is null or lacks its partner has value 0."""
    zipped = F.arrays_zip(F.col(ids).alias("id"), F.col(values).alias("value"))
    whole = F.transform(zipped, lambda p: F.struct(F.coalesce(p["id"].cast("long"), F.lit(-1).cast("long")).alias("id"), F.when(p["id"].isNotNull(), F.coalesce(p["value"].cast("double"), F.lit(0.0))).otherwise(0.0).alias("value")))
    return F.coalesce(whole, F.array().cast("array<struct<id:bigint,value:double>>"))


def _looked_up(spark, weights: dict[int, float]):
    """A function of ids and values that adds up the weighted values inside each row, from sorted arrays that are broadcast."""
    keys = np.array(sorted(weights), np.int64)
    shared = spark.sparkContext.broadcast((keys, np.array([weights[k] for k in keys.tolist()])))

    @F.pandas_udf("double")
    def sums(ids: pd.Series, values: pd.Series) -> pd.Series:
        keys, amounts = shared.value
        flat, of = np.concatenate([*ids, []]).astype(np.int64), np.repeat(np.arange(len(ids)), ids.str.len().to_numpy(np.int64))
        at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
        found = np.where(keys[at] == flat, amounts[at], 0.0) * np.concatenate([*values, []])
        return pd.Series(np.bincount(of, found, len(ids)))

    return sums


def _linear(model_bias: float, weights: Sequence[float], dense: str) -> Column:
    total = F.when(F.size(dense) != len(weights), F.raise_error(F.lit("dense features and weights differ in length"))).otherwise(F.lit(float(model_bias)))
    for i, weight in enumerate(weights):
        total = total + F.col(dense)[i] * F.lit(float(weight))
    return total


def with_logit(rows: DataFrame, model: Model, dense: str = "dense_features", ids: str = "sparse_feature_ids", values: str = "sparse_feature_values", name: str = "raw_score") -> DataFrame:
    """Adds the linear score: bias, dense weights and the weights of the active sparse ids (0 if unknown).

    Every row is scored by itself whatever its keys and the number of weights: few weights are a
    literal map, more are arrays that are broadcast, and more than ``BROADCAST_WEIGHTS`` a joined table."""
    linear = _linear(model.bias, model.dense, dense)
    if len(model.sparse) > BROADCAST_WEIGHTS:
        return with_table_logit(rows, model.weights_table(rows.sparkSession), linear, ids, values, name)
    if len(model.sparse) > MAP_WEIGHTS:
        pairs = _pairs(ids, values)
        found = _looked_up(rows.sparkSession, model.sparse)(F.transform(pairs, lambda p: p["id"]), F.transform(pairs, lambda p: p["value"]))
        return rows.withColumn(name, linear + found)
    if not model.sparse:
        return rows.withColumn(name, linear)
    table = F.create_map(*(F.lit(x) for pair in model.sparse.items() for x in pair))
    weight = lambda p: F.coalesce(F.try_element_at(table, p["id"]), F.lit(0.0)) * p["value"]
    return rows.withColumn(name, linear + F.aggregate(F.transform(_pairs(ids, values), weight), F.lit(0.0), lambda a, v: a + v))


#: Rows that are scored together against a table of weights, and blocks of them to a partition.
BLOCK_BITS, BLOCKS = 14, 8


def with_table_logit(rows: DataFrame, weights: DataFrame, linear: Column | float = 0.0, ids: str = "sparse_feature_ids", values: str = "sparse_feature_values", name: str = "raw_score") -> DataFrame:
    """``with_logit`` by a table (feature_id, weight) of any size.

    Rows are numbered and written first, so that rows of equal or null keys stay apart.  They meet the weights by
    blocks of at most 2^14: the distinct ids of a block are joined to the weights, and the block's rows are added
    up against what it fetched.  No row is copied for its ids, and the partitions grow in number with the rows, so a
    task sorts the same amount whatever the table."""
    spark = rows.sparkSession
    numbered = scratch.stage(rows.withColumn("__row", F.monotonically_increasing_id()), "scored")
    block = F.shiftright("__row", BLOCK_BITS).alias("__block")
    active = numbered.select("__row", block, _pairs(ids, values).alias("__pairs"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-numbered.count() // (BLOCKS << BLOCK_BITS)))
    needed = active.select("__block", F.explode(F.array_distinct(F.transform("__pairs", lambda p: p["id"]))).alias("feature_id")).distinct()
    fetched = needed.join(weights.select("feature_id", "weight"), "feature_id").select(F.col("__block").alias("__for"), "feature_id", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))

    def add_up(rows: pa.Table, fetched: pa.Table) -> pa.Table:
        keys, which = np.unique(fetched["feature_id"].to_numpy(), return_inverse=True)
        amounts = np.bincount(which, fetched["weight"].to_numpy(), len(keys))
        pairs = rows["__pairs"].combine_chunks()
        of, flat = np.repeat(np.arange(len(pairs)), pairs.value_lengths().to_numpy()), pairs.flatten()
        held, value = (flat.field(n).to_numpy() for n in ("id", "value"))
        at = np.searchsorted(keys, held)
        known = np.flatnonzero(np.append(keys, -1)[at] == held) if len(keys) else np.array([], np.int64)
        known = known[at[known] < len(keys)]
        sums = np.bincount(of[known], amounts[at[known]] * value[known], len(pairs))
        return pa.table({"__row": rows["__row"], "__sparse": pa.array(sums)})

    active, fetched = (table.repartition(parts, key).groupBy(key) for table, key in ((active, "__block"), (fetched, "__for")))
    sums = active.cogroup(fetched).applyInArrow(add_up, "__row long, __sparse double").repartition(parts, "__row")
    linear = linear if isinstance(linear, Column) else F.lit(float(linear))
    return numbered.repartition(parts, "__row").join(sums, "__row", "left").withColumn(name, linear + F.coalesce("__sparse", F.lit(0.0))).drop("__sparse", "__row")


def with_probability(rows: DataFrame, model: Model, **names: str) -> DataFrame:
    return with_logit(rows, model, **names).withColumn("probability", sigmoid(F.col(names.get("name", "raw_score"))))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """(weight_negative, weight_positive): rows over twice the rows of the class; one where a class is missing."""
    n, p = F.count("*"), F.coalesce(F.sum(label), F.lit(0))
    balanced = lambda c: F.when((p > 0) & (p < n), n / (2 * c)).otherwise(1.0)
    return rows.agg(balanced(F.nullif(n - p, F.lit(0))).cast("double").alias("weight_negative"), balanced(F.nullif(p, F.lit(0))).cast("double").alias("weight_positive"))


#: Rows of a shard and of a mini-batch, and the most distinct sparse ids of a model.
SHARD_ROWS, BATCH_ROWS, MOST_FEATURES = 25_000, 32, 1 << 22
#: What a row of a pass's result is about, besides the place of a weight: losses of the model that the pass started from
#: on train and validation rows, and the train loss on the way.
ON_TRAIN, ON_VALIDATION, ON_THE_WAY = -3, -2, -1
MOVES = "config int, place long, first double, second double"


@dataclass
class _Shard:
    """Rows of one split of a shard; sparse values are one after the other, with the row of each."""

    labels: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    places: np.ndarray
    values: np.ndarray
    starts: np.ndarray


def _raw(shard: _Shard, w: np.ndarray, rows: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Linear scores of some rows, and the places, values and rows of their sparse features.  ``w``
    holds the bias, the dense and the sparse weights."""
    counts = (shard.starts[1:] - shard.starts[:-1])[rows]
    at = np.repeat(shard.starts[:-1][rows] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    of, places, values = np.repeat(np.arange(len(counts)), counts), shard.places[at], shard.values[at]
    dense = shard.dense[rows]
    return w[0] + dense @ w[1 : 1 + dense.shape[1]] + np.bincount(of, w[places] * values, len(counts)), places, values, of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    small = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + small), small / (1 + small))


def _cross_entropy(labels: np.ndarray, p: np.ndarray) -> np.ndarray:
    return -np.log(np.clip(np.where(labels == 1, p, 1 - p), 1e-15, 1 - 1e-15))


@dataclass
class _Layout:
    """The rows of an epoch in their order, cut into batches: entry i of ``starts``, ``active_starts`` is where the sparse
    values, the distinct places of batch i begin.  ``of`` is an entry's row inside its batch, ``which`` its place among the
    distinct ones of the batch."""

    rows: np.ndarray
    dense: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    of: np.ndarray
    which: np.ndarray
    starts: np.ndarray
    active: np.ndarray
    active_starts: np.ndarray


def laid_out(shard: _Shard, order: np.ndarray, batch: int) -> _Layout:
    """What the batches of an epoch need besides the weights, for all of them at once."""
    counts = (shard.starts[1:] - shard.starts[:-1])[order]
    ends = np.cumsum(counts)
    at = np.repeat(shard.starts[:-1][order] - ends + counts, counts) + np.arange(counts.sum())
    row = np.repeat(np.arange(len(order)), counts)
    edges = np.arange(0, len(order) + batch, batch)
    starts = np.concatenate([[0], ends])[np.minimum(edges, len(order))]
    width = int(shard.places.max(initial=0)) + 1
    found, which = np.unique(row // batch * width + shard.places[at], return_inverse=True)
    active_starts = np.searchsorted(found, np.arange(len(edges)) * width)
    return _Layout(order, shard.dense[order], shard.labels[order], shard.values[at], row % batch, which - active_starts[row // batch], starts, found % width, active_starts)


def walk(laid: _Layout, row_weights: np.ndarray, w: np.ndarray, squares: np.ndarray, config: TrainingConfig, batch: int) -> tuple[float, float]:
    """One epoch over the rows, in mini-batches; changes ``w`` and ``squares``.  Returns the weighted sum of
    the losses before each step, and the weights."""
    n, d = laid.dense.shape
    fixed, weights, seen = slice(1, 1 + d), row_weights[laid.rows], np.empty(n)

    def step(at, gradient: np.ndarray, held: np.ndarray) -> None:
        if config.optimizer == "adagrad":
            sums = squares[at] + gradient * gradient
            squares[at] = sums
            gradient = gradient / np.sqrt(sums + config.epsilon)
        w[at] = held - config.learning_rate * gradient

    def penalised(held: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        if config.l2:
            gradient = gradient + config.l2 * held
        return gradient + config.l1 * np.sign(held) if config.l1 else gradient

    for i, lo in enumerate(range(0, n, batch)):
        rows, entries = slice(lo, min(lo + batch, n)), slice(laid.starts[i], laid.starts[i + 1])
        size, dense, of, which, values = rows.stop - lo, laid.dense[rows], laid.of[entries], laid.which[entries], laid.values[entries]
        active = laid.active[laid.active_starts[i] : laid.active_starts[i + 1]]
        held, of_dense = w[active], w[fixed].copy()
        p = _sigmoid(w[0] + dense @ of_dense + np.bincount(of, held[which] * values, size))
        seen[rows] = p
        scale = weights[rows] * (p - laid.labels[rows]) / size
        if config.loss == "mse":
            scale = scale * (p * (1 - p))
        step(slice(0, 1), scale.sum(keepdims=True), w[:1].copy())
        step(fixed, penalised(of_dense, scale @ dense), of_dense)
        step(active, penalised(held, np.bincount(which, scale[of] * values, len(active))), held)
    loss = _cross_entropy(laid.labels, seen) if config.loss == "cross_entropy" else 0.5 * (seen - laid.labels) ** 2
    return float(weights @ loss), float(weights.sum())


def _parsed(table: pa.Table, ids: np.ndarray, d: int) -> _Shard:
    """Arrow rows as arrays; a sparse id that was not among the training rows' has no weight."""
    column = lambda name: table[name].combine_chunks()
    sparse, values = column("ids"), column("values")
    found = sparse.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.minimum(np.searchsorted(ids, found), max(0, len(ids) - 1))
    known = ids[at] == found if len(ids) else np.zeros(len(found), bool)
    counts = np.asarray(sparse.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    amounts = np.where(known, values.flatten().to_numpy(zero_copy_only=False), 0.0)
    flat = column("dense").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != d * table.num_rows:
        raise ValueError("dense features differ in length")
    labels, weights = (column(name).to_numpy(zero_copy_only=False).astype(np.float64) for name in ("label", "weight"))
    return _Shard(labels, weights, flat.reshape(-1, d), np.where(known, at, 0) + 1 + d, amounts, np.concatenate([[0], np.cumsum(counts)]))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each shard of a partition that is sorted by shard."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo < hi:
                if held and held[-1].column(0)[0].as_py() != shard[lo]:
                    yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)


def _factors(n: int, positives: int, config: TrainingConfig) -> tuple[float, float]:
    """What class weighting (from the rows as they are) and oversampling multiply the weights of 0 and 1 by."""
    zeros, zero, one = n - positives, 1.0, 1.0
    if positives and zeros:
        if config.class_weighting:
            zero, one = n / (2 * zeros), n / (2 * positives)
        if config.oversample:
            few = max(positives, zeros) / min(positives, zeros)
            zero, one = (zero, one * few) if positives < zeros else (zero * few, one)
    return zero, one


def shard_moves(
    number: int, train: _Shard, validation: _Shard, w: np.ndarray, squares: np.ndarray, config: TrainingConfig, boot: bool, factors: tuple[float, float], epoch: int, last: bool, batch: int | None, laid: dict | None = None
) -> list[tuple]:
    """(places, first, second) of one configuration in one shard: the losses of the model it starts from and, but for the
    last pass, its moves.  ``laid`` keeps the layouts that configurations of one seed and the same rows share."""
    own = np.random.default_rng([config.seed, number, 1]).poisson(1.0, len(train.labels)) if boot else np.ones(len(train.labels))
    out = []
    for what, rows, weights in ((ON_TRAIN, train, train.weights * own), (ON_VALIDATION, validation, validation.weights)):
        if len(rows.labels):
            p = _sigmoid(_raw(rows, w, slice(None))[0])
            out.append(([what], [float(weights @ _cross_entropy(rows.labels, p))], [float(weights.sum())]))
    n = len(train.labels)
    if last or not n:
        return out
    laid, key, size = {} if laid is None else laid, (config.seed, config.shuffle, boot), batch or n
    if key not in laid:
        order = np.random.default_rng([config.seed + epoch, number]).permutation(n) if config.shuffle else np.arange(n)
        # Without a batch size a shard is one batch of the rows that take part.
        laid[key] = laid_out(train, order[own[order] > 0], size)
    moved, moved_squares = w.copy(), squares.copy()
    weights = train.weights * own * np.where(train.labels == 1, factors[1], factors[0])
    loss, weight = walk(laid[key], weights, moved, moved_squares, config, size)
    at = np.flatnonzero((moved != w) | (moved_squares != squares))
    return [*out, (at, (moved - w)[at] * n, (moved_squares - squares)[at] * n), ([ON_THE_WAY], [loss], [weight])]


def _pass(sharded: DataFrame, models: list[tuple[np.ndarray, np.ndarray]], live: list[int], configs: list[TrainingConfig], boot: list[bool], factors: list[tuple[float, float]], folds: list[int], ids: np.ndarray, d: int, epoch: int, last: bool, batch: int | None) -> DataFrame:
    """(config, place, first, second): moves of weights and squares times rows, and losses with weights."""
    shared = sharded.sparkSession.sparkContext.broadcast((models, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, ids = shared.value
        for number, table in _shards(batches):
            table = table.sort_by("order")
            period, whole = table["period"].to_numpy(), _parsed(table, ids, d)
            sides = {fold: (_part(whole, np.flatnonzero(period < fold)), _part(whole, np.flatnonzero(period == fold))) for fold in {folds[c] for c in live}}
            out, laid = [], {fold: {} for fold in sides}
            for c in live:
                found = shard_moves(number, *sides[folds[c]], *models[c], configs[c], boot[c], factors[c], epoch, last, batch, laid[folds[c]])
                out += [(np.full(len(places), c), places, first, second) for places, first, second in found]
            if out:
                columns = [np.concatenate([np.asarray(o[i]) for o in out]) for i in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["config", "place", "first", "second"])

    return sharded.mapInArrow(run, MOVES).groupBy("config", "place").agg(F.sum("first").alias("first"), F.sum("second").alias("second"))


@dataclass
class Fit:
    model: Model
    history: list[dict]


def narrow(rows: DataFrame, order: str | None) -> DataFrame:
    """What a fit reads of rows with a period (``__period``), written once: every later pass is over this table, not over
    what the rows are made from.  To be dropped after the fit."""
    return scratch.stage(
        rows.select(
            (F.col(order) if order else F.lit(None).cast("string")).alias("order"), F.col("__period").cast("int").alias("period"), F.col("label").cast("double").alias("label"), F.col("sample_weight").cast("double").alias("weight"),
            F.col("dense_features").cast("array<double>").alias("dense"), F.col("sparse_feature_ids").cast("array<bigint>").alias("ids"), F.col("sparse_feature_values").cast("array<double>").alias("values"),
        ),
        "training",
    )


def _checked(table: DataFrame, until: int) -> tuple[dict[int, tuple[int, int]], int]:
    """Rows and positive ones of each period before ``until``, and the number of dense features; none, or vectors that differ
    in length, are errors."""
    size_of = F.size("dense")
    found = table.filter(F.col("period") < until).groupBy("period").agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("ones"), F.max(size_of).alias("most"), F.min(size_of).alias("least")).collect()
    if not found:
        raise ValueError("no training rows")
    d = max(r.most for r in found)
    if d != min(r.least for r in found):
        raise ValueError("dense features differ in length")
    return {r.period: (r.n, int(r.ones)) for r in found}, d


def sharded_rows(table: DataFrame, shards: int) -> DataFrame:
    """Rows of ``narrow`` with their shard, a partition for each shard, so that a task holds one shard whatever their number;
    ``order`` should tell rows apart, as equal ones share a shard."""
    shard = F.pmod(F.xxhash64("order"), F.lit(shards)).cast("int")
    return table.select(shard.alias("shard"), *table.columns).repartitionById(shards, "shard")


def by_split(rows: DataFrame) -> DataFrame:
    """Training rows are of period 0 and validation rows of period 1."""
    return rows.filter("split in ('train', 'validation')").withColumn("__period", F.when(F.col("split") == "train", 0).otherwise(1))


def _part(shard: _Shard, rows: np.ndarray) -> _Shard:
    """Some rows of a shard."""
    counts = np.diff(shard.starts)[rows]
    starts = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(shard.starts[:-1][rows] - starts[:-1], counts) + np.arange(starts[-1])
    return _Shard(shard.labels[rows], shard.weights[rows], shard.dense[rows], shard.places[at], shard.values[at], starts)


def fit_all(
    rows: DataFrame,
    configs: dict[str, TrainingConfig],
    bootstrap: Sequence[str] = (),
    order: str = "training_row_id",
    shard_rows: int = SHARD_ROWS,
    batch_rows: int | None = BATCH_ROWS,
) -> dict[str, Fit]:
    """Every configuration fitted on ``split`` train and stopped by ``split`` validation, in one pass an epoch.

    The model is that of the epoch with the least validation loss (the last epoch without validation
    rows).  ``history`` has the weighted train loss on the way and the log losses of the epoch's model.
    Configurations named in ``bootstrap`` weigh each training row by a Poisson draw, by their seed.
    ``batch_rows`` None takes a shard as one batch."""
    return _fit(by_split(rows), configs, dict.fromkeys(configs, 1), bootstrap, order, shard_rows, batch_rows)


def fit_folds(
    rows: DataFrame, config: TrainingConfig, origins: Sequence, at: str = "event_ts", order: str = "training_row_id", shard_rows: int = SHARD_ROWS, batch_rows: int | None = BATCH_ROWS
) -> dict[int, Fit]:
    """Time-aware validation with rolling origins: for each origin (ascending times) a model that has learnt from the rows before
    it and is stopped by those up to the next origin, all fitted in the same passes.

    Rows from the last origin on are the last fold's validation rows; rows without a time take no part."""
    if list(origins) != sorted(set(origins)) or not len(origins):
        raise ValueError("origins must ascend")
    period = sum(((F.col(at) >= F.lit(o)).cast("int") for o in origins), F.lit(0))
    folds = {k + 1: k + 1 for k in range(len(origins))}
    return _fit(rows.filter(F.col(at).isNotNull()).withColumn("__period", period), dict.fromkeys(folds, config), folds, (), order, shard_rows, batch_rows)


def _fit(rows: DataFrame, configs: dict, folds: dict, bootstrap: Sequence[str], order: str, shard_rows: int, batch_rows: int | None) -> dict:
    """A configuration learns from the rows of periods below its fold and is stopped by those of its fold."""
    rows = rows.filter(F.col("__period") <= max(folds.values()))
    names, table, sharded = list(configs), None, None
    try:
        table = narrow(rows, order)
        periods, d = _checked(table, max(folds.values()))
        counts, ones = ([sum(pair[i] for period, pair in periods.items() if period < folds[name]) for name in names] for i in (0, 1))
        if not all(counts):
            raise ValueError("no training rows")
        distinct = table.filter(F.col("period") < max(folds.values())).select(F.explode("ids").alias("id")).distinct()
        found = [r.id for r in distinct.limit(MOST_FEATURES + 1).collect()]
        if len(found) > MOST_FEATURES:
            raise ValueError(f"more than {MOST_FEATURES} distinct sparse ids; fit_table holds any number")
        ids = np.array(sorted(found), np.int64)
        sharded = sharded_rows(table, max(1, -(-max(counts) // shard_rows))).persist(StorageLevel.DISK_ONLY)
        return _fitted(sharded, configs, folds, bootstrap, batch_rows, counts, ones, ids, d)
    finally:
        if sharded is not None:
            sharded.unpersist()
        if table is not None:
            scratch.drop_table(table)


def _fitted(sharded: DataFrame, configs: dict, folds: dict, bootstrap: Sequence[str], batch_rows: int | None, counts: list[int], ones: list[int], ids: np.ndarray, d: int) -> dict:
    """The epochs, over rows that are dealt into shards."""
    names, settings = list(configs), list(configs.values())
    size, boot = 1 + d + max(1, len(ids)), [name in set(bootstrap) for name in names]
    factors = [_factors(n, int(k), c) for n, k, c in zip(counts, ones, settings, strict=True)]
    models = [(np.zeros(size), np.zeros(size)) for _ in settings]
    best: list[tuple[float, int, np.ndarray]] = [(math.inf, 0, m[0]) for m in models]
    waited, histories, live = [0] * len(settings), [[] for _ in settings], list(range(len(settings)))
    for epoch in range(1, max(c.max_epochs for c in settings) + 2):
        going = [c for c in live if len(histories[c]) == epoch - 1]
        last = all(settings[c].max_epochs < epoch for c in going)
        result = {(r.config, r.place): (r.first, r.second) for r in _pass(sharded, models, going, settings, boot, factors, [folds[name] for name in names], ids, d, epoch, last, batch_rows).collect()} if going else {}
        share = lambda pair: pair[0] / pair[1] if pair and pair[1] else 0.0
        for c in going:
            config = settings[c]
            if epoch > 1:
                # The losses of the model that this pass started from: that of the epoch before.
                seen, entry = result.get((c, ON_VALIDATION)), histories[c][-1]
                entry["train_log_loss"] = share(result.get((c, ON_TRAIN)))
                if seen:
                    entry["validation_log_loss"] = share(seen)
                    if share(seen) < best[c][0]:
                        best[c], waited[c] = (share(seen), epoch - 1, models[c][0]), 0
                    else:
                        waited[c] += 1
                else:
                    best[c] = (math.inf, epoch - 1, models[c][0])
            if epoch > config.max_epochs or (config.patience and waited[c] >= config.patience):
                live.remove(c)
                continue
            w, squares = models[c][0].copy(), models[c][1].copy()
            moves = [(place, *pair) for (k, place), pair in result.items() if k == c and place >= 0]
            if moves:
                at, first, second = (np.array(column) for column in zip(*moves, strict=True))
                w[at] += first / counts[c]
                squares[at] += second / counts[c]
            models[c] = (w, squares)
            histories[c].append({"epoch": epoch, "train_loss": share(result.get((c, ON_THE_WAY)))})
        if not live:
            break
    fits = {}
    for name, (_, epoch, w), history in zip(names, best, histories, strict=True):
        sparse = {int(i): float(x) for i, x in zip(ids, w[1 + d :], strict=False) if x}
        fits[name] = Fit(Model(float(w[0]), w[1 : 1 + d].tolist(), sparse, best_epoch=epoch), history)
    return fits


RUN = "config string, model string, history string"


def train_all(rows: DataFrame, configs: dict[str, TrainingConfig], bootstrap: Sequence[str] = (), order: str = "training_row_id", **sizes) -> DataFrame:
    """(config, model, history) of ``fit_all``, as JSON: one row a configuration."""
    fits = fit_all(rows, configs, bootstrap, order, **sizes)
    return rows.sparkSession.createDataFrame([(name, f.model.to_json(), json.dumps(f.history)) for name, f in fits.items()], RUN)


def train(rows: DataFrame, config: TrainingConfig = TrainingConfig(), order: str = "training_row_id", **stamps) -> tuple[Model, list[dict]]:
    found = fit_all(rows, {"only": config}, order=order)["only"]
    return replace(found.model, **stamps), found.history


def suite(config: TrainingConfig = TrainingConfig()) -> dict[str, TrainingConfig]:
    """Baseline and ablations."""
    return {
        "baseline": config,
        "mse_loss": replace(config, loss="mse"),
        "oversampling": replace(config, oversample=True, class_weighting=False),
        "no_class_weighting": replace(config, class_weighting=False),
        "no_l2": replace(config, l2=0.0),
    }


def stability(runs: DataFrame, dense_names: Sequence[str], top: int = 20) -> DataFrame:
    """(kind, feature, mean, stdev, runs): weights over bootstrap runs, for any number of dense
    features; sparse ones over the runs in which they occur, the largest by mean."""
    parsed = runs.select(F.from_json("model", "dense array<double>, sparse map<string,double>").alias("m"))
    names = F.array(*map(F.lit, dense_names))
    dense = parsed.select(F.posexplode("m.dense").alias("i", "w")).select(F.lit("dense").alias("kind"), F.coalesce(F.get(names, "i"), F.concat(F.lit("dense_feature_"), F.col("i").cast("string"))).alias("feature"), "w")
    sparse = parsed.select(F.explode("m.sparse").alias("feature", "w")).select(F.lit("sparse").alias("kind"), "feature", "w")
    summed = lambda d: d.groupBy("kind", "feature").agg(F.avg("w").alias("mean"), F.coalesce(F.stddev_samp("w"), F.lit(0.0)).alias("stdev"), F.count("*").alias("runs"))
    return summed(dense).unionByName(summed(sparse).orderBy(F.abs("mean").desc(), "feature").limit(top))


def train_distributed(rows: DataFrame, config: TrainingConfig = TrainingConfig(), hash_dimension: int = 1024, max_iterations: int = 50) -> Model:
    """The same model over the whole cluster.  Penalties apply to all weights alike; sparse ids are
    taken modulo ``hash_dimension``, which bounds the size of the model."""
    table = narrow(rows.filter("split = 'train'").withColumn("__period", F.lit(0)), None)
    try:
        return _minimised(table, config, hash_dimension, max_iterations)
    finally:
        scratch.drop_table(table)


def _minimised(table: DataFrame, config: TrainingConfig, hash_dimension: int, max_iterations: int) -> Model:
    """``train_distributed`` on training rows that are written."""
    _, d = _checked(table, 1)
    weights = class_weights(table).first() if config.class_weighting else None
    share = F.when(F.col("label") == 1, weights.weight_positive).otherwise(weights.weight_negative) if weights else F.lit(1.0)
    size = d + hash_dimension

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dense, ids, values = (batch.column(c) for c in (2, 3, 4))
            flat = dense.flatten().to_numpy().reshape(-1, d)
            n, counts = len(flat), ids.value_lengths().to_numpy()
            # Dense and hashed places of each row, in order and added up where they meet.
            place = np.concatenate([np.add.outer(np.arange(n) * size, np.arange(d)).ravel(), np.repeat(np.arange(n) * size + d, counts) + ids.flatten().to_numpy() % max(1, hash_dimension)])
            amount = np.concatenate([flat.ravel(), values.flatten().to_numpy()])
            if not hash_dimension:
                place, amount = place[: n * d], amount[: n * d]
            at, which = np.unique(place, return_inverse=True)
            offsets = pa.array(np.searchsorted(at, np.arange(n + 1) * size).astype(np.int32))
            parts = [
                pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), pa.ListArray.from_arrays(offsets, pa.array((at % size).astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(np.bincount(which, amount, len(at)))),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])], ["label", "w", "features"])

    weighed = table.select("label", (F.col("weight") * share).alias("w"), "dense", "ids", "values")
    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("w", T.DoubleType()), T.StructField("features", VectorUDT())])
    vectors = weighed.mapInArrow(vectors, schema)
    penalty = config.l1 + config.l2
    fitted = LogisticRegression(weightCol="w", maxIter=max_iterations, regParam=penalty, elasticNetParam=config.l1 / penalty if penalty else 0.0, standardization=False).fit(vectors)
    w = [float(x) for x in fitted.coefficients.toArray()]
    return Model(float(fitted.intercept), w[:d], {i: x for i, x in enumerate(w[d:]) if x})


def score_column(model: Model, names: Sequence[str]) -> Column:
    """Linear score of a model without sparse weights, over one column for each dense feature."""
    total = F.lit(model.bias)
    for name, weight in zip(names, model.dense, strict=True):
        total = total + F.col(name) * F.lit(float(weight))
    return total
