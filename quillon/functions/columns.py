"""Column expressions shared by all jobs: numbers, features, scores, identities and time."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CATEGORICAL, MISSING, POLICIES, FeatureConfig

TINY = 1e-15


# Numbers
def safe_rate(part: Column, whole: Column) -> Column:
    """part / whole; 0 where the whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def sigmoid(x: Column) -> Column:
    """In the form that cannot overflow for either sign."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def clipped(p: Column) -> Column:
    return F.greatest(F.lit(TINY), F.least(F.lit(1 - TINY), p))


def logit(p: Column) -> Column:
    return F.log(clipped(p)) - F.log(1 - clipped(p))


def cross_entropy(label: Column, p: Column) -> Column:
    return -(label * F.log(clipped(p)) + (1 - label) * F.log(1 - clipped(p)))


def uncertainty(p: Column) -> Column:
    return 1 - F.abs(2 * p - 1)


# Display
MISSING_TEXT = "—"


def _shown(value: Column, pattern: str, number: Column) -> Column:
    """Text that is no number stands as it is."""
    return F.when(value.isNull(), MISSING_TEXT).when(number.isNull(), value.cast("string")).otherwise(F.format_string(pattern, number))


def show_float(value: Column) -> Column:
    """Four decimals."""
    return _shown(value, "%.4f", value.cast("string").try_cast("double"))


def show_int(value: Column) -> Column:
    """Whole thousands apart, fractions cut off."""
    number = value.cast("string").try_cast("double")
    return _shown(value, "%,d", F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)))


def show_percent(value: Column) -> Column:
    """One decimal of a percentage."""
    return _shown(value, "%.1f%%", value.cast("string").try_cast("double") * 100)


# Features
def dense_value(name: str, raw: Column, config: FeatureConfig) -> Column:
    """A numeric string as a model input; null is 0 and text that is no number is an error.

    ``balance`` is always a signed logarithm; a negative count of days or seconds is 0."""
    x = raw.cast("double")
    if name == "balance":
        value = signed_log1p(x)
    else:
        x = F.greatest(x, F.lit(0.0)) if name in ("pdays", "duration") else x
        value = F.when(x <= -1, F.raise_error(F.concat(F.lit(f"{name} must exceed -1: "), raw.cast("string")))).otherwise(F.log1p(x)) if config.dense_log_transform else x
    return F.when(raw.isNull(), F.lit(0.0)).otherwise(value)


def prior_contact(pdays: Column) -> Column:
    return F.when(pdays.cast("double") >= 0, 1.0).otherwise(0.0)


def dense_columns(config: FeatureConfig) -> list[Column]:
    """One column for each dense feature, in order, over columns of the raw names."""
    return [(prior_contact(F.col("pdays")) if n == "prior_contact_flag" else dense_value(n, F.col(n), config)).alias(n) for n in config.dense_names]


def dense_vector(config: FeatureConfig) -> Column:
    return F.array(*dense_columns(config))


def sparse_tokens(config: FeatureConfig, names: Sequence[str] = CATEGORICAL) -> Column:
    """``name=value`` for each categorical; a null is a value of its own or leaves its slot out."""
    if config.include_missing:
        return F.array(*(F.concat(F.lit(f"{n}="), F.coalesce(F.col(n), F.lit(MISSING))) for n in names))
    return F.array_compact(F.array(*(F.concat(F.lit(f"{n}="), F.col(n)) for n in names)))


@lru_cache(maxsize=1 << 18)
def hash_token(token: str, dimension: int) -> int:
    """64-bit BLAKE2b of the token, as a big-endian unsigned number, modulo the dimension."""
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big") % dimension


def hashed_tokens(tokens: Column, dimension: int) -> Column:
    """Feature ids of an array of tokens.  Spark has no BLAKE2b; each Arrow batch is reduced to its distinct
    tokens, only these are hashed, and the ids are taken by their places."""
    if dimension <= 0:
        raise ValueError("dimension must be positive")

    @F.arrow_udf("array<long>")
    def ids(batch: pa.Array) -> pa.Array:
        found = batch.flatten().dictionary_encode()
        hashed = pa.array([None if t is None else hash_token(t, dimension) for t in found.dictionary.to_pylist()], pa.int64())
        sizes = pa.compute.fill_null(pa.compute.list_value_length(batch), 0).to_numpy()
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        flat = hashed.take(found.indices)
        return pa.ListArray.from_arrays(offsets, flat, mask=batch.is_null())

    return ids(tokens)


def compressed_pairs(ids: Column, values: Column) -> Column:
    """Array of (id, value) with values of equal ids added up, in order of first appearance."""
    pairs = F.when(F.size(ids) != F.size(values), F.raise_error(F.lit("ids and values differ in length"))).otherwise(F.arrays_zip(ids.alias("id"), values.alias("value")))
    return F.transform(
        F.array_distinct(F.transform(pairs, lambda p: p["id"])),
        lambda i: F.struct(i.alias("id"), F.aggregate(F.filter(pairs, lambda p: p["id"] == i), F.lit(0.0), lambda a, p: a + p["value"]).alias("value")),
    )


def sparse_bucket(feature_id: Column, buckets: int = 32) -> Column:
    return feature_id % buckets


def dot(values: Sequence[Column], weights: Sequence[float]) -> Column:
    """Sum of products over a fixed list of columns, which stays in generated code."""
    total = F.lit(0.0)
    for value, weight in zip(values, weights, strict=True):
        total = total + value * F.lit(float(weight))
    return total


#: Thresholds up to which a lookup compares with all of them; beyond, it halves the range.
FEW_THRESHOLDS = 32


def _constant(values: Sequence[float]) -> Column:
    """An array that the optimizer folds into one literal, whatever its length."""
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>")


def step_lookup(score: Column, thresholds: Sequence[float], values: Sequence[float]) -> Column:
    """Value of the first threshold that is not below the score (the last one above all); 0.5 without
    any threshold.  A null score has no value, whatever the number of thresholds."""
    if not thresholds:
        return F.when(score.isNotNull(), 0.5)
    steps, last = _constant(thresholds), len(thresholds) - 1
    if len(thresholds) <= FEW_THRESHOLDS:
        below = F.size(F.filter(steps, lambda t: t < score))
        return F.when(score.isNotNull(), F.element_at(_constant(values), F.least(below, F.lit(last)) + 1))
    # Binary search: (lo, hi) encloses the place of the first threshold that is not below, or the last.
    start = F.struct(F.lit(0).alias("lo"), F.lit(last).alias("hi"))

    def halve(range_, _):
        middle = F.floor((range_["lo"] + range_["hi"]) / 2).cast("int")
        below = F.get(steps, middle) < score
        return F.struct(F.when(below, F.least(middle + 1, range_["hi"])).otherwise(range_["lo"]).alias("lo"), F.when(below, range_["hi"]).otherwise(middle).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(last.bit_length() + 1)), start, halve)
    return F.when(score.isNotNull(), F.get(_constant(values), found["lo"]))


# Decisions
def route(p: Column, context: str) -> Column:
    """(action, reason, threshold, review, policy_version) of a probability in a context."""
    if context not in POLICIES:
        raise ValueError(f"unknown context {context}")
    policy, out = POLICIES[context], None
    row = lambda b: F.struct(
        F.lit(b.action).alias("action"), F.lit(b.reason).alias("reason"), F.lit(b.threshold).alias("threshold"), F.lit(b.review).alias("review"), F.lit(policy.version).alias("policy_version")
    )
    for band in policy.bands:
        if band.below is None:
            return out.otherwise(row(band)) if out is not None else row(band)
        out = (F.when if out is None else out.when)(p < band.below, row(band))
    return out


def routed(p: Column, context: Column) -> Column:
    """``route`` by a context column; an unknown context is an error."""
    out = None
    for name in POLICIES:
        out = (F.when if out is None else out.when)(context == name, route(p, name))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown context "), F.coalesce(context, F.lit("null")))))


def is_positive_action(action: Column, context: Column) -> Column:
    pair = F.concat_ws("|", F.lower(F.trim(context)), F.lower(F.trim(action)))
    return pair.isin([f"{name}|{policy.positive_action}" for name, policy in POLICIES.items()])


# Identities, time, splits
def numbered(prefix: str, row_id: Column, width: int = 12) -> Column:
    return F.format_string(f"{prefix}_%0{width}d", row_id.cast("long"))


def event_time(row_id: Column, start: str, seconds: int) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + row_id * seconds)


def iso_utc(ts: Column) -> Column:
    """ISO text in UTC (the session's zone), with a fraction only where there is one."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(ts, "SSSSSS") == "000000", "").otherwise(F.concat(F.lit("."), F.date_format(ts, "SSSSSS"))), F.lit("Z"))


def stable_fraction(text: Column) -> Column:
    """Polynomial of the characters' code points modulo 10,000, as a fraction."""
    step = lambda h, c: (h * 131 + F.ascii(c)) % 10_000
    return F.aggregate(F.split(text, ""), F.lit(0), step) / 10_000


def split_of(fraction: Column, train: float, validation: float) -> Column:
    # Inside ``transform`` the fraction is computed once, not for each branch.
    return F.transform(F.array(fraction), lambda f: F.when(f < train, "train").when(f < train + validation, "validation").otherwise("test"))[0]


def contiguous_split(row_id: Column, total: Column, train: float, validation: float) -> Column:
    share = (row_id + 1) / total
    return F.when(share < train, "train").when(share < train + validation, "validation").otherwise("test")
