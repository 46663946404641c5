"""Toxic spans by a linear-chain conditional random field.

1. Token labels.  Labels come per document, so words and stems (first four letters) are weighed
   first: their document frequencies in toxic and in clean learning documents (distinct texts)
   are counted in Spark, and those whose smoothed log ratio is large and sure are toxic.  A token
   of a toxic learning document is labelled 1 if its word or stem is; all other tokens are 0.
2. The field.  Two labels; features of a token are its word, affixes and neighbours, hashed into
   ``1 << BITS`` weights, and there are weights for label pairs.  It is fitted by AdaGrad on the
   exact gradient, from forward-backward marginals, on a bounded sample of labelled documents.
3. Documents.  Marginals over the whole text are summed and the two largest taken; a logistic
   regression on these, weighted to the true share of toxic documents, gives the
   score.  Runs of tokens with a marginal of at least one half are the offending spans.

Forward and backward passes are scans of linear-fractional maps: a document's first (last)
token has a constant map, so a whole batch is one sequence and is scanned in square-root many
vector steps.

Edge cases: a null or empty text is scored as a text without tokens; without toxic or without
clean learning documents every score is 0; documents whose label or id is null are not learnt
from; rows of equal text and label count once for the words; a text with both labels counts for
either; repeated rows are each answered; very long texts are worked on whole; an empty table gives an
empty result; other columns are not read.  Offsets are code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _scratch
from ._chars import blocks, folded, run_hashes, runs, tables

BITS = 18
#: Documents of each label on which the field is fitted (those with the smallest hashes).
FIT_ROWS = 400
#: A toxic word or stem: in at least this share of toxic texts, and with at least this log ratio and z value.
LEAST_SHARE, LEAST_RATIO, LEAST_Z = 0.01, 3.0, 2.5
#: Marginals below this are left out of a document's sum, which would else follow its length.
PLAINLY_CLEAN = 0.1


@dataclass
class Tokens:
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    stems: np.ndarray
    features: np.ndarray
    first: np.ndarray
    of: np.ndarray


@dataclass
class Field:
    weights: np.ndarray
    pairs: np.ndarray
    intercept: float
    slopes: np.ndarray


def tokenize(codes: np.ndarray, starts: np.ndarray) -> Tokens:
    """Runs of letters of a block of texts: offsets in the text, word hashes, feature buckets, and
    the text and whether it is the text's first token."""
    inside = tables()[0][codes]
    lo, hi = runs(inside)
    of = np.searchsorted(starts, lo, side="right") - 1
    if not len(lo):
        none = np.zeros(0, np.uint64)
        return Tokens(lo, hi, none, none, np.zeros((6, 0), np.int64), np.zeros(0, bool), of)
    char = folded(codes)
    words = run_hashes(char, inside, lo, hi)
    first = np.concatenate([[True], of[1:] != of[:-1]])
    last = np.concatenate([first[1:], [True]])
    stems = sum(np.where(lo + k < hi, char[np.minimum(lo + k, hi - 1)], np.uint64(0)) * np.uint64(2 * k + 3) ** np.uint64(7) for k in range(4))
    stems ^= stems >> np.uint64(33)
    suffix = char[hi - 1] * np.uint64(11) + char[np.maximum(hi - 2, lo)] * np.uint64(13) + char[np.maximum(hi - 3, lo)] * np.uint64(17)
    before = np.where(first, np.uint64(1), np.roll(words, 1))
    after = np.where(last, np.uint64(2), np.roll(words, -1))
    raw = np.stack([np.zeros_like(words), words, stems, suffix, before, after])
    raw += np.arange(len(raw), dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)
    features = (raw * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(64 - BITS)).astype(np.int64)
    return Tokens(lo - starts[of], hi - starts[of], words, stems, features, first, of)


def scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """x[t] = (a[t] x[t-1] + b[t]) / (c[t] x[t-1] + d[t]), where the first map is constant."""
    n = len(a)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    pad = lambda v, fill: np.concatenate([v, np.full(rows * width - n, fill)]).reshape(rows, width).T.copy()
    a, b, c, d = pad(a, 1.0), pad(b, 0.0), pad(c, 0.0), pad(d, 1.0)
    p, q, r, s = a[0], b[0], c[0], d[0]
    for t in range(1, width):
        p, q, r, s = a[t] * p + b[t] * r, a[t] * q + b[t] * s, c[t] * p + d[t] * r, c[t] * q + d[t] * s
        size = np.maximum(np.maximum(np.abs(p), np.abs(q)), np.maximum(np.abs(r), np.abs(s)))
        p, q, r, s = p / size, q / size, r / size, s / size
    enter, x = np.zeros(rows), 0.0
    for k, (pk, qk, rk, sk) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        enter[k] = x
        x = (pk * x + qk) / (rk * x + sk)
    out, x = np.empty((width, rows)), enter
    for t in range(width):
        x = (a[t] * x + b[t]) / (c[t] * x + d[t])
        out[t] = x
    return out.T.ravel()[:n]


def marginals(energy: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(label 1) of each token, and the forward and backward ratios it is made of."""
    w, m = np.exp(np.clip(energy, -30, 30)), np.exp(pairs)
    one, zero = np.ones_like(w), np.zeros_like(w)
    last = np.concatenate([first[1:], [True]])
    forward = scan(np.where(first, zero, w * m[1, 1]), np.where(first, w, w * m[0, 1]), np.where(first, zero, m[1, 0]), np.where(first, one, m[0, 0]))
    follow = np.concatenate([w[1:], [1.0]])
    turn = lambda v: v[::-1]
    backward = turn(
        scan(turn(np.where(last, zero, follow * m[1, 1])), turn(np.where(last, one, m[1, 0])), turn(np.where(last, zero, follow * m[0, 1])), turn(np.where(last, one, m[0, 0])))
    )
    odds = forward * backward
    return odds / (1.0 + odds), forward, backward


def likelihood_gradient(tokens: Tokens, labels: np.ndarray, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the mean log likelihood a token, for the weights and the label-pair weights."""
    inner = np.flatnonzero(~tokens.first)
    real = np.bincount(labels[inner - 1] * 2 + labels[inner], minlength=4).reshape(2, 2)
    energy = weights[tokens.features].sum(axis=0)
    p, forward, backward = marginals(energy, tokens.first, pairs)
    gradient = sum(np.bincount(f, labels - p, len(weights)) for f in tokens.features)
    w, m = np.exp(np.clip(energy[inner], -30, 30)), np.exp(pairs)
    r, b = forward[inner - 1], backward[inner] * w
    joint = np.stack([m[0, 0] * np.ones_like(r), m[0, 1] * b, m[1, 0] * r, m[1, 1] * r * b])
    expected = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
    return gradient / len(p), (real - expected) / len(p)


def fit_field(tokens: Tokens, labels: np.ndarray, rounds: int = 60, rate: float = 0.5, l2: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Weights and label-pair weights by AdaGrad on the full gradient of the log likelihood."""
    weights, pairs = np.zeros(1 << BITS), np.zeros((2, 2))
    seen, seen_pairs = np.full(1 << BITS, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds):
        gradient, step = likelihood_gradient(tokens, labels, weights, pairs)
        gradient -= l2 * weights
        seen += gradient**2
        weights += rate * gradient / np.sqrt(seen)
        seen_pairs += step**2
        pairs += 0.2 * rate * step / np.sqrt(seen_pairs)
    return weights, pairs


def _summaries(tokens: Tokens, p: np.ndarray, docs: int) -> np.ndarray:
    """Columns: log of one plus the expected number of toxic tokens, over those that are not plainly
    clean; the largest marginal; the second largest."""
    at = np.flatnonzero(p >= PLAINLY_CLEAN)
    of, p = tokens.of[at], p[at]
    total, most, second = np.bincount(of, p, docs), np.zeros(docs), np.zeros(docs)
    order = np.lexsort((-p, of))
    place = np.arange(len(order)) - np.searchsorted(of[order], of[order])
    most[of[order[place == 0]]] = p[order[place == 0]]
    second[of[order[place == 1]]] = p[order[place == 1]]
    return np.stack([np.log1p(total), most, second], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, ridge = np.zeros(x.shape[1]), np.diag([l2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
    return beta


def _word_counts(texts: DataFrame) -> DataFrame:
    """(unit, toxic, clean): documents of either label that hold the word or stem (by its hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for rows, codes, starts in blocks(batch.column(0), 1):
                tokens = tokenize(codes, starts)
                for units in (tokens.words, tokens.stems):
                    _, once = np.unique(units + tokens.of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
                    unit, at = np.unique(units[once].view(np.int64), return_inverse=True)
                    hit = toxic[rows][tokens.of[once]]
                    a, b = np.bincount(at, hit, len(unit)).astype(np.int64), np.bincount(at, ~hit, len(unit)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(a), pa.array(b)], ["unit", "toxic", "clean"])

    return texts.mapInArrow(run, "unit long, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Field | None:
    """Learn from documents with a label of 0 or 1; None if one of the labels is missing."""
    with _scratch.temporary(labelled.sparkSession):
        return _fit(labelled, id_col, text_col, label_col, fit_rows)


def _fit(labelled: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> Field | None:
    rows = labelled.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.col(label_col) == 1).alias("toxic")
    )
    # Written once, as everything below reads it; digest and number beside the text spare reading texts.
    rows = _scratch.stage(rows.withColumns({"h": F.xxhash64("text"), "number": F.monotonically_increasing_id()}), "labelled")
    totals = dict(rows.groupBy("toxic").count().collect())
    if len(totals) < 2:
        return None
    # Copies of a text would make all its words look toxic: each text counts once, by the row with the
    # smallest number.  Numbers are distinct, so no copy's key gathers rows.
    firsts = rows.groupBy("h", "toxic").agg(F.min("number").alias("number"))
    texts = dict(firsts.groupBy("toxic").count().collect())
    once = rows.join(firsts.select("number").hint("merge"), "number", "left_semi").select("text", "toxic")
    n1, n0 = texts[True] + 1.0, texts[False] + 1.0
    ratio = F.log((F.col("toxic") + 0.5) / n1) - F.log((F.col("clean") + 0.5) / n0)
    z = ratio / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    chosen = _word_counts(once).filter((F.col("toxic") >= max(3.0, LEAST_SHARE * n1)) & (ratio >= LEAST_RATIO) & (z >= LEAST_Z))
    # A unit that is in a share of the toxic texts: there are at most (units of a text / share) of them.
    units = np.array([r.unit for r in chosen.select("unit").collect()], np.int64).view(np.uint64)
    sample = [r for toxic in (True, False) for r in _scratch.hashed_sample(rows.filter(F.col("toxic") == toxic), fit_rows, "id", "h").collect()]
    toxic = np.array([r.toxic for r in sample])
    parts, offset = [], 0
    for kept, codes, starts in blocks(pa.array([r.text for r in sample]), 1):
        tokens = tokenize(codes, starts)
        tokens.of = tokens.of + kept.start
        parts.append(tokens)
    tokens = Tokens(*(np.concatenate([getattr(t, f) for t in parts], axis=-1) for f in Tokens.__dataclass_fields__))
    if not len(tokens.words):
        return None
    labels = ((np.isin(tokens.words, units) | np.isin(tokens.stems, units)) & toxic[tokens.of]).astype(np.int64)
    weights, pairs = fit_field(tokens, labels)
    p, _, _ = marginals(weights[tokens.features].sum(axis=0), tokens.first, pairs)
    share = {label: totals[label] / max(1, int((toxic == label).sum())) for label in (True, False)}
    weight = np.where(toxic, share[True], share[False])
    beta = _logistic(_summaries(tokens, p, len(sample)), toxic.astype(float), weight / weight.mean())
    return Field(weights, pairs, float(beta[-1]), beta[:-1])


def score(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, expected, spans): spans as start:end, comma-joined, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            scores, expected, spans = np.zeros(batch.num_rows), np.zeros(batch.num_rows), np.full(batch.num_rows, "", object)
            for rows, codes, starts in blocks(batch.column(1), 1) if field else ():
                tokens = tokenize(codes, starts)
                summary = np.zeros((len(starts), 3))
                if len(tokens.words):
                    p, _, _ = marginals(field.weights[tokens.features].sum(axis=0), tokens.first, field.pairs)
                    summary = _summaries(tokens, p, len(starts))
                    for row, found in _spans(tokens, p >= 0.5):
                        spans[rows.start + row] = found
                scores[rows] = 1 / (1 + np.exp(-np.clip(summary @ field.slopes + field.intercept, -30, 30)))
                expected[rows] = np.expm1(summary[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(expected), pa.array(spans, pa.string())], ["id", "score", "expected", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double, expected double, spans string")


def _spans(tokens: Tokens, hit: np.ndarray) -> Iterator[tuple[int, str]]:
    at = np.flatnonzero(hit)
    if not len(at):
        return
    opens = np.concatenate([[True], (np.diff(at) != 1) | tokens.first[at[1:]]])
    closes = np.concatenate([opens[1:], [True]])
    of, lo, hi = tokens.of[at[opens]], tokens.starts[at[opens]], tokens.ends[at[closes]]
    cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    for i, j in zip(cut, [*cut[1:], len(of)], strict=True):
        yield int(of[i]), ",".join(f"{a}:{b}" for a, b in zip(lo[i:j], hi[i:j], strict=True))


def toxicity(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, fit_rows: int = FIT_ROWS
) -> DataFrame:
    """(doc_id, score, predicted, expected, spans) of every document, learnt from rows where ``learn`` holds."""
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    chosen = docs.select(F.col(id_col), F.col(text_col)).filter(learn)
    # A merge join at every size: texts move once, in proportion to the input.
    labelled = chosen.join(marked.hint("merge"), chosen[id_col] == marked["__id"]).select(id_col, text_col, F.col("__label").alias(label_col))
    field = fit(labelled, id_col, text_col, label_col, fit_rows)
    return score(docs, field, id_col, text_col).select(
        F.col("id").alias("doc_id"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "expected", "spans"
    )
