"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a space, and n-grams of 1 to ``orders``
characters are hashed into ``1 << BITS`` buckets.  Document frequencies are counted in Spark over
all learning documents.  A document's features are term frequency times inverse document
frequency, divided by their sum, so its score needs sums over its n-grams only.

Weights are fitted by follow-the-regularised-leader (proximal, per-coordinate rates) with both
penalties, on a sample of about ``FIT_ROWS`` learning documents: of each language the same number
(``LEAST_ROWS`` at least, or all it has), those with the smallest hashes, weighed back to its true
share.  A fifth of each language's sample is held back to fit the temperature that calibrates the
probabilities; languages of fewer than five documents are learnt from whole.

Edge cases: a text that is null or has no letter is ``und`` with score 0; rows with a null
language or id are never learnt from; without learning documents every text is ``und``; with one
learning document its language is every text's; equal scores go to the first language by code
point; repeated rows are each answered and count each; very long texts are worked on whole; an empty
table gives an empty result; other columns are not read and pass through, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._chars import SPACE, blocks, tables

BITS = 18
FIT_ROWS, LEAST_ROWS = 3_000, 50
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    orders: int
    scale: float


def _buckets(codes: np.ndarray, orders: int) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram at every position."""
    letter, lower, _ = tables()
    folded = np.where(letter[codes], lower[codes], np.uint32(SPACE))
    padded = np.concatenate([folded, np.full(orders, SPACE, np.uint32)])
    rolling = np.zeros(len(codes), np.uint32)
    for n in range(orders):
        rolling = rolling * np.uint32(0x01000193) + padded[n : n + len(codes)] + np.uint32(n + 1)
        mixed = rolling * np.uint32(0x9E3779B1)
        yield (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS)


def _document_frequencies(texts: DataFrame, orders: int) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, mark = np.zeros(1 << BITS, np.int64), 0, np.zeros(1 << BITS, bool)
        for batch in batches:
            docs += batch.num_rows
            for _, codes, starts in blocks(batch.column(0), orders):
                found = list(_buckets(codes, orders))
                for lo, hi in zip(starts, [*starts[1:], len(codes)], strict=True):
                    for of_order in found:
                        mark[of_order[lo:hi]] = True
                    at = np.flatnonzero(mark)
                    counts[at] += 1
                    mark[at] = False
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], docs))], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    # At most one row for each of the buckets, whatever the size of the input.
    table = rows.toPandas()
    at, n = table["bucket"].to_numpy(np.int64), table["n"].to_numpy(np.int64)
    counts = np.zeros(1 << BITS, np.int64)
    counts[at[at >= 0]] = n[at >= 0]
    return counts, int(n[at < 0].sum())


def _features(text: str, idf: np.ndarray, orders: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    _, codes, _ = next(blocks(pa.array([text]), orders))
    at, n = np.unique(np.concatenate(list(_buckets(codes, orders))), return_counts=True)
    value = n * idf[at]
    return at.astype(np.int32), (scale * value / value.sum()).astype(np.float32)


def _softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int, float]], classes: int, rate: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias (the bias is not penalised) from rows of (buckets, values, class, weight)."""
    size = (1 << BITS) + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    penalty1, penalty2 = np.full((size, 1), l1), np.full((size, 1), l2)
    penalty1[-1] = penalty2[-1] = 0.0

    def weights(at):
        return np.where(np.abs(z[at]) <= penalty1[at], 0.0, -(z[at] - np.sign(z[at]) * penalty1[at]) / ((beta + np.sqrt(n[at])) / rate + penalty2[at]))

    for _ in range(epochs):
        for at, value, label, weight in rows:
            at, value = np.append(at, size - 1), np.append(value, 1.0)
            w = weights(at)
            error = _softmax(value @ w)
            error[label] -= 1.0
            gradient = weight * value[:, None] * error[None, :]
            before, after = np.sqrt(n[at]), np.sqrt(n[at] + gradient**2)
            z[at] += gradient - (after - before) / rate * w
            n[at] += gradient**2
    w = weights(np.arange(size))
    return w[:-1], w[-1]


def _temperature(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The temperature of least weighted log loss, by refining a grid."""
    lo, hi = np.log(0.25), np.log(20.0)
    for _ in range(4):
        grid = np.linspace(lo, hi, 25)
        loss = [-np.log(np.maximum(_softmax(scores / np.exp(t))[np.arange(len(labels)), labels], 1e-12)) @ weights for t in grid]
        best = int(np.argmin(loss))
        lo, hi = grid[max(0, best - 1)], grid[min(24, best + 1)]
    return float(np.exp(grid[best]))


def fit(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    orders: int = 3,
    scale: float = 30.0,
    rate: float = 0.5,
    beta: float = 1.0,
    l1: float = 1e-3,
    l2: float = 1e-3,
    epochs: int = 2,
    fit_rows: int = FIT_ROWS,
) -> LanguageModel:
    """Learn from the rows where ``learn`` holds."""
    learning = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).filter(F.col("text").rlike(r"\p{L}"))
    counts, total = _document_frequencies(learning, orders)
    idf = np.log((1 + total) / (1 + counts)) + 1.0
    totals = dict(learning.groupBy("lang").count().collect())
    languages = sorted(totals)
    if not languages:
        return LanguageModel([], idf, np.zeros((1 << BITS, 0)), np.zeros(0), 1.0, orders, scale)
    sample = _sample(learning, totals, max(LEAST_ROWS, fit_rows // len(languages))).collect()
    place, taken = {lang: i for i, lang in enumerate(languages)}, Counter(row.lang for row in sample)
    weight = {lang: totals[lang] * len(sample) / (taken[lang] * total) for lang in taken}
    rows = [(*_features(row.text, idf, orders, scale), place[row.lang], weight[row.lang]) for row in sample]
    held = [row for row, found in zip(rows, sample, strict=True) if found.nth % 5 == 0]
    weights, bias = fit_ftrl([row for row, found in zip(rows, sample, strict=True) if found.nth % 5], len(languages), rate, beta, l1, l2, epochs)
    scores = np.array([value @ weights[at] + bias for at, value, _, _ in held])
    temperature = _temperature(scores, np.array([row[2] for row in held]), np.array([row[3] for row in held])) if held else 1.0
    return LanguageModel(languages, idf, weights, bias, temperature, orders, scale)


def _sample(learning: DataFrame, totals: dict[str, int], most: int) -> DataFrame:
    """(text, lang, nth): at most ``most`` rows of each language, in the order of their hashes; ``nth``
    counts from 1.  Rows are thinned by hash first, so no task sorts more than a little above ``most``."""
    cells = 1 << 30
    shares = F.create_map(*(F.lit(x) for lang, n in totals.items() for x in (lang, int(cells * min(1.0, (most + 4 * most**0.5 + 10) / n)))))
    thinned = learning.withColumn("place", F.pmod(F.xxhash64("id", "lang"), F.lit(cells))).filter(F.col("place") < shares[F.col("lang")])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", "id", "text"))
    return thinned.withColumn("nth", nth).filter(F.col("nth") <= most).orderBy("place", "id", "lang", "nth").select("text", "lang", "nth")


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """Adds the language and its probability to the rows (in place of columns of these names); others pass through."""
    kept = [c for c in docs.columns if c not in {lang_name, score_name}]
    idf = model.idf.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((idf, (model.weights * model.idf[:, None]).astype(np.float32).T.copy(), model))
    place = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, table, model = shared.value
        for batch in batches:
            langs, scores = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for rows, codes, starts in blocks(batch.column(place), model.orders):
                has_letter = np.logical_or.reduceat(tables()[0][codes], starts)
                if not model.languages:
                    continue
                mass, sums = np.zeros(len(starts)), np.zeros((len(model.languages), len(starts)))
                for bucket in _buckets(codes, model.orders):
                    mass += np.add.reduceat(idf[bucket], starts)
                    for k in range(len(sums)):
                        sums[k] += np.add.reduceat(table[k][bucket], starts)
                p = _softmax((model.scale * sums / mass + model.bias[:, None]).T / model.temperature)
                best = p.argmax(axis=1)
                langs[rows] = np.where(has_letter, np.array(model.languages, object)[best], UNKNOWN)
                scores[rows] = np.where(has_letter, p[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], [*batch.schema.names, lang_name, score_name])

    source = docs.select(*kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(run, f"{fields}, `{lang_name}` string, `{score_name}` double")
