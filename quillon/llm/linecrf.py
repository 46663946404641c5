"""Line labelling by a linear-chain conditional random field, and quality rules on whole texts.

1. Base counts.  Bytes of a run of texts are worked on together.  Words and lines are numbered by an
   exact dictionary, windows of eight words by three rounds of pair numbering, so equality is never
   that of hashes.
2. The field.  A line is described by the buckets of some shares and lengths (``LINE_FEATURES``);
   the field has a weight for each bucket and for each pair of neighbouring labels.  Line labels
   come from documents: lines of good documents are content (1), lines of bad ones boilerplate (0).  It
   is fitted on the exact gradient, on at most ``FIT_ROWS`` documents of either label.
3. Decoding.  Viterbi marks the lines of every document; the share of its words in content lines decides.

Edge cases: a null text counts as empty (one line without words) and fails the base rules; a line is
whatever stands between line feeds, so other separators are characters of it; repeated rows are each
answered; texts are worked on whole; a null quality or id is not learnt from, nor is an id with both
qualities; without good or without bad documents every line is content; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scratch, crf

#: Documents of either quality on which the field is fitted (those with the smallest hashes).
FIT_ROWS = 1000
#: Bytes of text that are worked on at once (a longer text is a block of its own).
BLOCK = 1_000_000
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Base rules: fewest words, largest percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Least share of words in content lines.
LEAST_CONTENT = 0.5
#: Names and upper bounds of the buckets of each feature; a value equal to a bound is in the bucket above.
LINE_FEATURES = (
    ("words", (1, 2, 4, 8, 16, 32, 64)),
    ("symbols_per_word", (0.01, 0.05, 0.2, 0.5)),
    ("upper_share", (0.05, 0.15, 0.3, 0.6)),
    ("letter_share", (0.5, 0.7, 0.85, 0.95)),
    ("digit_share", (0.01, 0.1, 0.3)),
    ("word_length", (3.0, 4.5, 6.0, 8.0)),
    ("bare_share", (0.01, 0.1, 0.3)),
    ("shouts_per_word", (0.01, 0.1, 0.3)),
    ("stops_per_word", (0.01, 0.05, 0.3)),
    ("repeated_share", (0.01, 0.3, 0.7)),
    ("distinct_share", (0.2, 0.4, 0.6, 0.8, 0.95)),
    ("duplicate", (1,)),
    ("last", (1,)),
)


@dataclass
class Lines:
    """Lines of a block of texts: feature buckets, whether each is the first of its text, its text and words."""

    features: np.ndarray
    first: np.ndarray
    of: np.ndarray
    words: np.ndarray


@dataclass
class Field:
    weights: np.ndarray
    pairs: np.ndarray


def _class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_SPACE, _SYMBOL, _SHOUT, _STOP = _class(b" \t\n\v\f\r"), _class(SYMBOLS), _class(b"!"), _class(b".?;:")
_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
# Bytes of other alphabets count as letters, at their first byte.
_LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC0, 0x100)))
_OPENS = _class(bytes(range(0x80)) + bytes(range(0xC0, 0x100)))


def _numbered(data: np.ndarray, member: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Equal strings have equal numbers: strings of these lengths, one after another in ``data[member]``."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[member]))])
    return strings.dictionary_encode().indices.to_numpy().astype(np.int64)


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


def _repeated(words: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each word is in a window of eight words that its text holds twice or more."""
    n, number, width = len(words), words, 1
    if n < WINDOW:
        return np.zeros(n, bool)
    while width < WINDOW:
        number, width = _pairs(number[:-width], number[width:]), 2 * width
    inside = np.flatnonzero(of[: len(number)] == of[WINDOW - 1 :])
    _, group, size = np.unique(number[inside] * (int(of[-1]) + 1) + of[inside], return_inverse=True, return_counts=True)
    at = inside[size[group] > 1]
    cover = np.bincount(at, minlength=n + WINDOW) - np.bincount(at + WINDOW, minlength=n + WINDOW)
    return np.cumsum(cover)[:n] > 0


def analyse(texts: list[str]) -> tuple[dict[str, np.ndarray], Lines]:
    """Base counts of each text, and its lines."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    opens = np.cumsum([0, *(len(t) + 1 for t in encoded)])[:-1]
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    of = np.searchsorted(opens, starts, side="right") - 1
    first = np.concatenate([[True], of[1:] != of[:-1]])
    tops = np.flatnonzero(first)
    total = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)
    inside = ~_SPACE[data]
    opening = inside & _OPENS[data]
    lo, hi = crf.runs(inside)
    line = np.searchsorted(ends, lo)
    n_lines, words = len(starts), np.bincount(line, minlength=len(starts))
    # Words: numbers, repeated windows, those without letter or digit.
    number = _numbered(data, inside, hi - lo)
    repeated = _repeated(number, of[line]) if len(lo) else np.zeros(0, bool)
    distinct = np.bincount(np.unique(line * (int(number.max(initial=0)) + 1) + number) // (int(number.max(initial=0)) + 1), minlength=n_lines)
    solid = (_LETTER | _DIGIT)[data]
    upto = np.concatenate([[0], np.cumsum(solid)])
    bare = upto[hi] == upto[lo]
    # Lines: equal to an earlier one of the text.
    same = _numbered(data, data != 10, ends - starts)
    key = same * len(texts) + of
    earliest = np.zeros(n_lines, bool)
    earliest[np.unique(key, return_index=True)[1]] = True
    twice = ~earliest & (words > 0)
    counts = np.unique(key, return_inverse=True, return_counts=True)
    often = (counts[2][counts[1]] > 1) & (words > 0)
    chars, symbols, letters = total(opening), total(_SYMBOL[data]), total(_LETTER[data])
    per_text = lambda v: np.add.reduceat(np.asarray(v, np.int64), tops)
    repeats = np.bincount(line, repeated, minlength=n_lines)
    base = {
        "n_words": per_text(words),
        "word_chars": per_text(chars),
        "n_symbols": per_text(symbols),
        "n_dup_lines": per_text(twice),
        "n_repeat_words": per_text(repeats),
    }
    per_word, per_char = np.maximum(words, 1), np.maximum(chars, 1)
    last = np.concatenate([first[1:], [True]])
    values = (
        words, symbols / per_word, total(_UPPER[data]) / np.maximum(letters, 1), letters / per_char, total(_DIGIT[data]) / per_char, chars / per_word,
        np.bincount(line, bare, minlength=n_lines) / per_word, total(_SHOUT[data]) / per_word, total(_STOP[data]) / per_word,
        repeats / per_word, distinct / per_word, often, last,
    )
    features, base_at = [np.zeros(n_lines, np.int64)], 1
    for value, (_, bounds) in zip(values, LINE_FEATURES, strict=True):
        features.append(base_at + np.searchsorted(bounds, value, side="right"))
        base_at += len(bounds) + 1
    return base, Lines(np.stack(features), first, of, words)


def _blocks(texts: pa.Array) -> Iterator[tuple[slice, list[str]]]:
    values = [t or "" for t in texts.to_pylist()]
    at = 0
    while at < len(values):
        end, held = at, 0
        while end < len(values) and (end == at or held + len(values[end]) <= BLOCK):
            held += len(values[end])
            end += 1
        yield slice(at, end), values[at:end]
        at = end


def viterbi(energy: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Most likely labels; where two are equally likely, content (1)."""
    (m00, m01), (m10, m11) = pairs.tolist()
    to_zero, to_one = [0] * len(energy), [0] * len(energy)
    lead = []
    d = 0.0
    for t, (e, opens) in enumerate(zip(energy.tolist(), first.tolist(), strict=True)):
        # d: by how much the best path to label 1 exceeds that to label 0.
        if not opens:
            zero, one = d + m10 - m00, d + m11 - m01
            to_zero[t], to_one[t] = int(zero >= 0), int(one >= 0)
            e += (max(d + m11, m01)) - (max(d + m10, m00))
        d = e
        lead.append(d)
    labels, label = np.zeros(len(energy), np.int64), 0
    last = np.concatenate([first[1:], [True]]).tolist()
    for t in range(len(energy) - 1, -1, -1):
        if last[t]:
            label = int(lead[t] >= 0)
        labels[t] = label
        label = to_one[t] if label else to_zero[t]
    return labels


def _sample(docs: DataFrame, marked: DataFrame, fit_rows: int) -> DataFrame:
    """(features, quality) of at most ``fit_rows`` documents of either quality: a row for each text."""
    spark = docs.sparkSession
    narrow = docs.select("id", F.xxhash64("text").alias("h"))
    named = _scratch.stage(narrow.join(marked, "id").distinct(), "labelled")
    chosen = [_scratch.hashed_sample(named.filter(F.col("quality") == q), fit_rows, "id", "h").collect() for q in (0, 1)]
    if not all(chosen):
        return None
    picked = spark.createDataFrame([tuple(r) for part in chosen for r in part], named.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Equal rows of a task are worked on once; a third of all rows may be copies of a chosen one.
        seen = set()
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("id", "h")), strict=True))
            fresh = [i for i, key in enumerate(keys) if key not in seen and not seen.add(key)]
            part = batch.take(pa.array(fresh, pa.int64()))
            features = []
            for _, texts in _blocks(part.column("text")):
                _, lines = analyse(texts)
                cuts = np.flatnonzero(lines.first)
                features += [rows.astype(np.uint8).tobytes() for rows in np.split(lines.features.T, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "h", "quality")), pa.array(features, pa.binary())], ["id", "h", "quality", "features"])

    # The ids of the sample are at most 2 * fit_rows.
    held = docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(picked), ["id", "h"]).select("id", "h", "quality", "text")
    found = held.mapInArrow(run, "id long, h long, quality int, features binary")
    return found.groupBy("id", "h", "quality").agg(F.first("features").alias("features"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Field | None:
    """Learn from documents whose label is 1 (content) or 0 (boilerplate); None if one is missing."""
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("quality")).filter(F.col("id").isNotNull() & F.col("quality").isin(0, 1))
    marked = marked.groupBy("id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").drop("most")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with _scratch.temporary(docs.sparkSession):
        sample = _sample(rows, marked, fit_rows)
        found = sorted(sample.collect()) if sample is not None else []
    if not found:
        return None
    width = len(LINE_FEATURES) + 1
    parts = [np.frombuffer(r.features, np.uint8).reshape(-1, width).astype(np.int64) for r in found]
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    first = np.zeros(sizes.sum(), bool)
    first[starts] = True
    of = np.repeat(np.arange(len(parts)), sizes)
    lines = Lines(np.concatenate(parts).T.copy(), first, of, np.ones(len(of), np.int64))
    weights, pairs = crf.fit_field(lines, np.repeat([r.quality for r in found], sizes))
    return Field(weights[: 1 + sum(len(b) + 1 for _, b in LINE_FEATURES)], pairs)


def label_lines(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, content_words, boilerplate):
    ``boilerplate`` lists the numbers of the lines (from zero) that are not content."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for rows, texts in _blocks(batch.column(1)):
                base, lines = analyse(texts)
                labels = np.ones(len(lines.of), np.int64)
                if field is not None:
                    labels = viterbi(field.weights[lines.features].sum(axis=0), lines.first, field.pairs)
                tops = np.flatnonzero(lines.first)
                sizes = np.diff(np.append(tops, len(labels)))
                content = np.add.reduceat(lines.words * labels, tops)
                junk = np.flatnonzero(labels == 0)
                offsets = np.searchsorted(junk, np.append(tops, len(labels))).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array((junk - tops[lines.of[junk]]).astype(np.int32)))
                columns = [batch.column(0)[rows.start : rows.stop], *(pa.array(base[c].astype(np.int64)) for c in counts), pa.array(sizes.astype(np.int64)), pa.array(content.astype(np.int64)), listed]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *counts, "n_lines", "content_words", "boilerplate"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(source.dtypes)['doc_id']}, {', '.join(f'{c} long' for c in counts)}, n_lines long, content_words long, boilerplate array<int>"
    return source.mapInArrow(run, schema)


def quality(labelled: DataFrame, least_content: float = LEAST_CONTENT) -> DataFrame:
    """Adds ``base_failed``, ``content_share`` (null without words) and ``kept``."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    share = F.try_divide(F.col("content_words"), F.col("n_words"))
    return labelled.withColumns({"base_failed": failed, "content_share": share, "kept": ~failed & (share >= least_content)})


def content_only(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, content): the texts without the lines marked as boilerplate.  Ids must be distinct."""
    marks = labelled.select(F.col("doc_id").alias("__id"), "boilerplate")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "boilerplate"), lambda i: F.get(lines, i))
    return docs.join(marks, docs[id_col] == F.col("__id")).select(F.col(id_col).alias("doc_id"), F.array_join(kept, "\n").alias("content"))
