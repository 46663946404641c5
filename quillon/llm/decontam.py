"""Benchmark decontamination by BM25 with block-max WAND, then a check of question and answer.

Test items form an inverted index: for each word its items, in order, in blocks that store their
largest contribution.  Contributions are BM25 divided by the item's score for its own words, so one
threshold serves all items.  Items of similar length share an index, and for each index every
document is cut into overlapping passages long enough for any of its items to lie whole in one.
Every passage is a query.  Passages whose words' largest contributions cannot reach the threshold,
then those whose largest contributions in no block can, are passed over by vectorised sums over
the batch; the others run through the index, which skips blocks that cannot reach it.  A retrieved item counts if enough of the five-word
shingles of its question, and of its answer, are in the passage.

An item's question ends with its last question mark; without one, with the last end of a sentence
or line that leaves words on both sides; otherwise both parts are the whole item.  Parts of fewer
than five words are compared as one sequence.

Items are cut by hash into slices of about ``index_bytes`` of text; each slice's index is built in
a task of its own and written to the shared folder.  The numbers of items, their mean length and
each word's items are counted once over all items, so scores do not depend on the slices.  The
documents are read once: a worker gathers bounded runs of texts and passes each through the
slices, of which it holds one at a time.

Edge cases: null texts count as empty; items without words match nothing; items that are equal in
id and text count once; documents with null ids and repeated rows are each answered; a very long
text is cut into passages like any other; empty tables give no leaks; columns other than those
named are not read.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scratch
from ._chars import blocks, words

SHINGLE = 5
#: Bytes of texts that a worker gathers before it passes them through more than one slice.
GATHERED = 32 << 20


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    question: np.ndarray
    answer: np.ndarray


@dataclass
class Index:
    """Of items of similar length.  ``local`` is the place of each term of the whole set among the
    index's own terms (-1: none); ``most`` is its largest contribution; ``block_*`` are the blocks'
    largest contributions, one run for each term from ``block_from``."""

    items: list[Item]
    width: int
    local: np.ndarray
    most: np.ndarray
    postings: list[tuple[list[int], list[float]]]
    block_from: np.ndarray
    block_of: np.ndarray
    block_most: np.ndarray
    blocks: int
    size: int

    def block_list(self, term: int) -> tuple[list[int], list[float]]:
        run = slice(self.block_from[term], self.block_from[term + 1])
        return ((self.block_of[run] + 1) * self.size - 1).tolist(), self.block_most[run].tolist()


@dataclass
class IndexSet:
    terms: np.ndarray
    parts: list[Index]


def shingles(keys: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five words (of the whole, if shorter)."""
    n = max(1, len(keys) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(keys))):
        out = (out ^ keys[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def _hashed(text: str) -> np.ndarray:
    _, codes, starts = next(blocks(pa.array([text]), 1))
    return words(codes, starts)[3]


def parts(text: str) -> tuple[str, str]:
    for mark in (r"\?", r"[.!?](?=\s)|\n"):
        for found in reversed(list(re.finditer(mark, text))):
            question, answer = text[: found.end()], text[found.end() :]
            if len(_hashed(question)) and len(_hashed(answer)):
                return question, answer
    return text, text


@dataclass(frozen=True)
class Statistics:
    """Of all items with words: how many there are, their mean length and each word's items."""

    items: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


def statistics(items: list[tuple[int, str | None]]) -> Statistics:
    """Those of a list of items (a slice that is the whole benchmark)."""
    found = [keys for _, text in items if len(keys := _hashed(text or ""))]
    terms, df = np.unique(np.concatenate([np.unique(k) for k in found]), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Statistics(len(found), sum(map(len, found)) / len(found) if found else 0.0, terms, df)


def build_index(items: list[tuple[int, str | None]], whole: Statistics | None = None, k1: float = 1.2, b: float = 0.75, block: int = 8) -> IndexSet:
    """The index of a slice's items, scored by the statistics of the whole benchmark."""
    whole = whole or statistics(items)
    kept = []
    for item_id, text in items:
        keys = _hashed(text or "")
        if len(keys):
            question, answer = parts(text)
            kept.append(Item(item_id, keys, np.unique(shingles(_hashed(question))), np.unique(shingles(_hashed(answer)))))
    if not kept:
        return IndexSet(np.zeros(0, np.uint64), [])
    terms = np.unique(np.concatenate([item.words for item in kept]))
    df = whole.df[np.searchsorted(whole.terms, terms)]
    idf = np.log(1 + (whole.items - df + 0.5) / (df + 0.5))
    groups: dict[int, list[Item]] = {}
    for item in kept:
        groups.setdefault(len(item.words).bit_length(), []).append(item)
    return IndexSet(terms, [_index(groups[n], terms, idf, whole.mean, k1, b, block) for n in sorted(groups)])


def _index(items: list[Item], terms: np.ndarray, idf: np.ndarray, mean: float, k1: float, b: float, block: int) -> Index:
    found: dict[int, list[tuple[int, float]]] = {}
    for i, item in enumerate(items):
        own, tf = np.unique(item.words, return_counts=True)
        place = np.searchsorted(terms, own)
        value = idf[place] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(item.words) / mean))
        for term, v in zip(place.tolist(), (value / value.sum()).tolist(), strict=True):
            found.setdefault(term, []).append((i, v))
    local, most = np.full(len(terms), -1), np.zeros(len(terms))
    postings, block_from, block_of, block_most = [], [0], [], []
    for n, (term, entries) in enumerate(sorted(found.items())):
        local[term], most[term] = n, max(v for _, v in entries)
        postings.append(([i for i, _ in entries], [v for _, v in entries]))
        largest: dict[int, float] = {}
        for i, v in entries:
            largest[i // block] = max(largest.get(i // block, 0.0), v)
        block_of += list(largest)
        block_most += list(largest.values())
        block_from.append(len(block_of))
    arrays = (np.array(x) for x in (block_from, block_of, block_most))
    return Index(items, max(len(item.words) for item in items), local, most, postings, *arrays, -(-len(items) // block), block)


def retrieve(index: Index, terms: list[int], least: float) -> list[tuple[int, float]]:
    """Every item whose score for the (distinct) terms reaches ``least``: block-max WAND."""
    lists = [[*index.postings[t], *(found := index.block_list(t)), max(found[1]), 0] for t in terms]
    out = []
    while True:
        lists = [x for x in lists if x[5] < len(x[0])]
        lists.sort(key=lambda x: x[0][x[5]])
        bound, pivot = 0.0, None
        for n, x in enumerate(lists):
            bound += x[4]
            if bound >= least:
                pivot = n
                break
        if pivot is None:
            return out
        item = lists[pivot][0][lists[pivot][5]]
        while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][5]] == item:
            pivot += 1
        # Largest contributions of the blocks in which the pivot item would lie.
        shallow, following = 0.0, len(index.items)
        for x in lists[: pivot + 1]:
            at = bisect_left(x[2], item)
            if at < len(x[2]):
                shallow += x[3][at]
                following = min(following, x[2][at] + 1)
        if shallow < least:
            if pivot + 1 < len(lists):
                following = min(following, lists[pivot + 1][0][lists[pivot + 1][5]])
            following = max(following, item + 1)
            for x in lists[: pivot + 1]:
                x[5] = bisect_left(x[0], following, x[5])
            continue
        score = 0.0
        for x in lists[: pivot + 1]:
            x[5] = bisect_left(x[0], item, x[5])
            if x[5] < len(x[0]) and x[0][x[5]] == item:
                score += x[1][x[5]]
                x[5] += 1
        if score >= least:
            out.append((item, score))


def search(found: IndexSet, keys: np.ndarray, of: np.ndarray, docs: int, least: float, overlap: float) -> Iterator[tuple[int, int, float]]:
    """(document, item id, score) of the leaks among the word hashes of a block of documents."""
    if not found.parts or not len(keys):
        return
    at = np.minimum(np.searchsorted(found.terms, keys), len(found.terms) - 1)
    hit = found.terms[at] == keys
    place = np.arange(len(keys)) - np.searchsorted(of, np.arange(docs))[of]
    for index in found.parts:
        # Cells of the longest item's length, counted from each document's first word; a passage is two.
        bound = np.where(hit, index.most[at], 0.0)
        opens = np.flatnonzero(place % index.width == 0)
        sums, cell_of, ends = np.add.reduceat(bound, opens), of[opens], np.append(opens[1:], len(keys))
        joined = np.append(cell_of[1:] == cell_of[:-1], False)
        reach = sums + np.where(joined, np.append(sums[1:], 0.0), 0.0)
        ends = np.where(joined, np.append(ends[1:], len(keys)), ends)
        chosen = np.flatnonzero(reach >= least)
        for some in np.array_split(chosen, -(-len(chosen) * index.blocks // (1 << 21))) if len(chosen) else ():
            for n, terms in _candidates(index, at, bound > 0, opens[some], ends[some], least):
                lo, hi, passage = opens[some[n]], ends[some[n]], None
                for item, score in retrieve(index, terms, least):
                    passage = shingles(keys[lo:hi]) if passage is None else passage
                    entry = index.items[item]
                    if all(_share(part, keys[lo:hi], passage) >= overlap for part in (entry.question, entry.answer)):
                        yield int(cell_of[some[n]]), entry.item_id, score


def _candidates(index: Index, at: np.ndarray, used: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: float) -> Iterator[tuple[int, list[int]]]:
    """Passages that can reach ``least`` in some block, with their distinct terms."""
    lengths = hi - lo
    tokens = np.repeat(lo - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    passage = np.repeat(np.arange(len(lo)), lengths)
    passage, tokens = passage[used[tokens]], tokens[used[tokens]]
    width = len(index.postings)
    pairs = np.sort(passage * width + index.local[at[tokens]])
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    passage, term = pairs // width, pairs % width
    counts = index.block_from[term + 1] - index.block_from[term]
    entry = np.repeat(index.block_from[term] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    reach = np.bincount(np.repeat(passage, counts) * index.blocks + index.block_of[entry], index.block_most[entry], len(lo) * index.blocks)
    for n in np.flatnonzero(reach.reshape(len(lo), index.blocks).max(axis=1) >= least).tolist():
        run = slice(*np.searchsorted(passage, [n, n + 1]))
        yield n, term[run].tolist()


def remove_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    least: float = 0.7,
    overlap: float = 0.8,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    index_bytes: int = 8 << 20,
) -> DataFrame:
    """The documents, with all their columns, in which no item's question and answer are found."""
    place, files = docs.columns.index(text_col), index_files(benchmark, item_col, item_text_col, index_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gathered in _gathered(batches, place, len(files)):
            clean = [np.ones(batch.num_rows, bool) for batch in gathered]
            for n, doc, _, _ in _leaks([batch.column(place) for batch in gathered], files, least, overlap):
                clean[n][doc] = False
            for batch, keep in zip(gathered, clean, strict=True):
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _gathered(batches: Iterator[pa.RecordBatch], place: int, slices: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of batches: single ones for one slice, about GATHERED bytes of texts for several."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(place).nbytes
        if slices <= 1 or size >= GATHERED:
            yield held
            held, size = [], 0
    if held:
        yield held


_HELD: dict[str, IndexSet] = {}


def _load(path: str) -> IndexSet:
    """The index of a slice; a worker process keeps the last one."""
    if path not in _HELD:
        _HELD.clear()
        fs, inner = _scratch.file_system(path)
        with fs.open_input_stream(inner, compression=None) as source:
            _HELD[path] = pickle.loads(source.read())
    return _HELD[path]


def _leaks(texts: list[pa.Array], files: list[str], least: float, overlap: float) -> Iterator[tuple[int, int, int, float]]:
    """(array, row, item id, score) of the leaks in arrays of texts."""
    if not files:
        return
    for path in files:
        index = _load(path)
        for n, array in enumerate(texts):
            for at, codes, starts in blocks(array, 1):
                _, _, of, keys = words(codes, starts)
                for doc, item, score in search(index, keys, of, len(starts), least, overlap):
                    yield n, at.start + doc, item, score


def _share(part: np.ndarray, keys: np.ndarray, passage: np.ndarray) -> float:
    hits = np.isin(part, passage)
    if len(part) == 1 and not hits[0]:  # it may be shorter than a shingle
        for n in range(1, min(SHINGLE, len(keys) + 1)):
            runs = np.lib.stride_tricks.sliding_window_view(keys, n)
            out = np.zeros(len(runs), np.uint64)
            for i in range(n):
                out = (out ^ runs[:, i]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(31)
            if (out == part[0]).any():
                return 1.0
    return float(hits.mean())


def index_files(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", index_bytes: int = 8 << 20) -> list[str]:
    """Builds the index of each slice and returns the files' names.  Only these and two sums over
    the items reach the driver."""
    folder = _scratch.new_path(benchmark.sparkSession, "bm25")
    with _scratch.temporary(benchmark.sparkSession):
        return _build_files(benchmark, item_col, text_col, index_bytes, folder)


def _build_files(benchmark: DataFrame, item_col: str, text_col: str, index_bytes: int, folder: str) -> list[str]:
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-size // index_bytes))
    items = _scratch.stage(items.withColumn("slice", F.pmod(F.xxhash64("item", "text"), F.lit(slices)).cast("int")), "items")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each of an item's terms, and one without a term that holds its length."""
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = _hashed(text or "")
                if len(keys):
                    terms = [*np.unique(keys).view(np.int64).tolist(), None]
                    lengths = [0] * (len(terms) - 1) + [len(keys)]
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(terms), pa.int32()), pa.array(terms, pa.int64()), pa.array(lengths, pa.int64())], ["slice", "term", "length"])

    counted = items.select("slice", "text").mapInArrow(count, "slice int, term long, length long")
    held = _scratch.stage(counted.groupBy("slice", "term").agg(F.count("*").alias("n"), F.sum("length").alias("length")), "terms")
    with_words, total = held.filter("term is null").agg(F.sum("n"), F.sum("length")).first()
    if not with_words:
        return []
    mean, held = total / with_words, held.filter("term is not null")
    df = held.groupBy("term").agg(F.sum("n").alias("df"))
    terms = held.select("slice", "term").join(df, "term").select("slice", "term", "df")

    def build(key: tuple, items: pa.Table, terms: pa.Table) -> pa.Table:
        number = key[0].as_py()
        found, counts = terms["term"].to_numpy().view(np.uint64), terms["df"].to_numpy()
        order = np.argsort(found)
        rows = sorted(zip(items["item"].to_pylist(), items["text"].to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        index, path = build_index(rows, Statistics(with_words, mean, found[order], counts[order])), f"{folder}/slice-{number:06d}.idx"
        with _scratch.CommittedFile(path) as out:
            out.write(pickle.dumps(index, protocol=5))
        return pa.table({"file": [path]})

    built = items.groupBy("slice").cogroup(terms.groupBy("slice")).applyInArrow(build, "file string")
    return sorted(r.file for r in _scratch.stage(built, "slices").collect())


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    least: float = 0.7,
    overlap: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    index_bytes: int = 8 << 20,
) -> DataFrame:
    """(doc_id, leaked, items, best_score): one row per document, with the sorted ids of the items in it
    (an item without an id counts for ``leaked`` and the score)."""
    files = index_files(benchmark, item_col, item_text_col, index_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gathered in _gathered(batches, 1, len(files)):
            items = [[set() for _ in range(batch.num_rows)] for batch in gathered]
            best = [np.zeros(batch.num_rows) for batch in gathered]
            for n, doc, item, score in _leaks([batch.column(1) for batch in gathered], files, least, overlap):
                items[n][doc].add(item)
                best[n][doc] = max(best[n][doc], score)
            for batch, found, scores in zip(gathered, items, best, strict=True):
                lists = [sorted(i for i in s if i is not None) for s in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([bool(s) for s in found], pa.bool_()), pa.array(lists, pa.list_(pa.int64())), pa.array(scores)], ["doc_id", "leaked", "items", "best_score"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, leaked boolean, items array<long>, best_score double")
