"""Codes for vectors: a codebook for each part of a vector, searched through a VA file.

Components become integers.  Vectors are cut into equal parts; each part position has a codebook
whose entries are improved by rounds of assignment and averaging, and a vector's code is the index
of the nearest entry at each position.

The nearest entry is found by VA-file filtering.  For every coordinate of a codebook the values of
its entries are quantised into ``1 << bits`` cells.  A query coordinate has a table with the least
and the largest squared distance to each cell; sums of table entries bound the distance to an entry
from below and above.  Only entries whose lower bound does not exceed the smallest upper bound are
refined with integer distances, so the assignment is exact; ties go to the lower index.

Rows stay in their tasks: a round moves one sum and one count for each entry coordinate and task,
and what reaches the driver are the codebooks (``parts * entries`` entries, whatever the table).
Sums over equal labels are aggregated first; labels with at least a thousandth of all rows (so at
most a thousand of them) are joined back by broadcast, the others by their label.

Edge cases: vectors that are null or hold a null or a component that is not finite are dropped;
components are held at ``LARGEST`` in size, so that sums stay exact; shorter vectors are filled
with zeros up to the longest, and that up to a multiple of ``parts``; with fewer kept vectors than
``entries`` there are as many entries as vectors; null ids come last among the first entries, ties
are ordered by the vectors; repeated rows are each answered; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scratch

#: Largest integer component; squared distances of 64 such components fit in 63 bits.
LARGEST = 1 << 27
#: Parts that are compared at once.
BLOCK = 4096
#: A label with this share of all rows is joined by broadcast.
HOT_LABEL = 1000


class VAFile:
    """The entries of one codebook, (entries, width) integers, with the cells of their coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = 4):
        self.entries = entries
        cells = 1 << bits
        order = np.sort(entries, axis=0)
        # Cells hold about equally many entries; their bounds are the outermost values inside them.
        cuts = order[np.minimum(np.arange(1, cells) * len(entries) // cells, len(entries) - 1)]
        self.cells = np.stack([np.searchsorted(np.unique(cut), entries[:, d], side="right") for d, cut in enumerate(cuts.T)], axis=1)
        self.low = np.full((entries.shape[1], cells), LARGEST, np.int64)
        self.high = np.full((entries.shape[1], cells), -LARGEST, np.int64)
        for d in range(entries.shape[1]):
            np.minimum.at(self.low[d], self.cells[:, d], entries[:, d])
            np.maximum.at(self.high[d], self.cells[:, d], entries[:, d])

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        """Mask (queries, entries) of the entries that may be nearest."""
        below = np.zeros((len(queries), len(self.entries)), np.int64)
        above = np.zeros_like(below)
        for d in range(queries.shape[1]):
            q = queries[:, d, None]
            to_low, to_high = self.low[d] - q, q - self.high[d]
            least = np.maximum(np.maximum(to_low, to_high), 0) ** 2
            most = np.maximum(np.abs(to_low), np.abs(to_high)) ** 2
            below += least[:, self.cells[:, d]]
            above += most[:, self.cells[:, d]]
        return below <= above.min(axis=1, keepdims=True)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the squared distance to it."""
        index, distance = np.empty(len(queries), np.int64), np.empty(len(queries), np.int64)
        for at in range(0, len(queries), BLOCK):
            part = queries[at : at + BLOCK]
            row, entry = np.nonzero(self.candidates(part))
            exact = ((part[row] - self.entries[entry]) ** 2).sum(axis=1)
            opens = np.searchsorted(row, np.arange(len(part)))
            least = np.minimum.reduceat(exact, opens)
            hits = np.flatnonzero(exact == least[row])
            first = hits[np.searchsorted(row[hits], np.arange(len(part)))]
            index[at : at + BLOCK], distance[at : at + BLOCK] = entry[first], least
        return index, distance


def _vectors(column: pa.Array, length: int) -> np.ndarray:
    """Integer vectors of a batch, filled with zeros up to ``length``."""
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy().astype(np.int64)
    if (sizes == length).all():
        return flat.reshape(-1, length)
    out = np.zeros((len(sizes), length), np.int64)
    out[np.arange(length) < sizes[:, None]] = flat
    return out


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, ints) of the vectors that are kept."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    kept = F.col("vec").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = lambda v: F.greatest(F.least(F.floor(v * scale), F.lit(LARGEST)), F.lit(-LARGEST))
    return rows.filter(kept).select("vec_id", "label", F.transform("vec", lambda v: held(v).cast("int")).alias("ints"))


def learn(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, bits: int = 4) -> np.ndarray:
    """Codebooks (parts, entries, width) from a table with ``vec_id`` and ``ints``."""
    longest = rows.agg(F.max(F.size("ints"))).first()[0]
    width = -(-max(longest or 0, 1) // parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    start = np.zeros((len(first), parts * width), np.int64)
    for vector, (found,) in zip(start, first, strict=True):
        vector[: len(found)] = found
    books = np.ascontiguousarray(start.reshape(-1, parts, width).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        for part, entry, place, total, n in _sums(rows, books, bits).collect():
            books[part, entry, place] = total // n
    return books


def _sums(rows: DataFrame, books: np.ndarray, bits: int) -> DataFrame:
    """(part, entry, place, total, n): what the parts assigned to each entry add up to."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VAFile(book, bits) for book in shared.value]
        totals, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            vectors = _vectors(batch.column(0), parts * width).reshape(-1, parts, width)
            for p, file in enumerate(files):
                index, _ = file.nearest(vectors[:, p])
                np.add.at(totals[p], index, vectors[:, p])
                counts[p] += np.bincount(index, minlength=entries)
        p, e = np.nonzero(counts)
        columns = [np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p)), totals[p, e].ravel(), np.repeat(counts[p, e], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "place", "total", "n"])

    found = rows.select("ints").mapInArrow(run, "part long, entry long, place long, total long, n long")
    return found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def encode(rows: DataFrame, books: np.ndarray, bits: int = 4) -> DataFrame:
    """(vec_id, label, code, error): two hex digits a part, squared distances summed over parts."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VAFile(book, bits) for book in shared.value] if books.shape[1] else []
        for batch in batches:
            vectors = _vectors(batch.column("ints"), parts * width).reshape(-1, parts, width)
            codes, error = np.zeros((len(vectors), parts), np.uint8), np.zeros(len(vectors), np.int64)
            for p, file in enumerate(files):
                index, distance = file.nearest(vectors[:, p])
                codes[:, p] = index
                error += distance
            text = codes.tobytes().hex()
            code = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, code_col: str = "code") -> DataFrame:
    """Adds ``ints``, the vector that a code stands for."""
    parts = books.shape[0]
    table = F.array(*(F.array(*(F.array(*(F.lit(int(x)) for x in entry)) for entry in book)) for book in books))
    place = lambda p: F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("ints", F.concat(*(table[p][place(p)] for p in range(parts))))


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the errors of all rows of the same label (null labels are one)."""
    sums = _scratch.stage(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    total = sums.agg(F.sum("n")).first()[0] or 0
    hot = sums.filter(F.col("n") * HOT_LABEL >= total).select(F.col("label").alias("hot"), F.col("label_error").alias("hot_error"))
    rest = sums.filter(F.col("n") * HOT_LABEL < total).select(F.col("label").alias("other"), "label_error")
    marked = coded.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("hot")), "left")
    common = marked.filter(F.col("hot_error").isNotNull()).select(*coded.columns, F.col("hot_error").alias("label_error"))
    rare = marked.filter(F.col("hot_error").isNull()).select(*coded.columns)
    return common.unionByName(rare.join(rest, F.col("label").eqNullSafe(F.col("other"))).select(*coded.columns, "label_error"))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, bits: int = 4
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of the kept vectors, and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    rows = _scratch.stage(integers(vectors, id_col, vector_col, label_col, scale), "integers")
    books = learn(rows, parts, entries, rounds, bits)
    coded = _scratch.stage(encode(rows, books, bits), "codes")
    _scratch.drop_table(rows)
    return coded, books
