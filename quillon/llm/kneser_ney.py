"""Interpolated modified Kneser-Ney bigram model, counted in Spark and looked up in sorted hash arrays.

Counting.  Words come first: tasks count bounded pieces of their texts and ship sorted packed
arrays; reducing a shard of words writes its sorted hashes and counts.  A word's number is its shard
and its place there, so a pair of words is one 64-bit key from which both can be read, and no two
pairs share one.  Pairs are then counted in the same way.  A shard of pairs is chosen by a hash of
the whole pair: the followers of one very common word are spread over all shards.  Reducing a
pair shard writes its sorted arrays and ships on, by word, how many pairs of each count a word opens
and how many it ends, which reducing a word shard puts beside its hashes.

The number of shards follows the size of the input, so a shard stays within memory.  A piece is
cut into at most ``1 << fan_bits`` packed arrays; where there are more shards, bundles of bounded
size are merged and cut again, one more step for each ``fan_bits`` bits.  So the number of
packed arrays grows in proportion to the input.  Numbers that reach the driver are sums of fixed width.

Scoring.  Workers map the shards' files into memory and look the words and pairs of a piece of
texts up by binary search, in order of the key; only shards that occur in the piece are opened.
Files that are not on a mounted file system are copied to the worker's disk for the time of the mapping.

Tokens are words without ASCII white space, A-Z lower-cased, then one end; a text is scored from
a start that is no token.  Words are told apart by the XXH64 of their bytes.  Edge cases: a null text
counts as empty (its end alone is scored); null ids are learnt from as ``learn`` says; repeated rows
count each; with nothing learnt every token has probability one over one (score 0); an empty table
gives an empty result; other columns are not read.  More than 2 to the 32 word numbers are an error.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _scratch

#: Tokens that a task holds at once.
PIECE = 1_500_000
#: Bytes of text for which there is one shard of pairs; words have a quarter as many shards.
SHARD_BYTES = 16 << 20
#: Bits of a shard's number by which packed arrays are cut at once, and bytes that are merged in one group before the next cut.
FAN_BITS, BUNDLE_BYTES = 8, 64 << 20
#: Files that a worker keeps mapped.
MOST_OPEN = 4096
END, START = np.uint64(xxhash.xxh64_intdigest(b"</s>\n")), np.uint64(xxhash.xxh64_intdigest(b"<s>\n"))
HALF, LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
#: Counts from here on are kept beside the column of bytes.
LARGE = 255
BLOB = "shard long, data binary"


# Packed arrays: sorted keys as differences and any number of count columns, bytes of equal weight together.
def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    gaps = np.diff(keys, prepend=np.uint64(0))
    parts = [c.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in (gaps, *columns)]
    return struct.pack("<II", len(keys), len(columns)) + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    n, columns = struct.unpack_from("<II", data)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8).reshape(columns + 1, 8, n)
    out = [np.ascontiguousarray(c.T).view("<u8").ravel() for c in raw]
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def merge(packed: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sums of the columns by key."""
    columns = [np.concatenate(c) for c in zip(*packed, strict=True)]
    order = np.argsort(columns[0], kind="stable")
    keys = columns[0][order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return [keys[starts], *(np.add.reduceat(c[order], starts) if len(starts) else c for c in columns[1:])]


def _same(keys: np.ndarray) -> np.ndarray:
    return keys


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return keys ^ (keys >> np.uint64(29))


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _by_shard(shards: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of each shard that occurs, in the order they have."""
    order = np.argsort(shards, kind="stable")
    sorted_shards = shards[order]
    cuts = np.flatnonzero(np.diff(sorted_shards, prepend=-1))
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=False):
        yield int(sorted_shards[lo]), [c[order[lo:hi]] for c in columns]


def _blobs(turned: np.ndarray, bits: int, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
    found = [(shard, pack(*c)) for shard, c in _by_shard(shard_of(turned, bits), *columns)]
    return [shard for shard, _ in found], [data for _, data in found]


def _cut_further(blobs: DataFrame, turn: Callable, bits: int, fan_bits: int, bundle_bytes: int) -> DataFrame:
    """Packed arrays cut by the first ``fan_bits`` bits, cut on until each is of one shard of ``bits`` bits."""
    done = min(fan_bits, bits)
    while done < bits:
        following = min(bits, done + fan_bits)
        blobs = _scratch.stage(blobs, "blobs")
        size = blobs.agg(F.sum(F.octet_length("data"))).first()[0] or 0
        bundles = max(1, -(-size // (bundle_bytes << done)))
        blobs = blobs.groupBy("shard", F.pmod(F.xxhash64("data"), F.lit(bundles)).alias("bundle")).applyInArrow(_cutter(turn, following), BLOB)
        done = following
    return blobs


def _cutter(turn: Callable, bits: int) -> Callable:
    def cut(table: pa.Table) -> pa.Table:
        keys, *columns = merge([unpack(d.as_py()) for d in table["data"]])
        shards, data = _blobs(turn(keys), bits, keys, *columns)
        return pa.table([pa.array(shards, pa.int64()), pa.array(data, pa.binary())], ["shard", "data"])

    return cut


def token_keys(text: str | None) -> np.ndarray:
    words = (text or "").encode().lower().split()
    keys = np.empty(len(words) + 1, np.uint64)
    keys[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    keys[-1] = END
    return keys


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Runs of texts of about PIECE tokens: other columns' values, token keys and where each text starts."""
    rows, held, n = [], [], 0

    def made():
        lengths = np.array([len(k) for k in held])
        return rows, np.concatenate(held), np.cumsum(lengths) - lengths

    for batch in batches:
        others = zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True) if batch.num_columns > 1 else repeat(())
        for text, other in zip(batch.column(0), others, strict=False):
            keys = token_keys(text.as_py())
            rows.append(other)
            held.append(keys)
            n += len(keys)
            if n >= PIECE:
                yield made()
                rows, held, n = [], [], 0
    if held:
        yield made()


def _pairs(place: np.ndarray, start: int, starts: np.ndarray) -> np.ndarray:
    """For each token, the word before it (places among a piece's distinct words)."""
    before = np.concatenate([[start], place[:-1]])
    before[starts] = start
    return before


@dataclass
class Model:
    """``place_bits`` are the bits of a word's number that hold its place in its shard."""

    folder: str
    pair_bits: int
    word_bits: int
    place_bits: int
    tokens: int
    types: int
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    lower: tuple[float, float, float] = (0.0, 0.0, 0.0)
    pair_types: int = 0
    lower_mass: float = 1.0

    def turn_number(self, numbers: np.ndarray) -> np.ndarray:
        """Word numbers with the bits of their shard in front."""
        return numbers << np.uint64(64 - self.word_bits - self.place_bits)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """For counts of 1, 2 and more, from how many keys have counts 1 to 4."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [k - (k + 1) * y * b / a if a and b else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.01), k - 0.01) for k, d in enumerate(raw, 1))


def _count_columns(counts: np.ndarray) -> list[int]:
    found = np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)
    return [int(c) for c in found[1:5]]


# Files: a count of entries and of large counts, keys, a byte for each count, large counts by place.
def _write_counts(path: str, keys: np.ndarray, counts: np.ndarray) -> None:
    large = np.flatnonzero(counts >= LARGE)
    with _scratch.CommittedFile(path) as out:
        out.write(struct.pack("<QQ", len(keys), len(large)))
        out.write(np.ascontiguousarray(keys, "<u8").tobytes())
        out.write(np.minimum(counts, LARGE).astype(np.uint8).tobytes() + bytes(-len(keys) % 8))
        out.write(large.astype("<u8").tobytes() + np.ascontiguousarray(counts[large], "<u8").tobytes())


class Counts:
    """A file of ``_write_counts``, mapped."""

    def __init__(self, raw: np.ndarray):
        n, large = (int(x) for x in raw[:16].view("<u8"))
        at = 16 + 8 * n
        self.keys, self.bytes = raw[16:at].view("<u8"), raw[at : at + n]
        rest = raw[at + n + -n % 8 :].view("<u8")
        self.places, self.values = rest[:large], rest[large:]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sorted keys are there, and the places of these."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        return hit, at[hit]

    def counts(self, at: np.ndarray) -> np.ndarray:
        out = self.bytes[at].astype(np.uint64)
        if len(self.places):
            more = np.flatnonzero(out == LARGE)
            out[more] = self.values[np.searchsorted(self.places, at[more])]
        return out


SUMS = "keys long, total long, n1 long, n2 long, n3 long, n4 long"


def _sums_row(*numbers: int) -> pa.Table:
    names = [part.split(" ")[0] for part in SUMS.split(", ")]
    return pa.table([pa.array([n], pa.int64()) for n in (*numbers, *(0,) * (6 - len(numbers)))], names)


def _blob_batch(turned: np.ndarray, bits: int, *columns: np.ndarray) -> pa.RecordBatch:
    shards, data = _blobs(turned, bits, *columns)
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(data, pa.binary())], ["shard", "data"])


def _count_words(texts: DataFrame, model: Model, fan_bits: int, bundle_bytes: int) -> tuple[int, int, int]:
    """Writes the word shards; how many words and tokens there are, and the words of the largest shard.

    The start is entered with the number of texts as its count, which is no token's."""
    bits, folder = model.word_bits, model.folder

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, starts in pieces(batches):
            words, counts = np.unique(np.append(tokens, np.full(len(starts), START)), return_counts=True)
            yield _blob_batch(words, min(bits, fan_bits), words, counts)

    def reduce(key: tuple, table: pa.Table) -> pa.Table:
        words, counts = merge([unpack(d.as_py()) for d in table["data"]])
        _write_counts(f"{folder}/words-{key[0].as_py():08d}", words, counts)
        real = words != START
        return _sums_row(int(real.sum()), int(counts[real].sum()), len(words))

    counted = _cut_further(texts.mapInArrow(count, BLOB), _same, bits, fan_bits, bundle_bytes)
    reduced = _scratch.stage(counted.groupBy("shard").applyInArrow(reduce, SUMS), "words")
    found = reduced.agg(F.sum("keys"), F.sum("total"), F.max("n1")).first()
    return tuple(int(x or 0) for x in found)


def _count_pairs(texts: DataFrame, model: Model, fan_bits: int, bundle_bytes: int) -> None:
    """Writes the pair shards and what the word shards need of them; sets the model's sums."""
    bits, folder = model.pair_bits, model.folder

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(model)
        for _, tokens, starts in pieces(batches):
            words, place = np.unique(np.append(tokens, START), return_inverse=True)
            numbers = shards.words(words).numbers
            before = _pairs(place[:-1], place[-1], starts)
            pairs, counts = np.unique(numbers[before] << HALF | numbers[place[:-1]], return_counts=True)
            yield _blob_batch(_mixed(pairs), min(bits, fan_bits), pairs, counts)

    def reduce(key: tuple, table: pa.Table) -> pa.Table:
        pairs, counts = merge([unpack(d.as_py()) for d in table["data"]])
        _write_counts(f"{folder}/pairs-{key[0].as_py():08d}", pairs, counts)
        context, starts = np.unique(pairs >> HALF, return_index=True)
        opened = [np.add.reduceat(c, starts) for c in (*((counts == n).astype(np.uint64) for n in (1, 2)), (counts > 2).astype(np.uint64))]
        ended, endings = np.unique(pairs & LOW, return_counts=True)
        numbers, *columns = merge([[context, *opened, np.zeros(len(context), np.uint64)], [ended, *(np.zeros(len(ended), np.uint64),) * 3, endings.astype(np.uint64)]])
        found, data = _blobs(model.turn_number(numbers), min(model.word_bits, fan_bits), numbers, *columns)
        sums = (len(pairs), int(counts.sum()), *_count_columns(counts))
        # The sums of the shard stand in the first row only.
        return pa.table([pa.array(found, pa.int64()), pa.array(data, pa.binary()), *(pa.array([s] + [None] * (len(found) - 1), pa.int64()) for s in sums)], ["shard", "data", *_sums_row(*sums).column_names])

    counted = _cut_further(texts.mapInArrow(count, BLOB), _mixed, bits, fan_bits, bundle_bytes)
    reduced = _scratch.stage(counted.groupBy("shard").applyInArrow(reduce, f"{BLOB}, {SUMS}"), "pairs")

    def reduce_words(key: tuple, table: pa.Table) -> pa.Table:
        numbers, *columns = merge([unpack(d.as_py()) for d in table["data"]])
        shard, place = key[0].as_py(), (numbers & np.uint64((1 << model.place_bits) - 1)).astype(np.int64)
        words = _mapped(f"{folder}/words-{shard:08d}")
        dense = np.zeros((4, int(words[:8].view("<u8")[0])), np.uint32)
        for row, column in zip(dense, columns, strict=True):
            row[place] = column
        with _scratch.CommittedFile(f"{folder}/stats-{shard:08d}") as out:
            out.write(dense.astype("<u4").tobytes())
        ended = columns[3][columns[3] > 0]
        return _sums_row(len(ended), int(ended.sum()), *_count_columns(ended))

    by_word = _cut_further(reduced.select("shard", "data"), model.turn_number, model.word_bits, fan_bits, bundle_bytes)
    ended = _scratch.stage(by_word.groupBy("shard").applyInArrow(reduce_words, SUMS), "stats")
    names = ("keys", "n1", "n2", "n3", "n4")
    pair_types, *pair_n = (int(x or 0) for x in reduced.agg(*(F.sum(c) for c in names)).first())
    ended_types, *ended_n = (int(x or 0) for x in ended.agg(*(F.sum(c) for c in names)).first())
    model.discounts, model.lower, model.pair_types = _discounts(pair_n), _discounts(ended_n), pair_types
    more = ended_types - ended_n[0] - ended_n[1]
    if pair_types:
        model.lower_mass = (model.lower[0] * ended_n[0] + model.lower[1] * ended_n[1] + model.lower[2] * more) / pair_types


def fit(docs: DataFrame, learn: Column, text_col: str = "text", shard_bytes: int = SHARD_BYTES, fan_bits: int = FAN_BITS, bundle_bytes: int = BUNDLE_BYTES) -> Model:
    """Count the texts of the rows where ``learn`` holds and write the model to the shared folder."""
    texts = docs.filter(learn).select(F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pair_bits = max(0, int(np.ceil(np.log2(max(1.0, size / shard_bytes)))))
    model = Model(_scratch.new_path(docs.sparkSession, "kneser-ney"), pair_bits, max(0, pair_bits - 2), 0, 0, 0)
    with _scratch.temporary(docs.sparkSession):
        model.types, model.tokens, largest = _count_words(texts, model, fan_bits, bundle_bytes)
        model.place_bits = max(1, int(largest).bit_length())
        if model.word_bits + model.place_bits > 32:
            raise ValueError(f"{model.types} words need more than 32 bits for their numbers")
        if model.tokens:
            _count_pairs(texts, model, fan_bits, bundle_bytes)
    return model


@dataclass
class Words:
    """Of sorted word keys: numbers, counts, how many pairs of count 1, 2, more each opens, and how many it ends."""

    numbers: np.ndarray
    counts: np.ndarray
    stats: np.ndarray


class Shards:
    """A model's files, mapped when first looked at; the least recently used are let go."""

    def __init__(self, model: Model):
        self.model, self.open = model, OrderedDict()

    def _file(self, kind: str, shard: int):
        name = f"{self.model.folder}/{kind}-{shard:08d}"
        if name not in self.open:
            raw = _mapped(name)
            self.open[name] = raw if raw is None or kind == "stats" else Counts(raw)
            if len(self.open) > MOST_OPEN:
                self.open.popitem(last=False)
        self.open.move_to_end(name)
        return self.open[name]

    def words(self, keys: np.ndarray) -> Words:
        """``keys`` are sorted and distinct; a word that was not learnt has count 0 (and a number of no meaning)."""
        out = Words(*(np.zeros(len(keys), np.uint64) for _ in range(2)), np.zeros((4, len(keys)), np.uint64))
        for shard, (rows,) in _by_shard(shard_of(keys, self.model.word_bits), np.arange(len(keys))):
            table = self._file("words", shard)
            if table is None:
                continue
            hit, at = table.find(keys[rows])
            out.counts[rows[hit]] = table.counts(at)
            out.numbers[rows[hit]] = np.uint64(shard << self.model.place_bits) | at.astype(np.uint64)
            stats = self._file("stats", shard)
            if stats is not None:
                out.stats[:, rows[hit]] = stats.view("<u4").reshape(4, -1)[:, at]
        return out

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct pairs."""
        out = np.zeros(len(keys), np.uint64)
        for shard, (rows,) in _by_shard(shard_of(_mixed(keys), self.model.pair_bits), np.arange(len(keys))):
            table = self._file("pairs", shard)
            if table is not None:
                hit, at = table.find(keys[rows])
                out[rows[hit]] = table.counts(at)
        return out


def _mapped(path: str) -> np.ndarray | None:
    fs, inner = _scratch.file_system(path)
    if not fs.get_file_info(inner).is_file:
        return None
    if fs.type_name == "local":
        return np.memmap(inner, np.uint8, "r")
    with tempfile.NamedTemporaryFile(delete=False) as copy:
        try:
            with fs.open_input_stream(inner, compression=None) as source:
                while data := source.read(1 << 22):
                    copy.write(data)
            copy.flush()
            return np.memmap(copy.name, np.uint8, "r")
        finally:
            os.unlink(copy.name)  # a mapping keeps the content


def _discounted(counts: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *discounts])[np.minimum(counts, 3).astype(np.int64)], 0.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, perplexity) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, d = Shards(model), model.discounts
        base_whole = model.tokens + 0.1 * (model.types + 1)
        for rows, tokens, starts in pieces(batches):
            keys, place = np.unique(np.append(tokens, START), return_inverse=True)
            found = shards.words(keys)
            n1, n2, n3, endings = found.stats.astype(np.float64)
            whole = found.counts.astype(np.float64)
            lower = _discounted(endings, model.lower) / max(1, model.pair_types) + model.lower_mass / (model.types + 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                back = np.where(whole > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / whole, 1.0)
            at = place[:-1]
            before = _pairs(at, place[-1], starts)
            counts = np.zeros(len(at))
            known = np.flatnonzero((whole[before] > 0) & (whole[at] > 0))
            distinct, pair_at = np.unique(found.numbers[before[known]] << HALF | found.numbers[at[known]], return_inverse=True)
            counts[known] = _discounted(shards.pairs(distinct).astype(np.float64), d)[pair_at]
            direct = np.divide(counts, whole[before], out=np.zeros(len(at)), where=whole[before] > 0)
            logs = np.log10(direct + back[before] * lower[at])
            base = np.log10((whole + 0.1) / base_whole)[at]
            lengths = np.diff(starts, append=len(at))
            n_known = np.add.reduceat((whole > 0)[at].astype(np.int64), starts)
            base_score, scores = np.add.reduceat(base, starts), np.add.reduceat(logs, starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array(lengths), pa.array(n_known), pa.array(base_score), pa.array(scores), pa.array(10 ** (-scores / lengths))],
                ["id", "n_tokens", "n_known", "base_score", "score", "perplexity"],
            )

    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    return rows.mapInArrow(run, "id long, n_tokens long, n_known long, base_score double, score double, perplexity double")
