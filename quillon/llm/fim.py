"""Fill-in-middle transformation by rank and select over packed boundary bits.

A text is cut into units (leading whitespace with the word after it; whitespace at the end is a
unit of its own).  As whitespace is ASCII, the ends of units are found on the UTF-8 bytes: bit i is
one where byte i ends a unit.  The bits of a run of texts are packed into 64-bit words with a
directory of the ones before each block of words.  The ones inside a text are its number of units;
two ranks drawn from the document's hash become byte cuts by ``select``; code points of the parts
are ranks in a second vector that marks the first byte of each.

The form is chosen by column expressions and so is the way back (``restored``): a text that holds
a marker stays plain, so each marker stands once in an output.

Edge cases: a null text counts as empty and is plain; a null id is hashed as an empty id; repeated
rows are each answered, rows of one id are cut at the same hashes; texts are cut whole, a very long one
in a block of its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text whose bits are packed together (a longer text is a block of its own).
BLOCK = 4_000_000
#: 64-bit words a directory entry.
BLOCK_WORDS = 8


class BitVector:
    """Packed bits with the number of ones before each block of words."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        whole = np.zeros((len(packed) // (8 * BLOCK_WORDS) + 1) * 8 * BLOCK_WORDS, np.uint8)
        whole[: len(packed)] = packed
        self.words = whole.view("<u8").reshape(-1, BLOCK_WORDS)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block, word, bit = at // (64 * BLOCK_WORDS), at // 64 % BLOCK_WORDS, (at % 64).astype(np.uint64)
        counts = np.bitwise_count(self.words[block])
        earlier = np.where(np.arange(BLOCK_WORDS) < word[:, None], counts, 0).sum(axis=1, dtype=np.int64)
        inside = np.bitwise_count(self.words[block, word] & ((np.uint64(1) << bit) - np.uint64(1)))
        return self.before[block] + earlier + inside

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Position of each one, counted from zero."""
        block = np.searchsorted(self.before, nth, side="right") - 1
        rest = nth - self.before[block]
        upto = np.cumsum(np.bitwise_count(self.words[block]), axis=1, dtype=np.int64)
        word = (upto <= rest[:, None]).sum(axis=1)
        rest -= np.where(word > 0, upto[np.arange(len(word)), word - 1], 0)
        bits = self.words[block, word][:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)
        bit = (np.cumsum(bits, axis=1, dtype=np.int64) <= rest[:, None]).sum(axis=1)
        return (block * BLOCK_WORDS + word) * 64 + bit


def unit_ends(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each byte of some texts, one after another, ends a unit; ``ends`` are those of the texts."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    bits = np.zeros(len(data), bool)
    bits[:-1] = ~space[:-1] & space[1:]
    filled = ends[np.diff(ends, prepend=0) > 0]
    bits[filled - 1] = True
    return bits


def _cut(texts: list[bytes], forms: list[str], first: np.ndarray, second: np.ndarray):
    """Units, outputs and code points of prefix and middle for each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    whole = b"".join(texts)
    data = np.frombuffer(whole, np.uint8)
    units = BitVector(unit_ends(data, ends))
    opened = units.rank(starts)
    n = units.rank(ends) - opened
    a, b = first % (n + 1), second % (n + 1)
    cuts = []
    for rank in (np.minimum(a, b), np.maximum(a, b)):
        at = starts.copy()
        inner = np.flatnonzero(rank > 0)
        at[inner] = units.select(opened[inner] + rank[inner] - 1) + 1
        cuts.append(at)
    chars = BitVector((data & 0xC0) != 0x80)
    at_start, at_first, at_second = (chars.rank(at) for at in (starts, *cuts))
    prefix, suffix, middle = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    outputs = []
    for text, form, lo, i, j in zip(texts, forms, starts.tolist(), *(c.tolist() for c in cuts), strict=True):
        i, j = i - lo, j - lo
        if form == "plain":
            outputs.append(text)
        elif form == "psm":
            outputs.append(b"".join((prefix, text[:i], suffix, text[j:], middle, text[i:j])))
        else:
            outputs.append(b"".join((suffix, text[j:], prefix, text[:i], middle, text[i:j])))
    return n, outputs, at_first - at_start, at_second - at_first


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    for batch in batches:
        texts, forms = batch.column("text").to_pylist(), batch.column("form").to_pylist()
        first, second = (batch.column(c).to_numpy() for c in ("h1", "h2"))
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= BLOCK):
                held += len(texts[end])
                end += 1
            rows = slice(at, end)
            n, outputs, before, inside = _cut(texts[rows], forms[rows], first[rows], second[rows])
            plain = np.array([f == "plain" for f in forms[rows]], bool)
            columns = [batch.column("doc_id")[at:end], pa.array(n), batch.column("form")[at:end], pa.array(before, mask=plain), pa.array(inside, mask=plain)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(outputs, pa.binary())], names)
            at = end


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document.

    Of the texts that can be cut, ``percent`` are; of these ``spm_percent`` put the suffix first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = lambda i: F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("digest"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (h(2) % 100 >= percent), "plain").when(h(3) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"), h(0).alias("h1"), h(1).alias("h2"), form.alias("form"))
    kind = dict(rows.dtypes)["doc_id"]
    found = rows.mapInArrow(_run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
