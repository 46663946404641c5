"""Token ids in seekable Zstandard files.

Documents are range-partitioned and sorted by id; each partition writes one file of

* independent Zstandard frames (with content size and checksum), each holding whole documents:
  count, ids, null flags, token counts, then the token ids as little-endian 32-bit numbers;
* a skippable frame with the document index: first id, documents and tokens of each frame;
* a trailing seek table in the published seekable layout: compressed size, decompressed size
  and checksum (low half of XXH64 of the content) of every frame, so a reader seeks to the
  frames that hold the documents it wants and decompresses nothing else.

A file appears under its name only when complete, and a repeated task writes the same bytes.

Texts are cut into the tokenizer's own pieces and the ids of pieces are kept in a bounded
per-process table, so each distinct piece is encoded once or a few times; the ids equal those
of encoding the text whole.  With ``added`` that holds for the tokenizer's added tokens too:
texts that contain one are encoded by the tokenizer itself, without special tokens at the ends.
Without it their characters are ordinary text.

Edge cases: a null or empty text has the end id alone; null ids sort first and are read back
as null; rows of one id are in the order of their texts, over as many files as they need; repeated
rows are all written; very long texts are a frame of their own; an empty table writes no file and
reads back empty; columns other than the two named are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _scratch

#: Fixed values of the Zstandard seekable layout.
SKIPPABLE, SEEK_TABLE, SEEK_FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
INDEX_ENTRY, SEEK_ENTRY = struct.Struct("<q?QQ"), struct.Struct("<III")
MANIFEST = "part int, file string, docs long, tokens long, frames long"

# Texts of these characters alone are cut by ``re`` with the classes written out; others by ``regex``.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[^\x00-\x7f{_LETTERS}]")
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\t-\r {_LETTERS}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


class PieceEncoder:
    """Byte-level BPE ids of whole texts, as bytes of little-endian 32-bit numbers."""

    def __init__(self, path: str, pattern: str, added: bool = False, most: int = 700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        # The model itself, on pieces in its alphabet: one printable character for each byte.
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        others = [b for b in range(256) if b not in plain]
        self.alphabet = [chr(256 + others.index(b)) if b in others else chr(b) for b in range(256)]
        self.slow, self.most, self.known = regex.compile(pattern), most, {}

    def encode(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(found)}I", *found)
        pieces = (self.slow if _PLAIN.search(text) else _FAST).findall(text)
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            pass
        if len(self.known) > self.most:
            self.known.clear()
        for piece in pieces:
            if piece not in self.known:
                simple = piece.isascii() and piece.isprintable()
                found = self.model.tokenize(piece.replace(" ", self.alphabet[32]) if simple else "".join([self.alphabet[b] for b in piece.encode()]))
                self.known[piece] = struct.pack(f"<{len(found)}I", *(t.id for t in found))
        return b"".join(map(self.known.__getitem__, pieces))


_ENCODERS: dict[tuple[str, str, bool], PieceEncoder] = {}


def _encoder(path: str, pattern: str, added: bool) -> PieceEncoder:
    """One per worker process, kept over tasks."""
    if (path, pattern, added) not in _ENCODERS:
        _ENCODERS[path, pattern, added] = PieceEncoder(path, pattern, added)
    return _ENCODERS[path, pattern, added]


class SeekableWriter:
    """Writes documents as frames of about ``frame_bytes`` of content."""

    def __init__(self, out, frame_bytes: int = 1 << 20, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.seek, self.index, self.docs, self.tokens = [], [], 0, 0
        self._clear()

    def _clear(self) -> None:
        self.ids, self.counts, self.parts, self.held = [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.parts.append(ids)
        self.held += len(ids) + 17
        if self.held >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.ids:
            return
        n = len(self.ids)
        head = [
            struct.pack("<I", n),
            np.array([0 if i is None else i for i in self.ids], "<i8").tobytes(),
            bytes(i is None for i in self.ids),
            np.array(self.counts, "<u8").tobytes(),
        ]
        content = b"".join(head + self.parts)
        frame = self.compressor.compress(content)
        self.out.write(frame)
        self.seek.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.index.append((self.ids[0] or 0, self.ids[0] is None, n, sum(self.counts)))
        self.docs += n
        self.tokens += sum(self.counts)
        self._clear()

    def close(self) -> None:
        self._flush()
        index = b"".join(INDEX_ENTRY.pack(*entry) for entry in self.index)
        self.out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        entries = [*self.seek, (len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        table = b"".join(SEEK_ENTRY.pack(*entry) for entry in entries) + struct.pack("<IBI", len(entries), 0x80, SEEK_FOOTER)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(table)) + table)


class SeekableReader:
    """Reads a file by its seek table; checks each frame that it decompresses."""

    def __init__(self, path: str):
        fs, inner = _scratch.file_system(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_FOOTER or not flags & 0x80:
            raise ValueError(f"no seek table with checksums at the end of {path}")
        table = self.file.read_at(n * SEEK_ENTRY.size, size - 9 - n * SEEK_ENTRY.size)
        self.seek = list(SEEK_ENTRY.iter_unpack(table))
        self.offsets = np.concatenate([[0], np.cumsum([e[0] for e in self.seek])]).tolist()
        self.index = list(INDEX_ENTRY.iter_unpack(self.file.read_at(self.seek[-1][0] - 8, self.offsets[-2] + 8)))
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> list[tuple[int | None, np.ndarray]]:
        compressed, size, checksum = self.seek[i]
        content = self.decompressor.decompress(self.file.read_at(compressed, self.offsets[i]), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} is damaged")
        (n,) = struct.unpack_from("<I", content)
        ids = np.frombuffer(content, "<i8", n, 4).tolist()
        null, counts = content[4 + 8 * n : 4 + 9 * n], np.frombuffer(content, "<u8", n, 4 + 9 * n).astype(np.int64)
        tokens, ends = np.frombuffer(content, "<u4", offset=4 + 17 * n), np.cumsum(counts)
        return [(None if null[k] else ids[k], tokens[ends[k] - counts[k] : ends[k]]) for k in range(n)]

    def documents(self, doc_id: int) -> list[np.ndarray]:
        """Token ids of every document with that id; only frames that may hold it are read."""
        firsts = [-(1 << 63) - 1 if null else first for first, null, _, _ in self.index]
        return [
            tokens
            for i, first in enumerate(firsts)
            if first <= doc_id and (i + 1 == len(firsts) or firsts[i + 1] >= doc_id)
            for found, tokens in self.frame(i)
            if found == doc_id
        ]

    def close(self) -> None:
        self.file.close()


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    pattern: str,
    end_id: int | None = None,
    frame_bytes: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    added: bool = False,
) -> DataFrame:
    """Encode and write; returns the manifest (one row per file, parts in ascending order of id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        encoder, part = _encoder(tokenizer, pattern, added), TaskContext.get().partitionId()
        name, end = f"{folder}/part-{part:06d}.ids.zst", b"" if end_id is None else struct.pack("<I", end_id)
        with _scratch.CommittedFile(name) as out:
            writer = SeekableWriter(out, frame_bytes)
            while first is not None:
                for doc_id, text in zip(first.column(0).to_pylist(), first.column(1), strict=True):
                    writer.add(doc_id, encoder.encode(text.as_py() or "") + end)
                first = next(batches, None)
            writer.close()
        row = ([part], [name], [writer.docs], [writer.tokens], [len(writer.seek)])
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), *(pa.int64(),) * 3), strict=True)], ["part", "file", "docs", "tokens", "frames"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Rows of one id (a null id may be many rows') are dealt on by the beginnings of their texts.
    begins = F.substring("text", 1, 32)
    ordered = rows.repartitionByRange("id", begins).sortWithinPartitions("id", "text")
    return _scratch.stage(ordered.mapInArrow(run, MANIFEST), "manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the files of a manifest."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("part", "file", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("start"))
    # A partition for each file: its row is small, its work is not.
    files = _scratch.stage(files, "starts").repartitionByRange(max(1, manifest.count()), "part").select("file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = SeekableReader(name)
                for i in range(len(reader.index)):
                    found = reader.frame(i)
                    counts = np.array([len(t) for _, t in found], np.int64)
                    starts = start + np.cumsum(counts) - counts
                    start += int(counts.sum())
                    crcs = [zlib.crc32(t.tobytes()) for _, t in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d for d, _ in found], pa.int64()), pa.array(starts), pa.array(counts), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                reader.close()

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
