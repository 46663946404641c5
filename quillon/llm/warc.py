"""WARC archives: writing, normalising monolithic gzip files, reading back by offset index.

``write_archives`` writes records into archives that are one gzip stream each.
``normalise`` inflates such a stream once, in bounded pieces, rewrites every record as a gzip
member of its own and writes a sidecar with the offset and length of each member, so that
``read_archives`` seeks to records.  Each step is one task per archive; files appear under their names
only when complete.

Of pages with equal payloads (by SHA-1), of at least ``least_bytes``, the one with the smallest
id is a ``response`` and the others are ``revisit`` records without the payload.

Edge cases: a null payload counts as empty; a null url is left out; a null page id is written as
such, counts as larger than all others, and such rows are revisits only of a page with an id;
of repeated rows with the smallest id one is the response; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scratch

PIECE = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "part int, archive string, records long, bytes long"
ROW = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed record; the block is an HTTP response, without its body in a revisit."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Monolithic archives, one per partition; returns their manifest."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    # Only ids and digests take part in the grouping; payloads move once, by id.
    shared = rows.filter(F.octet_length("payload") >= least_bytes).select("id", "digest")
    firsts = shared.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    place = {"none": F.col("id").isNull(), "place": F.coalesce("id", F.lit(0))}
    repeats = shared.join(firsts, "digest").withColumns(place).select("none", "place", "digest", "refers_to").distinct()
    ordered = (
        rows.withColumns(place)
        .join(repeats.hint("merge"), ["none", "place", "digest"], "left")  # brings repeated rows together
        .sortWithinPartitions("none", "place", "digest", "url")
        .select("id", "url", "payload", "digest", "refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part, count, before, packer = TaskContext.get().partitionId(), 0, None, zlib.compressobj(6, zlib.DEFLATED, 31)
        name = f"{folder}/part-{part:06d}.whole.warc.gz"
        with _scratch.CommittedFile(name) as out:
            while first is not None:
                for page_id, url, payload, digest, refers_to in zip(*first.columns, strict=True):
                    key, refers_to = (page_id.as_py(), digest.as_py()), refers_to.as_py()
                    revisit = refers_to is not None and (refers_to != key[0] or key == before)
                    out.write(packer.compress(record(key[0], url.as_py(), payload.as_py().encode(), refers_to, revisit)))
                    before, count = key, count + 1
                first = next(batches, None)
            out.write(packer.flush())
        yield _manifest_row(part, name, count, out.size)

    return _scratch.stage(ordered.mapInArrow(run, MANIFEST), "archives")


def _manifest_row(part: int, name: str, records: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["part", "archive", "records", "bytes"]
    )


class InflatedStream:
    """A gzip stream (of one member or several) inflated once, front to back, in bounded pieces."""

    def __init__(self, source):
        self.source, self.inflater, self.packed, self.held = source, zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        while True:
            packed = self.inflater.unconsumed_tail or self.packed or self.source.read(PIECE)
            self.packed = b""
            if self.inflater.eof:
                packed = self.inflater.unused_data or packed
                if not packed:
                    return False
                self.inflater = zlib.decompressobj(31)
            elif not packed:
                if self.held or self.inflater.unconsumed_tail:
                    raise EOFError("the gzip stream ends early")
                return False
            data = self.inflater.decompress(packed, PIECE)
            if data:
                self.held += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and including ``mark``; None at the end of the stream."""
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held:
                    raise EOFError("the stream ends inside a record")
                return None
        data = bytes(self.held[: found + len(mark)])
        del self.held[: found + len(mark)]
        return data

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self._more():
                raise EOFError("the stream ends inside a record")
            piece = bytes(self.held[:n])
            del self.held[:n]
            n -= len(piece)
            yield piece


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode().rstrip("\r\n").split("\r\n")
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def normalise_stream(source, out) -> Iterator[tuple[str, str, int, int, str]]:
    """Rewrites each record as a member; yields (record id, type, offset, length, digest)."""
    stream, offset = InflatedStream(source), 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        named, packer = fields(head), zlib.compressobj(6, zlib.DEFLATED, 31)
        length = out.write(packer.compress(head))
        for piece in stream.take(int(named["content-length"]) + 4):
            length += out.write(packer.compress(piece))
        length += out.write(packer.flush())
        yield named["warc-record-id"], named["warc-type"], offset, length, named.get("warc-payload-digest", "-")
        offset += length


def normalise(archives: DataFrame) -> DataFrame:
    """One archive of a member per record, and its sidecar, beside each archive of a manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name, count = whole.removesuffix(".whole.warc.gz") + ".warc.gz", 0
                fs, inner = _scratch.file_system(whole)
                with fs.open_input_stream(inner, compression=None) as source, _scratch.CommittedFile(name) as out, _scratch.CommittedFile(name + ".idx") as index:
                    for entry in normalise_stream(source, out):
                        index.write(("\t".join(map(str, entry)) + "\n").encode())
                        count += 1
                yield _manifest_row(part, name, count, out.size)

    return _scratch.stage(_one_task_each(archives).mapInArrow(run, MANIFEST), "members")


def _one_task_each(archives: DataFrame) -> DataFrame:
    """(part, archive) with each archive in a partition of its own, whatever its row's size."""
    return archives.select("part", "archive").repartitionByRange(max(1, archives.count()), "part")


def _page(named: str | None) -> int | None:
    value = (named or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value not in ("", "None") else None


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record, read member by member through the sidecars and checked against the digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split(" ")[0] for part in ROW.split(", ")]
        for batch in batches:
            for name in batch.column(1).to_pylist():
                fs, inner = _scratch.file_system(name)
                rows = []
                with fs.open_input_stream(inner + ".idx", compression=None) as index, fs.open_input_file(inner) as archive:
                    for line in index.read().decode().splitlines():
                        _, _, offset, length, _ = line.split("\t")
                        rows.append(_row(archive.read_at(int(length), int(offset))) + (int(offset), int(length)))
                        if len(rows) == 4096:
                            yield _batch(rows, names)
                            rows = []
                if rows:
                    yield _batch(rows, names)

    return _one_task_each(archives).mapInArrow(run, ROW)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _row(member: bytes) -> tuple:
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    named = fields(head)
    http, _, payload = rest[: int(named["content-length"])].partition(b"\r\n\r\n")
    size, digest = int(fields(http)["content-length"]), named["warc-payload-digest"].removeprefix("sha1:")
    if named["warc-type"] == "response" and (size != len(payload) or digest != base64.b32encode(hashlib.sha1(payload).digest()).decode()):
        raise ValueError(f"payload of {named['warc-record-id']} does not match its digest")
    url = named.get("warc-target-uri")
    url = url if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return _page(named["warc-record-id"]), url, size, digest, named["warc-type"], _page(named.get("warc-refers-to"))
