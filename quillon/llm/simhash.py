"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are made in Arrow batches.  Distinct fingerprints are then held in an index of
three levels, each node of which stores the bits that all its members share (mask, bits):

* the root's children share the bits of one mask.  The 64 bits are cut into ``k + spare`` blocks;
  a mask is a choice of ``spare`` of these.  Two fingerprints that differ in at most ``k`` bits
  agree in at least ``spare`` whole blocks, so in all bits of at least one mask;
* under each, members are sorted by Gray rank and cut into nodes of ``node_size``;
* under each node, runs of ``leaf_size`` neighbours in that order.

From level to level only the bits that the next level's members newly share are compared and
added to the differences found above; where these exceed ``k``, all that is below is skipped.

``spare`` follows the fingerprints: the members of each child of the root are counted, and while
the pairs inside the children would outweigh the entries that one more spare block costs, there
is one more.  Every choice finds the same links.

Fingerprints are range-partitioned by (mask, shared bits, Gray rank) and each partition cuts its
own run into nodes, so no task holds a whole child of the root.  Nodes meet by an equi-join on the
shared bits, salted where a child has many; each pair of nodes returns a spanning forest of its
links, never all pairs.

Edge cases: a null text counts as empty; a text without words has fingerprint zero, which
links like any other; repeated rows are kept and get equal fingerprints; a null ``doc_id``
is never a component's name unless no other id is there (then the component is null); an
empty table gives an empty result; columns other than the two named are not read.

``near_duplicates`` returns a table of the shared folder, which ``_scratch.drop_table(result)`` deletes; its
working tables are deleted at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scratch
from .components import connected_components, spanning_roots

BITS = 64
#: Pairs of fingerprints that cost as much as one entry in the index, and the most spare blocks.
PAIRS_AN_ENTRY, MOST_SPARE = 1000, 4
#: Nodes of one child of the root that meet in one group.
NODES_A_GROUP = 256


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over word shingles; words are runs without ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.dtype("<u8"))
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(bits), 4096):
        ones += bits[at : at + 4096].sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): one row per document, fp as the signed long of the same 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def masks(k: int, spare: int = 1) -> list[int]:
    """Masks (unsigned) of which two fingerprints that differ in at most ``k`` bits share at least one:
    every choice of ``spare`` of ``k + spare`` blocks."""
    edges = [BITS * i // (k + spare) for i in range(k + spare + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, spare)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def gray_rank(fp) -> F.Column:
    """Position of a fingerprint in the reflected Gray sequence, shifted so that longs sort as unsigned."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << (BITS - 1))))


def _entered(fps: DataFrame, found: list[int]) -> DataFrame:
    """(fp, mask, shared): each fingerprint once under each mask, with the bits that the mask keeps."""
    return fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in found))).alias("mask", "shared"))


def spare_blocks(fps: DataFrame, k: int, most: int = MOST_SPARE, pairs_an_entry: int = PAIRS_AN_ENTRY) -> int:
    """The fewest spare blocks for which the pairs inside the root's children cost no more than the
    entries that one more spare block would add."""
    for spare in range(1, most):
        sizes = _entered(fps, masks(k, spare)).groupBy("mask", "shared").agg(F.count("*").cast("double").alias("n"))
        pairs, entries = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
        if pairs / pairs_an_entry <= entries * (comb(k + spare + 1, spare + 1) / comb(k + spare, spare) - 1):
            return spare
    return most


NODE = "mask int, shared long, node long, fps array<long>, fixed long, bits long"


def _nodes(fps: DataFrame, found: list[int], node_size: int) -> DataFrame:
    """Nodes of the index: members, which bits they share (``fixed``) and these bits.

    A node is named by its first member, which no other node under the same mask and bits holds."""
    ordered = _entered(fps, found).withColumn("rank", gray_rank(F.col("fp")))
    ordered = ordered.repartitionByRange("mask", "shared", "rank").sortWithinPartitions("mask", "shared", "rank").select("mask", "shared", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, opening = None, True
        for batch in batches:
            columns = [batch.column(0).to_numpy().astype(np.int64), *(batch.column(i).to_numpy() for i in (1, 2))]
            held = columns if held is None else [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
            # All but the last child go on; of the last, whole nodes.
            edge = _starts(held[0], held[1])
            done = edge[-1] + (len(held[0]) - edge[-1]) // node_size * node_size
            if done:
                yield _cut([c[:done] for c in held], node_size, opening, done < len(held[0]) and done > edge[-1])
                held, opening = [c[done:] for c in held], done > edge[-1]
        if held is not None and len(held[0]):
            yield _cut(held, node_size, opening, True)

    return ordered.mapInArrow(run, NODE)


def _starts(mask: np.ndarray, shared: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (shared[1:] != shared[:-1])]))


def _cut(columns: list[np.ndarray], node_size: int, keep_first: bool, keep_last: bool) -> pa.RecordBatch:
    """Nodes of a run of sorted members.  A child of one member needs no node, unless the run may
    hold only a part of it (the first or last of a partition)."""
    mask, shared, fp = columns
    child = _starts(mask, shared)
    sizes = np.diff(child, append=len(fp))
    kept = sizes > 1
    kept[0] |= keep_first
    kept[-1] |= keep_last
    pieces = -(-sizes[kept] // node_size)
    starts = np.repeat(child[kept], pieces) + node_size * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    ends = np.minimum(starts + node_size, np.repeat(child[kept] + sizes[kept], pieces))
    lengths = ends - starts
    members = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    value = fp[members]
    both, either = (f.reduceat(value, offsets[:-1]) if len(starts) else value for f in (np.bitwise_and, np.bitwise_or))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value))
    return pa.RecordBatch.from_arrays([pa.array(mask[starts], pa.int32()), pa.array(shared[starts]), pa.array(fp[starts]), lists, pa.array(~(both ^ either)), pa.array(both)], ["mask", "shared", "node", "fps", "fixed", "bits"])


def links(fps: DataFrame, k: int = 4, node_size: int = 1024, leaf_size: int = 16, spare: int | None = None) -> DataFrame:
    """(a, b) of a spanning forest of all pairs of the distinct ``fp`` that differ in at most ``k`` bits.

    ``fps`` is read several times: give a table that is written."""
    spare = spare_blocks(fps, k) if spare is None else spare
    found = masks(k, spare)
    nodes = _scratch.stage(_nodes(fps, found, node_size), "nodes")
    child = ["mask", "shared"]
    many = nodes.groupBy(child).agg(F.count("*").alias("n")).filter(F.col("n") > NODES_A_GROUP).select(*child, F.ceil(F.col("n") / NODES_A_GROUP).cast("int").alias("salts"))
    salted = nodes.join(many, child, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    side = lambda of, name, salt: of.select(*child, salt.alias("salt"), *(F.col(c).alias(f"{c}_{name}") for c in ("node", "fps", "fixed", "bits")))
    left = side(salted, "a", F.pmod(F.xxhash64("node"), "salts").cast("int"))
    right = side(salted, "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    apart = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b")).bitwiseAND(F.col("fixed_a")).bitwiseAND(F.col("fixed_b")))
    met = left.join(right, [*child, "salt"]).filter("node_a <= node_b").withColumn("apart", apart).filter(F.col("apart") <= k)
    met = met.filter("node_a < node_b or size(fps_a) > 1").select(
        "mask", (F.col("node_a") == F.col("node_b")).alias("same"), "apart", F.col("fixed_a").bitwiseAND(F.col("fixed_b")).alias("fixed"), "fps_a", "fps_b"
    )
    unsigned = np.array(found, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forests = []
            mask, same, apart, fixed = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for i in range(batch.num_rows):
                a = batch.column(4)[i].values.to_numpy().view(np.uint64)
                b = a if same[i] else batch.column(5)[i].values.to_numpy().view(np.uint64)
                pairs = _pairs(a, b, bool(same[i]), unsigned[: int(mask[i])], k, leaf_size, int(apart[i]), fixed.view(np.uint64)[i])
                forests.append(_forest(a, b, bool(same[i]), *pairs))
            a, b = (np.concatenate([f[j] for f in forests]).view(np.int64) for j in (0, 1)) if forests else (np.array([], np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def _leaves(x: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the leaves, the bits their members share and the mask of these."""
    starts = np.arange(0, len(x), leaf)
    both, either = np.bitwise_and.reduceat(x, starts), np.bitwise_or.reduceat(x, starts)
    return starts, both, ~(both ^ either)


def _pairs(
    a: np.ndarray, b: np.ndarray, same: bool, earlier: np.ndarray, k: int, leaf: int, apart: int = 0, fixed: np.uint64 = np.uint64(0)
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that differ in 1 to k bits and share no earlier mask (those are met there).

    ``apart`` differences were found above, among the ``fixed`` bits; each level adds its own."""
    starts_a, bits_a, mask_a = _leaves(a, leaf)
    starts_b, bits_b, mask_b = (starts_a, bits_a, mask_a) if same else _leaves(b, leaf)
    shared = mask_a[:, None] & mask_b[None, :] | fixed
    above = apart + np.bitwise_count((bits_a[:, None] ^ bits_b[None, :]) & shared & ~fixed)
    p, q = np.nonzero(above <= k)
    if same:
        p, q = p[p <= q], q[p <= q]
    out_i, out_j = [], []
    step = max(1, (1 << 20) // (leaf * leaf))
    for at in range(0, len(p), step):
        i = starts_a[p[at : at + step], None] + np.arange(leaf)
        j = starts_b[q[at : at + step], None] + np.arange(leaf)
        cells = p[at : at + step], q[at : at + step]
        x = a[np.minimum(i, len(a) - 1)][:, :, None] ^ b[np.minimum(j, len(b) - 1)][:, None, :]
        near = above[cells][:, None, None] + np.bitwise_count(x & ~shared[cells][:, None, None]) <= k
        near &= (x != 0) & (i < len(a))[:, :, None] & (j < len(b))[:, None, :]
        if same:
            near &= i[:, :, None] < j[:, None, :]
        n, r, c = np.nonzero(near)
        x, i, j = x[n, r, c], i[n, r], j[n, c]
        new = np.ones(len(x), bool)
        for mask in earlier:
            new &= (x & mask) != 0
        out_i.append(i[new])
        out_j.append(j[new])
    none = np.array([], np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (none, none)


def _forest(a: np.ndarray, b: np.ndarray, same: bool, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each member that has a link, with the member that names its component among these pairs."""
    if not len(i):
        return a[:0], a[:0]
    values = a if same else np.concatenate([a, b])
    root = spanning_roots(len(values), i, j if same else j + len(a))
    touched = np.flatnonzero(root != np.arange(len(root)))
    return values[touched], values[root[touched]]


def components(classes: DataFrame, k: int = 4) -> DataFrame:
    """(fp, component) of the distinct ``fp`` of a written table that have a link."""
    return connected_components(links(classes.select("fp"), k)).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id): links run between fingerprints that differ in at most
    ``k`` bits; ``component_id`` is the smallest id reachable over links."""
    return _scratch.staged_in(docs.sparkSession, "fingerprint-components", lambda: _near_duplicates(docs, id_col, text_col, k, width, seed))


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, k: int, width: int, seed: int) -> DataFrame:
    of_doc = _scratch.stage(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    classes = _scratch.stage(of_doc.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    named = classes.join(components(classes, k), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = named.join(least, "component").select("fp", "component_id")
    return of_doc.join(names, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
