"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation that makes the signs of principal components balanced binary codes is learnt on a
bounded sample.  Every vector is then coded.  Hash tables are windows of the code's bits; a vector is
entered under its own window and under those that differ from it in one bit, so two vectors meet
in a table if their windows differ in at most two.  Windows are wider the more vectors a label
has (by the logarithm of their number), so that buckets do not grow with the table; their number is
the least with which a pair of cosine ``least`` would be missed by all with a probability below
``MISSED`` (``windows``).  Pairs within ``radius`` code bits are compared by the cosine of the original
vectors in double precision.

Buckets hold codes alone.  A pair belongs to one bucket only, which its two codes tell: of the first
table in which they meet.  A first pass over the buckets finds which members have such a partner at
all; only for these the vectors are fetched, and a second pass compares them.

Equal vectors are one class before the search, named by a number of its own.  A bucket with many
classes is cut into parts by hash, and each pair of parts is its own group, so no task holds a whole
hot bucket.  A group returns counts per class and a spanning forest, never all pairs.

``exact=True`` compares all vectors of a label instead, by the same groups and counts.  The result is a
table of the shared folder, which ``_scratch.drop_table(result)`` deletes; all others are deleted at once.

Edge cases: vectors that are null, empty, zero or hold a null or a component that is not finite
link with nothing, as do rows with a null label; vectors of different lengths never link;
repeated rows are each answered and link with each other, whatever their ids (null ones too); an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _scratch
from .components import connected_components, spanning_roots

#: Rows (those with the smallest hashes) on which rotations are fitted, over all lengths of vectors.
FIT_ROWS = 20_000
#: Most tables, and the share of pairs at the threshold that they may all miss.
MOST_TABLES, MISSED = 24, 0.003


def fit_rotation(sample: np.ndarray, bits: int, rounds: int = 50, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection whose signs are the code, from unit vectors."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    view = centred @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(view @ rotation >= 0, 1.0, -1.0).T @ view)
        rotation = vt.T @ u.T
    return mean, axes @ rotation


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    signs = (x - mean) @ projection >= 0
    padded = np.zeros((len(x), 64), bool)
    padded[:, : signs.shape[1]] = signs
    return np.packbits(padded, axis=1, bitorder="little").view("<u8").ravel()


def windows(bits: int, vectors: int, least: float) -> list[int]:
    """Masks of the tables' bits for so many vectors of a label, evenly spaced around the code.

    A code bit of two vectors differs with a probability of their angle over pi.  The share of pairs
    at ``least`` that no window catches is counted on 20,000 drawn patterns of differing bits."""
    rng = np.random.default_rng(11)
    flips = rng.random((20_000, bits)) < np.arccos(least) / np.pi
    upto = np.concatenate([np.zeros((len(flips), 1), int), np.cumsum(np.tile(flips, 2), axis=1)], axis=1)
    width = min(bits, max(8, math.ceil(math.log2(max(2, vectors))) + 4), 26)
    while True:
        caught = upto[:, width : width + bits] - upto[:, :bits] <= 2
        for n in range(1, MOST_TABLES + 1):
            starts = np.unique(np.arange(n) * bits // n)
            if (~caught[:, starts].any(axis=1)).mean() <= MISSED:
                return [sum(1 << ((int(s) + i) % bits) for i in range(width)) for s in starts]
        width -= 1


def _codes(classes: DataFrame, fit_rows: int) -> DataFrame:
    """Adds ``code``.  A rotation is fitted for each length of vector, all from one bounded sample, in
    which a class has its place by its own number."""
    spark = classes.sparkSession
    totals, cells = dict(classes.groupBy("dim").count().collect()), 1 << 30
    fits = {}
    if totals:
        most = max(1, fit_rows // len(totals))
        shares = F.create_map(*(F.lit(x) for dim, n in totals.items() for x in (dim, int(cells * min(1.0, (most + 4 * most**0.5 + 10) / n)))))
        thinned = classes.withColumn("place", F.pmod(F.xxhash64("key"), F.lit(cells))).filter(F.col("place") < shares[F.col("dim")])
        nth = F.row_number().over(Window.partitionBy("dim").orderBy("place", "key"))
        held: dict[int, list] = {}
        for dim, vec in thinned.withColumn("nth", nth).filter(F.col("nth") <= most).select("dim", "vec").collect():
            held.setdefault(dim, []).append(vec)
        fits = {dim: fit_rotation(_unit(np.array(rows).ravel(), dim), min(64, dim)) for dim, rows in held.items()}
    shared = spark.sparkContext.broadcast(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vectors = batch.column("dim").to_numpy(), batch.column("vec")
            codes = np.zeros(batch.num_rows, np.uint64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                codes[rows] = encode(_unit(vectors.take(pa.array(rows)).flatten().to_numpy(), int(dim)), *shared.value[int(dim)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.view(np.int64))], [*batch.schema.names, "code"])

    return classes.mapInArrow(run, "label string, vec array<double>, dim int, id long, copies long, key long, code long")


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = 0.98,
    radius: int = 16,
    part_size: int = 512,
    fit_rows: int = FIT_ROWS,
    exact: bool = False,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, code (null where it links with nothing)."""
    spark = vectors.sparkSession
    return _scratch.staged_in(spark, "vector-links", lambda: _near_vectors(vectors, id_col, vector_col, label_col, least, radius, part_size, fit_rows, exact))


def _near_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, least: float, radius: int, part_size: int, fit_rows: int, exact: bool) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.withColumn("usable", F.coalesce(F.col("label").isNotNull() & finite & F.exists("vec", lambda v: v != 0), F.lit(False)))
    rows = _scratch.stage(rows.withColumn("vec", F.when(F.col("usable"), F.col("vec"))).withColumns({"digest": F.xxhash64("vec"), "second": F.xxhash64(F.lit(1), "label", "vec")}), "vectors")
    # The digest spreads the shuffle; equality is that of the vectors themselves.
    classes = rows.filter("usable").groupBy("label", "digest", "vec").agg(F.min("vec_id").alias("id"), F.first("second").alias("second"), F.count("*").alias("copies"))
    classes = classes.select("label", "vec", "digest", "second", F.size("vec").alias("dim"), F.coalesce("id", F.lit(0)).alias("id"), "copies")
    classes = _scratch.stage(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    coded = _scratch.stage(_codes(classes.drop("digest", "second"), fit_rows), "codes")
    tables, radius = ({}, 64) if exact else (_tables(coded, least), radius)
    screened = _scratch.stage(_screen(_groups(coded.drop("vec"), tables, part_size), tables, radius), "candidates")
    met = screened.join(coded.select("key", "vec"), "key").groupBy("group").agg(
        *(F.first(c).alias(c) for c in ("dim", "slot", "sub", "p", "q")), F.collect_list(F.struct("key", "copies", "code", "part", "vec")).alias("members")
    )
    found = _scratch.stage(_compare(met, least, tables, radius), "links")
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    parts = connected_components(found.filter("root is not null"), "key", "root").withColumnRenamed("node", "key")
    named = coded.select("key", "id", "copies", "code").join(counts, "key", "left").join(parts, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least_id = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least_id, "component").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", "code")
    return (
        rows.select("vec_id", *(F.when(F.col("usable"), F.col(c)).alias(c) for c in ("digest", "second")))
        .join(classes.select("digest", "second", "key").join(named, "key"), ["digest", "second"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
            F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
            "code",
        )
    )


def _tables(coded: DataFrame, least: float) -> dict[int, list[int]]:
    """Windows for each length of vector, by the largest of its labels."""
    sizes = coded.groupBy("dim", "label").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()
    return {r.dim: windows(min(64, r.dim), r.n, least) for r in sizes}


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _entries(masks: list[int]) -> Column:
    """Array of (slot, sub): a code's windows, as they are and with each of their bits turned."""
    out = []
    for slot, mask in enumerate(masks):
        own = F.col("code").bitwiseAND(F.lit(_signed(mask)).cast("long"))
        turned = [own.bitwiseXOR(F.lit(_signed(1 << bit)).cast("long")) for bit in range(64) if mask >> bit & 1]
        out += [F.struct(F.lit(slot).alias("slot"), sub.alias("sub")) for sub in (own, *turned)]
    return F.array(*out)


def _groups(coded: DataFrame, tables: dict[int, list[int]], part_size: int) -> DataFrame:
    """Rows (dim, label, slot, sub, p, q, members): the codes of parts p and q of one bucket; without tables
    a label is one bucket."""
    whole = F.array(F.struct(F.lit(0).alias("slot"), F.lit(0).cast("long").alias("sub")))
    entries = whole
    for dim, masks in tables.items():
        entries = F.when(F.col("dim") == dim, _entries(masks)).otherwise(entries)
    bucket = ["dim", "label", "slot", "sub"]
    entered = coded.select("*", F.inline(entries))
    hot = entered.groupBy(bucket).agg(F.count("*").alias("n")).filter(F.col("n") > part_size).withColumn("parts", F.ceil(F.col("n") / part_size).cast("int")).drop("n")
    entered = entered.join(hot, bucket, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    entered = entered.withColumn("part", F.pmod(F.xxhash64("key", F.lit(3)), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return (
        entered.groupBy(*bucket, F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
        .agg(F.collect_list(F.struct("key", "copies", "code", "part")).alias("members"))
        .filter("size(members) > 1")
    )


def belongs(apart: np.ndarray, codes: np.ndarray, slot: int, sub: int, masks: list[int]) -> np.ndarray:
    """Whether a pair of codes, the first of which is ``codes``, that differ in the bits ``apart`` belongs to this bucket.

    It does not if the windows of an earlier table differ in at most two bits.  In one table two codes
    with equal windows have their own bucket; else theirs is that of the window with the lowest differing
    bit of the smaller code and the other one of the larger."""
    own = np.ones(apart.shape, bool)
    if not masks:
        return own
    for mask in masks[:slot]:
        own &= np.bitwise_count(apart & np.uint64(mask)) > 2
    differ = apart & np.uint64(masks[slot])
    lowest = differ & (~differ + np.uint64(1))
    here = codes & np.uint64(masks[slot])
    there = here ^ differ
    small, large = np.minimum(here, there), np.maximum(here, there)
    return own & (((small & ~differ) | (small & lowest) | (large & differ & ~lowest)) == np.uint64(sub))


def _near(a: np.ndarray, b: np.ndarray, same: bool, codes: np.ndarray, slot: int, sub: int, masks: list[int], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (one of ``a``, one of ``b``) that belong to the bucket and are within ``radius`` bits."""
    step = max(1, (1 << 18) // max(1, len(b)))
    for at in range(0, len(a), step):
        rows = a[at : at + step]
        apart = codes[rows][:, None] ^ codes[b][None, :]
        near = np.bitwise_count(apart) <= radius
        if same:
            near &= rows[:, None] < b[None, :]
        i, j = np.nonzero(near)
        mine = belongs(apart[i, j], codes[rows[i]], slot, sub, masks)
        yield rows[i[mine]], b[j[mine]]


def _bucket(batch: pa.RecordBatch, i: int) -> tuple:
    members = batch.column("members")[i].values
    dim, slot, sub, p, q = (batch.column(c)[i].as_py() for c in ("dim", "slot", "sub", "p", "q"))
    part = members.field("part").to_numpy()
    return members, dim, slot, sub & ((1 << 64) - 1), np.flatnonzero(part == p), np.flatnonzero(part == q), p == q


def _screen(groups: DataFrame, tables: dict[int, list[int]], radius: int) -> DataFrame:
    """(group, dim, slot, sub, p, q, key, copies, code, part): the members of each group that have a partner by their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            kept, chosen, groups = [], [], []
            for i in range(batch.num_rows):
                members, dim, slot, sub, a, b, same = _bucket(batch, i)
                codes, involved = members.field("code").to_numpy().view(np.uint64), np.zeros(len(members), bool)
                for x, y in _near(a, b, same, codes, slot, sub, tables.get(dim, []), radius):
                    involved[x] = involved[y] = True
                at = np.flatnonzero(involved)
                if len(at):
                    number += 1
                    kept.append(members.take(pa.array(at)))
                    chosen += [i] * len(at)
                    groups += [number] * len(at)
            if kept:
                members, rows = pa.concat_arrays(kept), batch.take(pa.array(chosen))
                names, fields = ("dim", "slot", "sub", "p", "q"), ("key", "copies", "code", "part")
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), *(rows.column(c) for c in names), *(members.field(c) for c in fields)], ["group", *names, *fields])

    return groups.mapInArrow(run, "group long, dim int, slot int, sub long, p int, q int, key long, copies long, code long, part int")


def _compare(groups: DataFrame, least: float, tables: dict[int, list[int]], radius: int) -> DataFrame:
    """(key, n, root): what each group adds to a class's links, and its end of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, roots = [], [], []
            for i in range(batch.num_rows):
                members, dim, slot, sub, a, b, same = _bucket(batch, i)
                key, copies, code = (members.field(c).to_numpy() for c in ("key", "copies", "code"))
                vec = members.field("vec").flatten().to_numpy().reshape(-1, dim)
                norms = np.linalg.norm(vec, axis=1)
                linked = []
                for x, y in _near(a, b, same, code.view(np.uint64), slot, sub, tables.get(dim, []), radius):
                    for lo in range(0, len(x), 1 << 15):
                        u, v = x[lo : lo + (1 << 15)], y[lo : lo + (1 << 15)]
                        keep = np.einsum("ij,ij->i", vec[u], vec[v]) / (norms[u] * norms[v]) >= least
                        linked.append((u[keep], v[keep]))
                x, y = (np.concatenate(side) for side in zip(*linked, strict=True)) if linked else (np.zeros(0, np.int64),) * 2
                if len(x):
                    n = np.bincount(x, copies[y], len(key)) + np.bincount(y, copies[x], len(key))
                    root = spanning_roots(len(key), x, y)
                    at = np.flatnonzero(n)
                    keys.append(key[at])
                    counts.append(n[at].astype(np.int64))
                    roots.append(key[root[at]])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, counts, roots)], ["key", "n", "root"])

    return groups.mapInArrow(run, "key long, n long, root long")
