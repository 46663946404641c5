"""Groups of exact and edited copies: SimHash near-duplicates widened to a five-word Jaccard of 0.8.

Documents whose five-word shingles have close SimHash fingerprints meet first, through the Gray-order
index of ``simhash``: each of its components is a bucket of candidates.  That alone cannot find all
edited copies: at a similarity of 0.8 two fingerprints differ in about ten of 64 bits, and an index
that loses none of these must meet nearly every pair.  So MinHash bands of the same shingles are
buckets too (24 bands of 5: a pair at exactly 0.8 is missed once in 13,000).  Each candidate pair is
confirmed by the exact similarity of the two sets before it becomes a link.

Texts with equal sets are one class and need no candidates.  A class is named by one hash of its set;
where a second hash tells that two sets share a name, they are named anew by both.  In a bucket, members are first compared
with its leader, the member that meets most others over all its buckets.  Those that are then not in
the leader's component are compared with all members of the bucket.  That is done inside tasks,
by exact counts of common shingles, in groups of bounded size: a bucket's members are cut into parts
by hash, and a group holds one part of either side and returns a spanning forest of its links, so
no pair that is not a link is ever a row.

Edge cases: rows are told apart by two hashes of all their columns, never by id, so null and
repeated ids are rows like any other; a null text counts as empty; texts without words are one
class; a text of fewer than five words is one shingle; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _scratch, simhash
from .components import connected_components, spanning_roots

BANDS, ROWS = 24, 5
#: Members, and shingles of all members, of one part of a bucket; columns of a block of counts.
PART_MEMBERS, PART_SHINGLES, BLOCK = 1024, 1_000_000, 2048


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; words as in ``simhash``."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(7)), np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """One hash for each band of the set's MinHash signature."""
    rng = np.random.default_rng(11)
    factor, add = (rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), 4096):
        np.minimum(least, (found[at : at + 4096, None] * (factor | np.uint64(1)) + add).min(axis=0), out=least)
    signed = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(signed)], np.uint64)


def fingerprint(found: np.ndarray) -> np.uint64:
    """SimHash of a set of shingles."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 4096):
        ones += np.unpackbits(found[at : at + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(found), bitorder="little").view("<u8")[0]


def _row_hashes(columns: list[str]) -> list[Column]:
    every = [F.col(c) for c in columns] + [F.col(c).isNull() for c in columns]
    return [F.xxhash64(F.lit(seed), *every).alias(name) for seed, name in ((1, "__h1"), (2, "__h2"))]


def _signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h1, h2, class, second, n, fp, bands) of every row; ``class`` and ``second`` are hashes of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(3)]
            names, seconds = (np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64) for seed in (0, 1))
            sizes = np.array([len(s) for s in sets], np.int64)
            fps = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
            signed = np.concatenate([bands(s) for s in sets]).view(np.int64) if sets else np.zeros(0, np.int64)
            signed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(signed))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(names), pa.array(seconds), pa.array(sizes), pa.array(fps), signed], ["id", "h1", "h2", "class", "second", "n", "fp", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), *_row_hashes(docs.columns), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, h1 long, h2 long, class long, second long, n long, fp long, bands array<long>")


def told_apart(signed: DataFrame) -> DataFrame:
    """``signed`` without ``second``; sets that share a ``class`` are named by both hashes instead."""
    shared = signed.groupBy("class").agg(F.min("second").alias("least"), F.max("second").alias("most")).filter("least <> most").select("class", F.lit(True).alias("shared"))
    shared = _scratch.stage(shared, "copy-shared-names")
    if shared.isEmpty():
        return signed.drop("second")
    name = F.when(F.col("shared"), F.xxhash64("class", "second")).otherwise(F.col("class"))
    renamed = signed.join(shared, "class", "left").withColumn("class", name).drop("shared", "second")
    return _scratch.stage(renamed, "copy-renamed")


def _sets(docs: DataFrame, wanted: DataFrame, signed: DataFrame, text_col: str) -> DataFrame:
    """(class, shingles) of the wanted classes, from one row of each."""
    # One row of each class first: a class of very many copies is added up before it meets its name.
    firsts = signed.groupBy("class").agg(F.min(F.struct("h1", "h2")).alias("r"))
    chosen = firsts.join(wanted, "class").select("class", F.col("r.h1").alias("__h1"), F.col("r.h2").alias("__h2"))
    texts = docs.select(*_row_hashes(docs.columns), F.col(text_col).alias("text")).join(chosen, ["__h1", "__h2"]).select("class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["class", "shingles"])

    # Rows that are equal in every column come once for each of them.
    return texts.mapInArrow(run, "class long, shingles binary").dropDuplicates(["class"])


def _confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = both >= least * (len(a) + len(b) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    of_a, of_b = (sets.select(F.col("class").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    return pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each of ``b``."""
    values = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b)]
    both = np.intersect1d(*values)
    out = np.zeros((len(a), len(b)))
    rows, columns = [], []
    for side, value in zip((a, b), values, strict=True):
        at = np.minimum(np.searchsorted(both, value), max(0, len(both) - 1))
        hit = np.flatnonzero(both[at] == value) if len(both) else np.zeros(0, np.int64)
        order = hit[np.argsort(at[hit], kind="stable")]
        rows.append(np.repeat(np.arange(len(side)), [len(x) for x in side])[order])
        columns.append(at[order])
    for lo in range(0, len(both), BLOCK):
        block = []
        for side, row, column in zip((a, b), rows, columns, strict=True):
            run = slice(*np.searchsorted(column, [lo, lo + BLOCK]))
            matrix = np.zeros((len(side), BLOCK), np.float32)
            matrix[row[run], column[run] - lo] = 1
            block.append(matrix)
        out += block[0] @ block[1].T
    return out


def _in_buckets(members: DataFrame, leaders: DataFrame, parts: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b) of spanning forests of the links between members of a bucket that lie in different components."""
    names = parts.withColumnRenamed("node", "class")
    named = members.join(names, "class", "left").withColumn("part", F.coalesce("component", "class")).drop("component", "meets")
    main = leaders.select("bucket", F.col("leader").alias("class")).join(names, "class", "left").select("bucket", F.coalesce("component", "class").alias("main"))
    placed = named.join(main, "bucket").withColumn("out", F.col("part") != F.col("main"))
    pieces = lambda some: F.greatest(F.ceil(F.count_if(some) / PART_MEMBERS), F.ceil(F.sum(F.when(some, F.col("n"))) / PART_SHINGLES)).cast("int")
    open_buckets = placed.groupBy("bucket").agg(pieces(F.col("out")).alias("outer"), pieces(F.lit(True)).alias("all")).filter("outer > 0")
    placed = _scratch.stage(placed.join(open_buckets, "bucket"), "copy-open")
    cut = lambda c: F.pmod(F.xxhash64("class", F.lit(5)), c).cast("int")
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = placed.filter("out").select("bucket", "class", "part", F.lit(True).alias("outside"), cut("outer").alias("p"), span("all").alias("q"))
    right = placed.select("bucket", "class", "part", F.lit(False).alias("outside"), span("outer").alias("p"), cut("all").alias("q"))
    grouped = left.unionByName(right).join(sets, "class")

    def run(table: pa.Table) -> pa.Table:
        outside = table["outside"].to_numpy()
        found = [np.frombuffer(x.as_py(), np.uint64) for x in table["shingles"]]
        a, b = np.flatnonzero(outside), np.flatnonzero(~outside)
        both, sizes, part = common([found[i] for i in a], [found[j] for j in b]), np.array([len(x) for x in found]), table["part"].to_numpy()
        near = (both >= least * (sizes[a][:, None] + sizes[b][None, :] - both)) & (part[a][:, None] != part[b][None, :])
        i, j = np.nonzero(near)
        name = table["class"].to_numpy()
        root = spanning_roots(len(name), a[i], b[j])
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.table([pa.array(name[at]), pa.array(name[root[at]])], ["a", "b"])

    return grouped.groupBy("bucket", "p", "q").applyInArrow(run, "a long, b long")


def class_links(signed: DataFrame, docs: DataFrame, text_col: str = "text", least: float = 0.8) -> DataFrame:
    """(node, component) over the classes that have a link."""
    classes = signed.filter("n > 0").groupBy("class").agg(*(F.first(c).alias(c) for c in ("n", "fp", "bands")))
    near = _scratch.stage(classes.select("class", "n", "fp"), "copy-fingerprints")
    near = near.join(simhash.components(_scratch.stage(near.select("fp").distinct(), "copy-distinct")), "fp", "left")
    near = near.select("class", "n", F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp")).alias("bucket"))
    members = classes.select("class", "n", F.explode("bands").alias("bucket")).unionByName(near)
    shared = members.groupBy("bucket").agg(F.count("*").alias("met")).filter("met > 1")
    members = _scratch.stage(members.join(shared, "bucket"), "copy-buckets")
    meets = members.groupBy("class").agg(F.sum("met").alias("meets"))
    members = members.drop("met").join(meets, "class")
    leaders = _scratch.stage(members.groupBy("bucket").agg(F.max(F.struct("meets", "class", "n")).alias("l")).select("bucket", F.col("l.class").alias("leader"), F.col("l.n").alias("n_leader")), "copy-leaders")
    sets = _scratch.stage(_sets(docs, meets.select("class"), signed, text_col), "copy-sets")
    sizes_fit = F.least("n", "n_leader") >= least * F.greatest("n", "n_leader")
    pairs = members.join(leaders, "bucket").filter("class <> leader").filter(sizes_fit).select(F.col("class").alias("a"), F.col("leader").alias("b")).distinct()
    links = _scratch.stage(_confirmed(pairs, sets, least), "copy-links")
    parts = connected_components(links)
    return connected_components(links.unionByName(_scratch.stage(_in_buckets(members, leaders, parts, sets, least), "copy-more")))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """One row of each group of copies: that of the smallest id (a null id is the largest)."""
    signed = told_apart(_scratch.stage(_signatures(docs, id_col, text_col), "copy-signatures"))
    parts = class_links(signed, docs, text_col, least).withColumnRenamed("node", "class")
    # The best row of each class, then of each group: a text with very many copies is added up first.
    rows = signed.groupBy("h1", "h2").agg(F.first("id").alias("id"), F.first("class").alias("class"), F.count("*").alias("times"))
    best = lambda table, by: table.groupBy(by).agg(F.min("row").alias("row"))
    of_class = best(rows.select("class", F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2").alias("row")), "class")
    stay = best(of_class.join(parts, "class", "left").withColumn("part", F.coalesce("component", "class")), "part").select(F.col("row.h1").alias("h1"), F.col("row.h2").alias("h2"), F.lit(True).alias("__stays"))
    # Rows to drop, and rows that are there several times and stay once.
    special = rows.select("h1", "h2", "times").join(stay, ["h1", "h2"], "left").filter("__stays is null or times > 1")
    special = _scratch.stage(special.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.coalesce("__stays", F.lit(False)).alias("__stays")), "copy-rows")
    # The row's own columns go in a struct, so that none of their names can clash.
    marked = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), *_row_hashes(docs.columns)).join(special, ["__h1", "__h2"], "left")
    single = marked.filter("__stays is null").select("row.*")
    return single.unionByName(marked.filter("__stays").dropDuplicates(["__h1", "__h2"]).select("row.*"))
