"""Mixing sources to target weights, with DataFrame operations only.

Documents get hash-random keys.  Documents of one source, id and size are one group with a count, so
a null or repeated id is one group for each size, however many rows it has.  Within a source the keys
are cut into ranges of bounded size (so a source with a third of all rows is many ranges), tokens are
summed before each group inside its range, and range totals summed over the ranges give the prefix
over the whole source.  Each source's budget is then cut exactly at its prefix sum: whole epochs
first, then the groups before the cut, whole rows of the group that the cut falls in, and the
first words of one row.

The table of sources is ordered by ranges too: no task holds all sources.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; a
null id is a key of its own; repeated rows each take part; a source whose documents are all
empty has target 0; an empty table gives an empty result; very long texts are counted whole; other
columns are not read by ``mix`` and are kept by ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Source tables up to this many rows are sent to every executor; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _before(rows: DataFrame, order: Sequence[Column | str], **sums: Column) -> DataFrame:
    """Adds, for each name, the sum of its column over the rows that come earlier in a total order.
    Rows are range-partitioned and written, so that a row's partition stays the same; sums run inside
    the partitions and over the partitions' totals."""
    parts = _scratch.stage(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = parts.groupBy("__part").agg(*(F.sum(c).alias(name) for name, c in sums.items()))
    totals = totals.select("__part", *(zero(F.sum(name).over(earlier)).alias(f"__{name}") for name in sums))
    found = parts.withColumns({name: zero(F.sum(c).over(inside)) for name, c in sums.items()}).join(totals, "__part")
    return found.withColumns({name: F.col(name) + F.col(f"__{name}") for name in sums}).drop("__part", *(f"__{name}" for name in sums))


def targets(sources: DataFrame, weights: Sequence[float], share: float, most_epochs: float) -> DataFrame:
    """Adds ``target`` to rows of (source, source_size): ``share`` of all sizes dealt by weight, each
    at most ``most_epochs`` times its size, the excess dealt again by weight among the others.

    In the order of size over weight the sources that reach their limit come first, so the level
    at which none is above follows from prefix sums over this table of one row a source.
    """
    nth = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    table = _before(sources, [F.col("source").isNull(), F.col("source")], place=F.lit(1)).withColumn("weight", nth)
    table = table.withColumn("limit", (most_epochs * F.col("source_size")).cast("double"))
    table = _before(table, [F.col("limit") / F.col("weight"), F.col("place")], limits=F.col("limit"), lighter=F.col("weight"))
    whole = F.broadcast(table.agg((share * F.sum("source_size")).alias("total"), F.sum("weight").alias("weights")))
    level = (F.col("total") - F.col("limits")) / (F.col("weights") - F.col("lighter"))
    table = table.crossJoin(whole).withColumn("full", level * F.col("weight") >= F.col("limit"))
    sums = table.agg(F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).alias("spent"), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).alias("open"))
    dealt = F.col("weight") * ((F.col("total") - F.col("spent")) / F.col("open"))
    return table.crossJoin(F.broadcast(sums)).withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(dealt)).select(*sources.columns, "weight", "target")


def _sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> list[Column]:
    doc_id = F.col(id_col)
    return [
        doc_id.alias("doc_id"),
        F.col(source_col).alias("source"),
        _source_key(F.col(source_col)).alias("source_key"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")).alias("key"),
    ]


GROUP = ("source_key", "key", "size")


def _cuts(sized: DataFrame, weights: Sequence[float], share: float, most_epochs: float, rows_per_range: int) -> DataFrame:
    """One row for each group of ``sized``: its rows, its source's size and target, whole epochs, and the
    words that the last, broken epoch takes of the group."""
    groups = _scratch.stage(sized.groupBy(*GROUP).agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.count("*").alias("rows")), "groups")
    sources = groups.groupBy("source_key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    plan = _scratch.stage(targets(sources, weights, share, most_epochs).drop("source", "weight"), "targets")
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    words = F.col("size") * F.col("rows")
    ranged = groups.join(plan, "source_key").withColumn("range", F.floor(place * F.ceil(F.col("n") / rows_per_range)))
    sums = ranged.groupBy("source_key", "range").agg(F.sum(words).alias("range_size"))
    sums = _before(sums, ["source_key", "range"], all_before=F.col("range_size"))
    # Sums ran over all sources: what came before a source's first range is taken off again.
    first = sums.groupBy("source_key").agg(F.min("all_before").alias("before_source"))
    sums = sums.join(first, "source_key").select("source_key", "range", (F.col("all_before") - F.col("before_source")).alias("before_range"))
    inside = Window.partitionBy("source_key", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - F.col("epochs") * F.col("source_size") - F.col("before_range") - F.col("before")
    return (
        ranged.withColumn("before", F.coalesce(F.sum(words).over(inside), F.lit(0)))
        .join(sums, ["source_key", "range"])
        .withColumn("epochs", epochs)
        .withColumn("broken", F.least(words, F.greatest(F.lit(0), left)))
        .select(*GROUP, "doc_id", "source", "rows", "source_size", "target", "epochs", "broken")
    )


def _cut_of(k: Column) -> Column:
    """Words of the broken epoch that the k-th row of a group gives."""
    return F.least(F.col("size"), F.greatest(F.lit(0), F.col("broken") - k * F.col("size")))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most_epochs: float = 2.0,
    seed: int = 17,
    rows_per_range: int = 2_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, epochs, cut): ``taken`` words of the document
    enter the mix, as ``epochs`` whole copies and one of its first ``cut`` words."""
    sized = _scratch.stage(docs.select(*_sized(docs, seed, id_col, text_col, source_col)), "sizes")
    cuts = _cuts(sized, weights, share, most_epochs, rows_per_range)
    rows = cuts.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("cut", _cut_of(F.col("k")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"), "epochs", "cut")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it is."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++)"), F.lit(1)), F.lit(1), n.cast("int")), "")


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most_epochs: float = 2.0,
    seed: int = 17,
    rows_per_range: int = 2_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: one row for each whole copy of a document and one for a cut copy, with all
    columns of ``docs``.

    Rows are written once with a number of their own, so each meets its own cut whatever its id.  Of
    rows that share source, id and size, those with the smaller numbers come first; only in the
    groups that a cut falls in are they told apart, by counts over the written files' parts."""
    numbered = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), *_sized(docs, seed, id_col, text_col, source_col))
    rows = _scratch.stage(numbered.withColumn("number", F.monotonically_increasing_id()), "rows")
    cuts = _scratch.stage(_cuts(rows.select("doc_id", "source", *GROUP), weights, share, most_epochs, rows_per_range).select(*GROUP, "rows", "epochs", "broken"), "cuts")
    straddled = cuts.filter("broken > 0 and broken < size * rows and rows > 1").select(*GROUP)
    part = F.shiftright("number", 33)
    few = rows.select(*GROUP, "number", part.alias("part")).join(F.broadcast(straddled) if straddled.count() <= BROADCAST_ROWS else straddled, list(GROUP))
    counts = few.groupBy(*GROUP, "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("earlier", F.coalesce(F.sum("n").over(Window.partitionBy(*GROUP).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*GROUP, "part").orderBy("number")) - 1
    places = few.withColumn("k", inside).join(counts.drop("n"), [*GROUP, "part"]).select("number", (F.col("k") + F.col("earlier")).alias("k"))
    met = rows.drop("doc_id", "source").join(cuts, list(GROUP)).filter("epochs > 0 or broken > 0").join(places, "number", "left")
    # Rows without a place are of groups that are taken whole or not at all, or alone in theirs.
    cut = F.when(F.col("k").isNotNull(), _cut_of(F.col("k"))).when(F.col("rows") == 1, F.col("broken")).when(F.col("broken") > 0, F.col("size")).otherwise(0)
    whole = F.array_repeat(F.col("size"), F.col("epochs").cast("int"))
    copies = met.select("row", "size", F.explode(F.filter(F.concat(whole, F.array(cut)), lambda w: w > 0)).alias("words"))
    text = F.when(F.col("words") < F.col("size"), first_words(F.col("row")[text_col], F.col("words"))).otherwise(F.col("row")[text_col])
    return copies.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
