"""Records of delimited files whose quoted cells hold line breaks, read by many tasks.

Whether a line starts inside a quoted cell depends on all lines before it.  So each line becomes a
function of that state: what the state is after it, if it starts outside and if it starts inside.
A function of two states is constant, the identity or a swap; along a split the state is that of
the last constant, turned by the swaps since.  Splits are composed the same way over the splits of
their file, and then each split emits its records.  Lines move once, by split; of the records only
the pieces of those that span several splits move again.

A record is what one task can hold; a quote that is never closed makes the rest of its file one
record, as it does for any reader.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = ["file", "split"]


def _patterns(sep: str, quote: str) -> tuple[str, str]:
    """Of lines that end outside, if they start outside and inside.  A quote counts where a cell begins, doubled
    ones are characters, and after the closing one the cell runs on to the separator."""
    s, q = re.escape(sep), re.escape(quote)
    close = rf"(?:[^{q}]++|{q}{q})*+{q}[^{s}]*+"
    cell = rf"(?:[ \t]*+{q}{close}|(?![ \t]*+{q})[^{s}]*+)"
    return rf"^{cell}(?:{s}{cell})*+\z", rf"^{close}(?:{s}{cell})*+\z"


def _lines(spark: SparkSession, path: str, sep: str, quote: str) -> DataFrame:
    """(file, split, at, line, const, swap): ``const`` is the state after the line where it does not depend on
    that before it."""
    outside, inside = _patterns(sep, quote)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"),
        F.regexp_replace("value", "^﻿|\r\\z", "").alias("line"),
    )
    after = lambda pattern: F.when(F.col("line").rlike(pattern), 0).otherwise(1)
    plain = ~F.contains("line", F.lit(quote))
    functions = lines.withColumns({"a": F.when(plain, 0).otherwise(after(outside)), "b": F.when(plain, 1).otherwise(after(inside))})
    return functions.select(*SPLIT, "at", "line", F.when(F.col("a") == F.col("b"), F.col("a")).alias("const"), F.when((F.col("a") == 1) & (F.col("b") == 0), 1).otherwise(0).alias("swap"))


def _state(start: Column | int, last: Column, swaps: Column) -> Column:
    """The state after the functions so far: ``last`` has the last constant and the swaps up to it."""
    start = start if isinstance(start, Column) else F.lit(start)
    return F.when(last.isNotNull(), F.pmod(last["const"] + swaps - last["swaps"], F.lit(2))).otherwise(F.pmod(start + swaps, F.lit(2))).cast("int")


def read_records(spark: SparkSession, path: str, sep: str = ";", quote: str = '"') -> DataFrame:
    """(file, split, at, record) of the files under ``path``; ``file, split, at`` is the place of a record's first
    line and their order is that of the text.  Line breaks inside records are ``\\n``."""
    lines = _lines(spark, path, sep, quote)
    along = Window.partitionBy(*SPLIT).orderBy("at")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    counted = lines.withColumn("swaps", F.sum("swap").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    constant = F.when(F.col("const").isNotNull(), F.struct("const", "swaps"))
    counted = counted.withColumn("last", F.last(constant, ignorenulls=True).over(before))
    # The state before each line, for a split that starts outside and for one that starts inside.
    entered = counted.withColumns({f"in{x}": _state(x, F.col("last"), F.col("swaps") - F.col("swap")) for x in (0, 1)})
    splits = entered.groupBy(*SPLIT).agg(
        F.max_by(constant, F.when(constant.isNotNull(), F.col("at"))).alias("last"), F.sum("swap").alias("swaps"),
        *(F.max(F.when(F.col(f"in{x}") == 0, F.col("at"))).alias(f"start{x}") for x in (0, 1)),
    )
    over = Window.partitionBy("file").orderBy("split")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    # Swaps up to a split's last constant, counted from the beginning of the file.
    summed = splits.withColumn("passed", F.coalesce(F.sum("swaps").over(earlier), F.lit(0)))
    moved = F.when(F.col("last").isNotNull(), F.struct(F.col("last.const").alias("const"), (F.col("passed") + F.col("last.swaps")).alias("swaps")))
    opened = summed.withColumn("open", _state(0, F.last(moved, ignorenulls=True).over(earlier), F.col("passed")))
    start = F.when(F.col("open") == 0, F.col("start0")).otherwise(F.col("start1"))
    carried = F.last(F.when(start.isNotNull(), F.struct(F.col("split").alias("split"), start.alias("at"))), ignorenulls=True).over(earlier)
    opened = opened.select(*SPLIT, "open", carried.alias("carried"))
    placed = entered.join(opened, SPLIT).withColumn("state", F.when(F.col("open") == 0, F.col("in0")).otherwise(F.col("in1")))
    following = F.coalesce(F.col("const"), F.pmod(F.col("state") + F.col("swap"), F.lit(2)))
    own = F.last(F.when(F.col("state") == 0, F.struct("split", "at")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    # The first line of a file starts outside, so every line has a record that it is part of.
    placed = placed.select("file", "split", "at", "line", following.alias("after"), F.coalesce(own, F.col("carried")).alias("first"))
    # Inside a split its lines are together already; only pieces of records that go on in another one move.
    piece = F.array_sort(F.collect_list(F.struct("at", "line")))
    pieces = placed.groupBy(*SPLIT, "first").agg(F.array_join(F.transform(piece, lambda p: p["line"]), "\n").alias("text"), F.max_by("after", "at").alias("after"))
    ended = (F.col("first.split") == F.col("split")) & (F.col("after") == 0)
    whole = pieces.filter(ended).select("file", "split", "first.at", F.col("text").alias("record"))
    spread = pieces.filter(~ended).groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("split", "text"))).alias("texts"))
    joined = spread.select("file", "first.split", "first.at", F.array_join(F.transform("texts", lambda p: p["text"]), "\n").alias("record"))
    return whole.unionByName(joined)
