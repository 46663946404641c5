"""Reading and writing of the file formats that jobs exchange."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import fields, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..config import LABEL, RAW_COLUMNS, AlertThresholds
from . import quoted, scratch


# Delimited raw files
def read_raw_csv(spark: SparkSession, path: str, on_error: str = "raise", quoted_breaks: bool = True) -> DataFrame:
    """Rows of a ``;`` file with ``row_id`` (from 0, over kept rows in order of file and line) and ``label``.

    Blank rows and rows that repeat the header are left out wherever they are.  A row of another
    width or with a label other than yes/no is an error, or with ``on_error='quarantine'`` keeps its
    place with ``is_bad`` set.  Empty cells are null.

    Cells may hold quoted line breaks: records are found by a scan that many tasks share (``quoted``).
    Files without such cells are read faster with ``quoted_breaks`` False."""
    options = {"sep": ";", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    if quoted_breaks:
        found = quoted.read_records(spark, path).filter(F.trim("record") != "")
        raw = found.select(F.from_csv("record", schemas.RAW_FILE.toDDL(), options).alias("r"), F.struct("file", "split", "at").alias("__at")).select("r.*", "__at")
    else:
        raw = spark.read.schema(schemas.RAW_FILE).options(header=False, encoding="UTF-8", **options).csv(path)
        raw = raw.withColumn("__at", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")))
    text = {c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("")) for c in RAW_COLUMNS}
    rows = raw.withColumns(text)
    header = F.lit(True)
    for c in RAW_COLUMNS:
        header = header & (F.lower(F.coalesce(F.col(c), F.lit(""))) == c)
    blank = F.coalesce(*(F.col(c) for c in RAW_COLUMNS)).isNull() & (F.col("_corrupt").isNull() | F.col("_corrupt").rlike(r"^[;\s]*$"))
    kept = rows.filter(~header & ~blank)
    label = F.when(F.lower(LABEL) == "yes", 1).when(F.lower(LABEL) == "no", 0)
    bad = F.col("_corrupt").isNotNull() | label.isNull()
    numbered = with_row_id(kept, ["__at"])
    if on_error == "quarantine":
        return numbered.withColumns({"label": label, "is_bad": bad}).drop("_corrupt", "__at")
    message = F.concat(F.lit("bad row: "), F.coalesce("_corrupt", F.concat(F.lit("label "), F.coalesce(F.col(LABEL), F.lit("null")))))
    return numbered.withColumn("label", F.when(bad, F.raise_error(message)).otherwise(label)).drop("_corrupt", "__at")


def count_raw_rows(spark: SparkSession, path: str) -> int:
    return read_raw_csv(spark, path, "quarantine").count()


def with_row_id(rows: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Consecutive ids from 0 in the order of the columns, without sorting all rows in one task: rows
    are range-partitioned, written once, and each partition starts after the rows of those before it."""
    parts = scratch.stage(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("n"))
    starts = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__in", inside).join(starts, "__part").withColumn(name, F.col("__start") + F.col("__in")).drop("__part", "__in", "__start")


# JSON lines
def read_training_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.TRAINING_ROW).json(path)
    empty = F.array().cast("array<double>")
    return rows.withColumns({"sample_weight": F.coalesce("sample_weight", F.lit(1.0)), "dense_features": F.coalesce("dense_features", empty)})


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """A log of JSON lines; keys that a line lacks are null."""
    return spark.read.schema(schema).json(path)


def read_decision_files(spark: SparkSession, folder: str) -> DataFrame:
    """All decision files of a folder in the order of their names, with the name of each row's file."""
    found = spark.read.schema(schemas.DECISION_OUTCOME).option("pathGlobFilter", "*.json*").json(folder).withColumn("file_name", F.col("_metadata.file_name"))
    return found.orderBy("file_name")


def head_or_empty(spark: SparkSession, path: str, schema, limit: int) -> DataFrame:
    """The first rows of a log; no rows where there is none."""
    return read_log(spark, path, schema).limit(limit) if exists(spark, path) else spark.createDataFrame([], schema)


def write_json(rows: DataFrame, path: str, single: bool = False, **partition_by: str) -> None:
    """JSON lines with nulls kept; ``single`` writes one file (for small tables)."""
    writer = (rows.coalesce(1) if single else rows).write.mode("overwrite").option("ignoreNullFields", False)
    (writer.partitionBy(*partition_by.values()) if partition_by else writer).json(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """One folder for each split, written in one pass, so that readers of a split skip the others."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).partitionBy("split").json(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    schema = schemas.TRAINING_ROW.add("split", "string") if "split" not in schemas.TRAINING_ROW.names else schemas.TRAINING_ROW
    return spark.read.schema(schema).json(path)


# Small documents
def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def read_document(spark: SparkSession, path: str, missing_ok: bool = False) -> dict | None:
    if missing_ok and not exists(spark, path):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    fs, target = _fs(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(json.dumps(document, indent=2, sort_keys=True, default=str).encode()))
    finally:
        out.close()


def read_alert_thresholds(spark: SparkSession, path: str | None) -> AlertThresholds:
    """The ``alerts:`` block of a YAML file; other blocks and unknown keys are passed over."""
    defaults = AlertThresholds()
    if not path or not exists(spark, path):
        return defaults
    known, found, inside = {f.name for f in fields(AlertThresholds)}, {}, False
    for line in (r.value for r in spark.read.text(path).collect()):
        text = line.split("#")[0].rstrip()
        if text and not text[0].isspace():
            inside = text == "alerts:"
        elif inside and ":" in text:
            key, _, value = text.strip().partition(":")
            if key in known and value.strip():
                found[key] = float(value)
    return replace(defaults, **found)


# Requests
def parse_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """Requests as rows: features may be nested or at the top level; ``error`` names what is missing."""
    found = lines.select(F.from_json(column, schemas.REQUEST).alias("r"))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    feature: list[Column] = [text(F.coalesce(F.col(f"r.features.{n}"), F.col(f"r.{n}"))).alias(n) for n in schemas.REQUEST_FEATURES]
    rows = found.select(
        text(F.col("r.request_id")).alias("request_id"), text(F.col("r.event_id")).alias("event_id"), text(F.col("r.event_ts")).alias("event_ts"),
        F.coalesce(F.lower(text(F.col("r.task_context"))), F.lit("bank_marketing")).alias("task_context"), "r.realized_label", "r.realized_value", "r.calibrated_probability", *feature,
    )
    lacking = F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in ("request_id", "event_id", "event_ts"))))
    has = F.coalesce(*(F.col(n) for n in schemas.REQUEST_FEATURES)).isNotNull()
    return rows.withColumns({"has_features": has, "error": F.when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ", ")))})
