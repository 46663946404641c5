"""Queries that must cover all rows that they are about."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.plans import catalog
from quillon.sources import tables

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def test_audit_coverage_is_of_the_decisions_of_all_contexts(spark):
    decided = tables.decisions(spark, DATA)
    assert decided.select("task_context").distinct().count() == 3
    lost = decided.filter(F.col("prediction_id").startswith("lost_")).count()
    found = catalog.QUERIES["audit_coverage"](spark, DATA).first()
    assert lost and (found.decisions, found.covered) == (decided.count(), decided.count() - lost)


def test_live_metrics_are_of_the_decisions_of_all_contexts(spark):
    labelled = tables.decisions(spark, DATA).filter("realized_label is not null and calibrated_probability is not null")
    found = {r.kind: r.example_count for r in catalog.QUERIES["live_metrics"](spark, DATA).collect()}
    assert labelled.select("task_context").distinct().count() == 3
    assert found == {"calibrated": labelled.count(), "raw": labelled.filter("raw_probability is not null").count()}


def test_timed_requests_write_little(spark, monkeypatch):
    """Requests and logs, which repeat names in every line, take less than 400 bytes a request (1,800 as plain text)."""
    paths, original = {}, catalog.scratch.new_path
    monkeypatch.setattr(catalog.scratch, "new_path", lambda spark, name: paths.setdefault(name, original(spark, name)))
    found = catalog.QUERIES["stream_stage_latency"](spark, DATA).collect()
    rows = spark.read.parquet(f"{DATA}/orders.parquet").count()
    assert [(r.requests, r.timed) for r in found] == [(rows, True)] * 5
    folders = [Path(paths[name].removeprefix("file://")) for name in ("requests", "served")]
    assert spark.read.json(f"{paths['served']}/predictions/batch=*").count() == rows
    assert sum(p.stat().st_size for folder in folders for p in folder.rglob("part-*")) < 400 * rows
