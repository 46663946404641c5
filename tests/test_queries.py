"""Every query that has SQL agrees with DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from quillon.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return f"{value:.5f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_agrees_with_sql(spark, duck, name):
    mine, theirs = catalog.QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(catalog.SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda frame: sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", ["ranking_metrics", "topk_explore"])
def test_ranking_of_many_splits(spark, duck, monkeypatch, name):
    """Lists and keys that are too many for a broadcast give the same rows."""
    monkeypatch.setattr(catalog.ranking, "MOST_SPLITS", 0)
    monkeypatch.setattr(catalog.ranking, "MOST_BROADCAST", 0)
    test_agrees_with_sql(spark, duck, name)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, str(DATA)).count() > 0


def test_fits_are_whole(spark, monkeypatch):
    """The registered fits use the default settings, and the distributed one the sparse features."""
    used = []
    fit = catalog.training.train_all
    monkeypatch.setattr(catalog.training, "train_all", lambda rows, configs, **k: used.extend(configs.values()) or fit(rows, configs, **k))
    for name in ("lr_train_minibatch", "ablation_suite", "bootstrap_stability"):
        catalog.QUERIES[name](spark, str(DATA))
    assert len(used) == 10 and {c.max_epochs for c in used} == {catalog.TrainingConfig().max_epochs}
    found = [r.feature for r in catalog.QUERIES["lr_train_distributed"](spark, str(DATA)).collect()]
    assert found[0] == "bias" and sum(f.startswith("sparse_") for f in found) > 9


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
