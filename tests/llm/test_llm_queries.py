"""The queries that have SQL agree with DuckDB, on the smallest tables and on awkward ones."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

from quillon.llm import queries

DATA = Path("/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels".split()


def plain(value):
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def agree(spark, name, folder):
    duck = duckdb.connect()
    for table in TABLES:
        if (Path(folder) / f"{table}.parquet").exists():
            duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    mine, theirs = queries.QUERIES[name](spark, str(folder)), duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    found = mine.select(*columns).collect()
    expected = theirs.select(*(f'"{c}"' for c in columns)).fetchall()
    assert sorted(tuple(map(plain, r)) for r in found) == sorted(tuple(map(plain, r)) for r in expected)
    return found


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    agree(spark, name, DATA)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Vectors planted at the threshold, and nulls, ties and repeated rows in every table."""
    folder, rng = tmp_path_factory.mktemp("tables"), np.random.default_rng(31)
    vectors = []
    for i in range(150):
        v, w = rng.normal(size=16), rng.normal(size=16)
        v /= np.linalg.norm(v)
        w -= (w @ v) * v
        w /= np.linalg.norm(w)
        cosine = rng.uniform(0.985, 0.999) if i % 2 else rng.uniform(0.95, 0.975)
        vectors += [(2 * i, v.tolist(), i % 4), (2 * i + 1, (cosine * v + np.sqrt(1 - cosine**2) * w).tolist(), i % 4)]
        vectors += [(1000 + i, (cosine * v - np.sqrt(1 - cosine**2) * w).tolist(), i % 4)] if i % 5 == 0 else []
    vectors += [(5000 + i, vectors[0][1], 0) for i in range(20)] + [(6000, None, 1), (6001, [0.0] * 16, 1), (6002, vectors[1][1], None), (6003, [float("nan")] * 16, 1), (6004, [], 1), (6005, [None] * 16, 1)]
    pages = [(i, f"http://h/{i % 9}", f"<p>{i % 30}</p>" if i % 7 else None) for i in range(120)] + [(500, None, ""), (501, "u", "é" * 40_000)]
    rnd = random.Random(3)
    documents = [(i, " ".join(rnd.choice("abcdef") * rnd.randint(1, 5) for _ in range(rnd.randint(0, 40))), rnd.choice(["s1", "s2", "s3", "s4", None])) for i in range(300)]
    documents += [(None, "x " * (i % 5), "s1") for i in range(50)] + [(7, "twice here", "s2")] * 3 + [(8, None, "s2"), (9, "word " * 30_000, "s4"), (10, "", "s5")]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(f"file://{folder}/v")
    next((folder / "v").glob("*.parquet")).rename(folder / "embeddings.parquet")
    for rows, schema, name in ((pages, "page_id long, url string, html string", "pages"), (documents, "doc_id long, text string, source string", "documents")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{folder}/{name}")
        next((folder / name).glob("*.parquet")).rename(folder / f"{name}.parquet")
    return folder


def test_planted_vectors_agree_with_sql(spark, awkward):
    found = agree(spark, "op1_embedding_near_dedup", awkward)
    assert sum(r.n_links for r in found) > 300 and sum(not r.kept for r in found) > 80


@pytest.mark.parametrize("name", ["op2_warc", "op5_mixing"])
def test_awkward_tables_agree_with_sql(spark, awkward, name):
    agree(spark, name, awkward)
