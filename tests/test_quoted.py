"""Quoted line breaks read by many tasks, against a reader in one task."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from quillon.config import RAW_COLUMNS
from quillon.sources import files, quoted


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few hundred bytes, so that most quoted cells meet an edge somewhere."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    yield lambda size: [spark.conf.set(n, v) for n, v in zip(names, (str(size), "1", "1"), strict=True)]
    for name, value in before.items():
        spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def odd_cell(rng):
    parts = ["a", "bc;d", '"', '""', "\n", "\n\n", ";", " ", "x;\n;y", '";"', "é", "\n\"\n", "plain", "", "\r\n", "#", "\\", "''"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))


@pytest.mark.parametrize("size", [40, 97, 300, 10_000_000])
def test_records_equal_those_of_one_task(spark, tmp_path, tiny_splits, size):
    rng = random.Random(size)
    for name in ("a", "b", "c"):
        out = io.StringIO()
        writer = csv.writer(out, delimiter=";", lineterminator=rng.choice(["\n", "\r\n"]), quoting=csv.QUOTE_MINIMAL)
        for i in range(120):
            writer.writerow([f"{name}{i}", odd_cell(rng) if rng.random() < 0.5 else "k", odd_cell(rng) if rng.random() < 0.2 else "v", "end"])
        (tmp_path / f"{name}.csv").write_text(out.getvalue(), newline="")
    tiny_splits(size)
    found = quoted.read_records(spark, f"file://{tmp_path}").orderBy("file", "split", "at").collect()
    assert len({(r.file, r.split) for r in found}) > (3 if size < 1000 else 2)
    for name in ("a", "b", "c"):
        text = (tmp_path / f"{name}.csv").read_text().replace("\r\n", "\n")
        expected = list(csv.reader(io.StringIO(text), delimiter=";"))
        mine = [next(csv.reader(io.StringIO(r.record), delimiter=";")) for r in found if r.file.endswith(f"{name}.csv")]
        assert mine == expected


def raw_cells(rng, i):
    cells = {c: f"{c}{i}" for c in RAW_COLUMNS} | {"y": rng.choice(["yes", "no"]), "age": str(i)}
    for c in ("job", "marital", "poutcome"):
        cells[c] = rng.choice([f"{c}{i}", f"two\nlines {i}", f"semi;colon {i}", f'he said "{i}"', f'a\n\n";"\nb{i}', ""])
    return [cells[c] for c in RAW_COLUMNS]


def test_raw_rows_equal_those_of_one_task(spark, tmp_path, tiny_splits):
    rng = random.Random(5)
    out = io.StringIO()
    writer = csv.writer(out, delimiter=";", lineterminator="\n")
    rows = [raw_cells(rng, i) for i in range(300)]
    for i, row in enumerate(rows):
        writer.writerow(row)
        if i % 50 == 7:
            writer.writerow(RAW_COLUMNS)
            out.write("\n  \n")
    (tmp_path / "one.csv").write_text("﻿" + out.getvalue(), newline="")
    tiny_splits(700)
    found = files.read_raw_csv(spark, f"file://{tmp_path}/one.csv").orderBy("row_id").collect()
    assert [r.row_id for r in found] == list(range(300))
    assert [[r[c] for c in RAW_COLUMNS] for r in found] == [[c.strip() or None for c in row] for row in rows]
    one_task = spark.read.options(sep=";", multiLine=True, quote='"', escape='"').csv(f"file://{tmp_path}/one.csv").filter(F.col("_c0").rlike("^﻿?[0-9]+$"))
    assert one_task.count() == 300


def test_a_stray_quote_opens_nothing_and_an_unclosed_one_runs_on(spark, tmp_path, tiny_splits):
    (tmp_path / "stray.csv").write_text('1;5" wide;x\n2;in "the" middle;y\n3; "opens ""here\n4;still";z\n5;a"b;"c\nd"\n6;"closed"tail";w\n7;"never\nclosed\n8;x;y\n')
    tiny_splits(20)
    found = [r.record for r in quoted.read_records(spark, f"file://{tmp_path}").orderBy("file", "split", "at").collect()]
    assert found == ['1;5" wide;x', '2;in "the" middle;y', '3; "opens ""here\n4;still";z', '5;a"b;"c\nd"', '6;"closed"tail";w', '7;"never\nclosed\n8;x;y']


def test_no_lines_at_all(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert quoted.read_records(spark, f"file://{tmp_path}").collect() == []
    assert files.read_raw_csv(spark, f"file://{tmp_path}").count() == 0
