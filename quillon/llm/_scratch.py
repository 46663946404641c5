"""Intermediate tables and files in the folder that driver and executors share."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir

_OPEN = threading.local()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    for made in getattr(_OPEN, "lists", ()):
        made.append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at the end what was made inside, but for paths taken off the list it gives.  What is
    needed later must by then be collected or written elsewhere."""
    made: list[str] = []
    _OPEN.lists = [*getattr(_OPEN, "lists", ()), made]
    try:
        yield made
    finally:
        _OPEN.lists = _OPEN.lists[:-1]
        for path in made:
            drop(spark, path)


def staged_in(spark: SparkSession, name: str, make) -> DataFrame:
    """``stage`` of what ``make`` returns; other tables and files made on the way are deleted."""
    with temporary(spark) as made:
        table = stage(make(), name)
        made.pop()
    return table


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a cut in the lineage
    that survives the loss of any executor."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hashed_sample(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most ``n`` rows, those with the smallest hashes of the keys: the same rows on every run.

    Rows are first thinned by hash to about ``n`` in all, so tasks send the driver no more than that."""
    total, cells = rows.count(), 1 << 30
    place = F.pmod(F.xxhash64(*keys), F.lit(cells))
    if total > n:
        rows = rows.filter(place < int(cells * min(1.0, (n + 4 * n**0.5 + 10) / total)))
    return rows.orderBy(place, *keys).limit(n)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(table: DataFrame) -> None:
    """Delete the folder of a table that ``stage`` returned; other tables stay."""
    own = shared_dir(table.sparkSession).rpartition("/")[2]
    for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
        if folder.split("/")[-2] == own:
            drop(table.sparkSession, folder)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path for code that runs inside tasks."""
    return pafs.FileSystem.from_uri(path.replace("file:///", "/") if path.startswith("file:///") else path)


class CommittedFile:
    """A binary file that appears under its name only once it is complete.

    A task that is retried, or runs twice by speculation, replaces the file by equal bytes.
    """

    def __init__(self, path: str):
        self.fs, self.path = file_system(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.size = 0

    def __enter__(self) -> CommittedFile:
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        return self

    def write(self, data: bytes) -> int:
        self.out.write(data)
        self.size += len(data)
        return len(data)

    def __exit__(self, kind, value, trace) -> None:
        self.out.close()
        if kind is None:
            self.fs.move(self.temporary, self.path)
        else:
            self.fs.delete_file(self.temporary)
