"""Tables of a job in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application, as a URI or path without a trailing slash: in the one
    that ``spark.checkpoint.dir`` names.  Where that is absent and the master is local (tests, a laptop)
    a temporary one is made and registered; on a cluster its absence is an error, as executors do not
    see the driver's own folders."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = _OWN.get(context.applicationId)
        if base is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quillon-")
            context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quillon-{context.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a cut in the lineage
    that survives the loss of any executor."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Delete the folder of a table that ``stage`` returned; tables elsewhere stay."""
    spark = table.sparkSession
    own = shared_dir(spark).rpartition("/")[2]
    for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
        if folder.split("/")[-2] == own:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
