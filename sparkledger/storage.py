"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most so many rows are broadcast by `sized`.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set and everything runs on one machine."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="ckpt-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read again: lineage ends here and lost executors cost nothing."""
    at = scratch(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._cut_at = at
    return out


def sized(table: DataFrame) -> DataFrame:
    """A table made by `cut`, with a hint for joins by its number of rows: broadcast if it is small, else sorted shuffles.

    Spark goes by the size of the files, and compressed ones can be a hundred times smaller than the rows that a broadcast holds on the driver.
    """
    out = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge")
    out._cut_at = table._cut_at
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables made by `cut` that nothing reads any more."""
    for df in tables:
        if (at := getattr(df, "_cut_at", None)) is not None:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
