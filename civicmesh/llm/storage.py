"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, one of this machine if all of Spark runs on it, as in tests; else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="civicmesh-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends there, so that a lost
    executor costs one read and not the work before it."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same, and the path, for tables that ``remove`` takes away once nothing reads them."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete paths below the shared folder, through Hadoop's file systems."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Name of the row key of ``numbered`` tables.
ROW = "__row"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored, with a number of its own for each row; written once, it stays the same in every later read."""
    return stored(df.withColumn(ROW, F.monotonically_increasing_id()), name)


#: Rows of two longs up to which a table is broadcast (16 MB); beyond it, both sides of its join are shuffled.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, marked for broadcast if its counted rows are BROADCAST_ROWS at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def without(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` is not among ``ids`` (one column); rows with null stay."""
    drop = small(stored(ids.toDF("__drop").where("__drop is not null").distinct(), "dropped"))
    return df.join(drop, F.col(f"`{column}`") == F.col("__drop"), "left_anti")
