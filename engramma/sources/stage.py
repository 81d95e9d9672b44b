"""Tables written once to the cluster's shared folder, and dense numbering."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is unset and all runs in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="engramma-")
    return _own[context.applicationId]


def folder_for(spark: SparkSession, name: str) -> str:
    """A new folder for a table of this application, deleted when the application ends."""
    path = f"{shared_dir(spark)}/engramma/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = made.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(made)
    files.deleteOnExit(made)
    return path


def staged(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Write ``df`` and read it back, sorted in its files by ``keys`` so that filters on them skip row groups."""
    path = folder_for(df.sparkSession, name) + "/table"
    (df.sortWithinPartitions(*keys) if keys else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: str, start: int = 0) -> DataFrame:
    """Add ``name``: start, start + 1, ... in the given order, without one task that sees all rows.

    Rows are dealt by ranges and written once; a row's number is its place in its
    partition plus the rows of the partitions before it, one number per partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    rows = staged(ranged, "numbered").withColumn("_part", F.shiftright("_mid", 33))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.col("_before") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + start
    return rows.join(F.broadcast(starts), "_part").withColumn(name, at.cast("long")).drop("_mid", "_part", "_before")
