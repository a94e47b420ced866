"""What operators need from the cluster: the shared checkpoint folder, and dense numbering without one task for a hot group."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts into which every group is dealt before its rows are numbered.
PARTS = 4096


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share; one of our own is set only in local mode, where there is none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="quillion-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written once to the shared checkpoint folder and cut off from its plan."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: smaller than a checkpoint, and read by columns. It goes when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def part_of(*cols: Column) -> Column:
    """A part of a group for each row; rows that are alike in ``cols`` are still spread by the task that reads them.

    To be checkpointed with the row, since a later reading may be dealt otherwise.
    """
    return F.pmod(F.xxhash64(*cols, F.spark_partition_id()), F.lit(PARTS)).cast("int")


def numbered(df: DataFrame, group: list[str], part: str, order: list[Column], name: str) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, in parallel within a group.

    Rows are numbered in their (group, part); the sizes of the parts before it
    are added. ``df`` is read twice, so it should be checkpointed.
    """
    keys = [*group, part]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long")).alias("__before"))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1
    # Both sides are hashed on the same keys: the numbering's exchange serves the join too.
    return df.withColumn("__at", at).join(offsets, keys).withColumn(name, F.col("__at") + F.col("__before")).drop("__at", "__before", part)
