"""Stage tables: lineage cut by a Parquet table in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

#: monotonically_increasing_id() keeps the row's place within its partition in the low 33 bits.
_LOCAL_MASK = (1 << 33) - 1


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` as the session has it. Only where it is unset and driver and executors are one process, a folder
    of our own; on a cluster, executors would write to a local folder of theirs."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back, so that what is above runs once, whatever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: list[Column], name: str = "_seq") -> DataFrame:
    """Adds `name`, the 1-based place of each row in the order of `keys`, without sorting all rows in one task.

    Rows are range-partitioned and sorted; partition counts, one row per partition, are summed up and broadcast.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    table = cut(parts.withColumns({"_pid": F.spark_partition_id(), "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_MASK))}), "numbered")
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = table.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return table.join(F.broadcast(starts), "_pid").withColumn(name, F.col("_start") + F.col("_pos") + 1).drop("_pid", "_pos", "_start")
