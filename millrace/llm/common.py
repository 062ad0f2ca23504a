"""Helpers shared by the corpus operators: range-sorted stage tables, global places, words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.stages import cut

#: monotonically_increasing_id() keeps the row's place within its partition in the low 33 bits.
_LOCAL_MASK = (1 << 33) - 1


def partitions(spark: SparkSession) -> int:
    """Partitions for explicit range or key exchanges; the cluster sizes them by `spark.sql.shuffle.partitions`."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranged(df: DataFrame, keys: list[Column], label: str, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by `keys`, as a stage table with `_pid` and `_pos` (0-based in the partition).

    Reading `_pid`, then `_pos` in order gives the global order. `keys` should end in a column that tells equal
    keys apart, so that no value is too frequent for one partition; rows equal in all keys are interchangeable.
    `finish` may work on the sorted partitions before they are written.
    """
    out = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    out = finish(out) if finish else out
    return cut(
        out.withColumns({"_pid": F.spark_partition_id(), "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_MASK))}),
        label,
    )


def global_index(table: DataFrame) -> DataFrame:
    """Adds `_idx`, the 0-based place of each row in the whole order of a `ranged` table, and `_all`, its row count.

    One row per partition is summed up in one window; it is broadcast, as its size is the partition count.
    """
    from pyspark.sql import Window

    counts = table.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("_all"))
    return table.join(F.broadcast(starts), "_pid").withColumn("_idx", F.col("_start") + F.col("_pos")).drop("_start")


def split_join(left: DataFrame, right: DataFrame, on: list[str], n: str = "_n", share: int = 1024) -> DataFrame:
    """Inner join with a stage table of one row per key, whose `n` is the number of rows of the key in `left`.

    Keys with more than one in `share` of all rows are fewer than `share`: that side is broadcast, so that their rows stay
    where they are, and only the rest is exchanged by key. `n` is dropped.
    """
    total, least, most = right.agg(F.sum(n), F.min(n), F.max(n)).first()
    if total is None:
        return left.join(F.broadcast(right.limit(0).drop(n)), on)
    # where all keys are on one side, the other side's joins are not planned at all
    if least * share > total:
        return left.join(F.broadcast(right.drop(n)), on)
    if most * share <= total:
        return left.join(right.drop(n).hint("merge"), on)
    heavy = F.col(n) * share > total
    frequent = left.join(F.broadcast(right.where(heavy).drop(n)), on)
    rest = left.join(F.broadcast(right.where(heavy).select(*on)), on, "left_anti").join(right.where(~heavy).drop(n).hint("merge"), on)
    return frequent.unionByName(rest)


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`; null counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
