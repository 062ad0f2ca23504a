"""First-wins deduplication of bounded data: within a batch, against seen keys, and across a rolling bucketed window.

Rows with a null key always pass, wherever they stand. Null keys and hot keys are kept from filling one task: nulls
are left out of every exchange on the key, and each operator reduces a key's rows before they are shuffled.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.buckets import bucket, dedup_key, is_live, live_buckets


def _has(df: DataFrame, field: str) -> bool:
    if field in df.columns:
        return True
    warnings.warn(f"no column {field!r}: rows pass as they are", stacklevel=3)
    return False


def _ordered(order: list[str]) -> Column:
    """A struct that compares like the order columns, nulls last."""
    return F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])


def _first_row(df: DataFrame, order: list[str]) -> Column:
    """The first row of a group by `order`, as a struct; an aggregate, so that maps combine before the exchange."""
    return F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), _ordered(order))


def first_wins(df: DataFrame, field: str, order: list[str]) -> DataFrame:
    """The first row of each key by `order`, and every row with a null key. Without such a column all rows pass."""
    if not _has(df, field):
        return df
    key = dedup_key(F.col(f"`{field}`"))
    kept = df.where(key.isNotNull()).groupBy(key.alias("_key")).agg(_first_row(df, order).alias("row")).select("row.*")
    return kept.unionByName(df.where(key.isNull()))


def not_seen(df: DataFrame, field: str, seen: DataFrame, seen_field: str) -> DataFrame:
    """Rows whose key is not among the seen ones; null keys pass."""
    keys = seen.select(dedup_key(F.col(f"`{seen_field}`")).alias("_seen")).where("_seen is not null").distinct()
    key = dedup_key(F.col(f"`{field}`"))
    return df.where(key.isNotNull()).join(keys, key == F.col("_seen"), "left_anti").unionByName(df.where(key.isNull()))


def mark_seen(df: DataFrame, field: str, clock: str, bucket_hours: int) -> DataFrame:
    """(key, bucket) of a batch's non-null keys, once each: what a later batch is held against."""
    return df.select(dedup_key(F.col(f"`{field}`")).alias("key"), bucket(F.col(clock), bucket_hours).alias("bucket")).where("key is not null").distinct()


def live_marks(marks: DataFrame, now: Column, window_hours: int, bucket_hours: int) -> DataFrame:
    """Marks that may still drop a row at time `now` or later; the others can be forgotten."""
    return marks.where(is_live(F.col("bucket"), bucket(now, bucket_hours), window_hours, bucket_hours))


def add(marks: DataFrame, key: str, bucket: int) -> DataFrame:
    """The marks and one more, once."""
    return marks.unionByName(marks.sparkSession.createDataFrame([(key, bucket)], marks.select("key", "bucket").schema)).distinct()


def contains(marks: DataFrame, key: str) -> bool:
    """Whether one key is marked."""
    return not marks.where(F.col("key") == key).isEmpty()


def not_live(df: DataFrame, field: str, marks: DataFrame, clock: str, window_hours: int, bucket_hours: int) -> DataFrame:
    """Rows whose key has no live mark at the row's own time; later buckets than the row's count as live."""
    n = live_buckets(window_hours, bucket_hours)
    latest = marks.groupBy("key").agg(F.max("bucket").alias("_b"))
    key = dedup_key(F.col(f"`{field}`"))
    joined = df.where(key.isNotNull()).withColumn("_k", key).join(latest.withColumnRenamed("key", "_k"), "_k", "left")
    free = joined.where(F.col("_b").isNull() | (bucket(F.col(clock), bucket_hours) - F.col("_b") >= n)).select(*[F.col(f"`{c}`") for c in df.columns])
    return free.unionByName(df.where(key.isNull()))


def windowed_first_wins(df: DataFrame, field: str, clock: str, order: list[str], window_hours: int = 3, bucket_hours: int = 1) -> DataFrame:
    """What the streaming operator lets through, computed over bounded data: a row survives if its key is null or no
    surviving row of its key lies within the last N - 1 buckets or its own (`buckets.live_buckets`). A dropped row
    does not extend the window.

    Only a bucket's first row can survive, so rows become minima per key and bucket before the exchange; what is left
    per key, one row per bucket at most, is folded in order.
    """
    if not _has(df, field):
        return df
    n = live_buckets(window_hours, bucket_hours)
    key = dedup_key(F.col(f"`{field}`"))
    firsts = df.where(key.isNotNull()).groupBy(key.alias("_key"), bucket(F.col(clock), bucket_hours).alias("_bucket")).agg(_first_row(df, order).alias("row"))
    lines = firsts.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct(F.col("_bucket").alias("b"), F.col("row")))).alias("line"))
    buckets = F.transform("line", lambda x: x["b"])
    kept = F.aggregate(buckets, F.array().cast("array<bigint>"), lambda kept, b: F.when((F.size(kept) == 0) | (b - F.element_at(kept, -1) >= n), F.array_append(kept, b)).otherwise(kept))
    rows = F.filter("line", lambda x: F.array_contains(F.col("kept"), x["b"]))
    survivors = lines.withColumn("kept", kept).select(F.explode(rows).alias("x")).select("x.row.*")
    return survivors.unionByName(df.where(key.isNull()))
