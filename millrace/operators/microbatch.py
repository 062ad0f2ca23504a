"""Replaying bounded data in micro-batches, and per-batch counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.buckets import dedup_key
from millrace.stages import numbered


def assign(df: DataFrame, order: list[Column], batch_size: int = 1000) -> DataFrame:
    """Adds `_seq` (from 1) and `_batch` (from 0): batches of `batch_size` rows in the order given."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    return numbered(df, order).withColumn("_batch", F.floor((F.col("_seq") - 1) / batch_size).cast("bigint"))


def slices(df: DataFrame, first: int, size: int, seq: str = "_seq") -> DataFrame:
    """Rows `first` to `first + size - 1` by their sequence number."""
    return df.where(F.col(seq).between(first, first + size - 1))


def metrics(df: DataFrame, field: str, batch: str = "_batch", seq: str = "_seq") -> DataFrame:
    """Per batch: rows read, rows forwarded, duplicates dropped and keys newly marked, with first-wins in each batch."""
    key = dedup_key(F.col(f"`{field}`"))
    per_key = df.groupBy(batch, key.alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    named = F.col("_key").isNotNull()
    return per_key.groupBy(F.col(batch).alias("batch")).agg(
        F.sum("n").alias("rows_in"),
        F.sum(F.when(named, 1).otherwise(F.col("n"))).alias("produced"),
        F.sum(F.when(named, F.col("n") - 1).otherwise(0)).alias("deduped"),
        F.count_if(named).alias("marked"),
    )
