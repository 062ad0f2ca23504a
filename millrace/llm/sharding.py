"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is (2 r - 1) / (2 n) for rank r
of n. Sorting all rows by it spreads each source evenly over the whole order, so that equal contiguous cuts hold each
source in its share. Ranks come from range partitions and partition offsets: no source is ever gathered in a task.

Defined cases: null ids, sources and texts are ordinary values (a null source is a stratum of its own, ordered last;
a null text has no bytes and the CRC of the empty text); rows equal in all key columns are interchangeable; an empty
table gives an empty result; columns that aren't asked for by `carry` are left behind, so clashing names don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import global_index, ranged, table

SHARDS = 8
SEED = "millrace-shards"


def interleave_shards(docs: DataFrame, shards: int = SHARDS, *, stratum: str = "source", row_id: str = "doc_id", text: str = "text", seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """Deals rows to `shards` shards whose counts are at most one apart and whose source shares agree.

    Returns doc_id, source, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot (gapless from 0 in each
    shard) and the columns in `carry`, named `carried_<name>`. The text itself only travels if it is carried.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(row_id).alias("doc_id"),
        F.col(stratum).alias("source"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(row_id).cast("string"), F.lit("null"))).cast("binary")).alias("_key"),
        *[F.col(c).alias(f"carried_{c}") for c in carry],
    )
    order = [F.col("source").asc_nulls_last(), F.col("_key"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    sorted_rows = ranged(rows, order, "shard-strata")
    # a stratum may span partitions, and a partition may hold many strata: offsets per pair of the two
    parts = sorted_rows.groupBy("_pid", "source").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    by_source = Window.partitionBy("source")
    parts = parts.select(
        F.col("_pid").alias("_p"),
        F.col("source").alias("_s"),
        (F.coalesce(F.sum("_n").over(by_source.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(by_source).alias("_total"),
    )
    ranks = sorted_rows.join(parts, (F.col("_pid") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    rank = F.col("_pos") + F.col("_shift") + 1
    ranks = ranks.withColumn("_fraction", (2 * rank - 1) / (2.0 * F.col("_total"))).drop("_pid", "_pos", "_p", "_s", "_shift", "_total")
    order = [F.col("_fraction"), F.col("_key"), F.col("source").asc_nulls_last(), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    whole = global_index(ranged(ranks, order, "shard-order"))
    return (
        whole.withColumn("shard", F.expr(f"(_idx * {shards}) div _all").cast("int"))
        .withColumn("slot", F.expr(f"_idx - (shard * _all + {shards - 1}) div {shards}"))
        .select("doc_id", "source", "size", "text_crc32", "shard", "slot", *[f"carried_{c}" for c in carry])
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = interleave_shards(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_sharding": op10_sharding}
#: DuckDB has no CRC-32, so the query is held against a brute-force version in tests/llm.
SQL: dict[str, str] = {}
