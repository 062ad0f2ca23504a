"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Every row gets a seeded hash key; rows are range-sorted by (source, key), so that a source of any size spreads over
many partitions; running sums of word counts within a partition and source, plus the sums of the partitions before,
give each row its place on its source's word line. A source whose target is below its size takes the rows up to its
budget; one whose target is larger takes every row once per whole epoch and the rest of the budget from the start of
the order. The row at the cut is taken if the budget reaches its middle, so rows stay whole and a source misses its
target by half a row at most.

Targets: the budget is `ratio` times all words, shared by weight; no source goes above `cap` times its own words, and
what it can't take is shared among the others by weight until none is above.

Defined cases: null and empty texts have size 0 and follow their source (taken 0 words); null sources form one source,
last in order; sources of size 0 have target 0; repeated rows are rows of their own, interchangeable; an empty table
gives an empty result; carried columns are renamed, so clashing names don't matter. One row per source and per
partition is handled in single windows: their number is that of the mixture's sources, not of the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.llm.common import ranged, table, word_count

WEIGHTS = (3, 1, 2)
RATIO = 1.5
CAP = 2
SEED = "millrace-mix"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> the same with `target`; weights repeat over the sources in code-point order, null last.

    Rising by cap / weight, a source is capped if the level left for it and all later ones lies above its own cap, and
    the capped ones come first; one pass over the ordered sources finds the level of the rest.
    """
    whole = Window.orderBy(F.col("source").asc_nulls_last())
    places = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(whole) - 1) % len(weights) + 1))
    line = Window.orderBy(F.col("source_size") * cap / F.col("_w"), F.col("source").asc_nulls_last())
    before, every = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * ratio
    level = (total - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    judged = places.withColumn("_capped", level * F.col("_w") > F.col("source_size") * cap).withColumn("_total", total)
    held = F.sum(F.when(F.col("_capped"), F.col("source_size") * cap).otherwise(0)).over(every)
    rest = (F.col("_total") - held) / F.sum(F.when(~F.col("_capped"), F.col("_w")).otherwise(0)).over(every)
    return judged.withColumn("target", F.when(F.col("_capped"), (F.col("source_size") * cap).cast("double")).otherwise(F.col("_w") * rest)).select("source", "source_size", "target")


def _running(batches):
    """Adds `_sum`: words of the same source before the row, within the sorted partition."""
    last, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column(batch.schema.get_field_index("size")).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = pc.dictionary_encode(batch.column(batch.schema.get_field_index("source")), null_encoding="encode")
        ids = codes.indices.to_numpy(zero_copy_only=False)
        names = codes.dictionary.to_pylist()
        fresh = np.r_[(last is None) or names[ids[0]] != last[0], ids[1:] != ids[:-1]]
        sums = np.cumsum(size) - size
        starts = np.flatnonzero(fresh)
        base = np.zeros(len(size), np.int64)
        if len(starts):
            base[starts] = np.diff(sums[starts], prepend=0)
        base = np.cumsum(base)
        carried = np.where(np.cumsum(fresh) == 0, total, 0)
        sums = sums - base + carried
        last, total = (names[ids[-1]],), int(sums[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=[*batch.schema.names, "_sum"])


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, cap: int = CAP, seed: str = SEED, stratum: str = "source", row_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken (= copies * size) and `carried_<name>`."""
    rows = docs.select(
        F.col(row_id).alias("doc_id"),
        F.col(stratum).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(row_id).cast("string"), F.lit("null"))).cast("binary")).alias("_key"),
        *[F.col(c).alias(f"carried_{c}") for c in carry],
    )
    order = [F.col("source").asc_nulls_last(), F.col("_key"), F.col("doc_id"), F.col("size")]
    line = ranged(rows, order, "mix", lambda df: df.mapInArrow(_running, StructType([*df.schema.fields, StructField("_sum", LongType())])))
    parts = line.groupBy("_pid", "source").agg(F.sum("size").alias("_n"))
    earlier = Window.partitionBy("source").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("_pid").alias("_p"), F.col("source").alias("_s"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), "_n")
    aims = targets(parts.groupBy(F.col("_s").alias("source")).agg(F.sum("_n").alias("source_size")), weights, ratio, cap)
    parts = parts.join(aims, F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    placed = line.join(parts, (F.col("_pid") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = F.col("target") - F.col("_epochs") * F.col("source_size")
    extra = (budget > 0) & (F.col("_before") + F.col("_sum") + F.col("size") / 2.0 <= budget)
    return (
        placed.withColumn("_epochs", epochs)
        .withColumn("copies", F.col("_epochs") + extra.cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", "taken", *[f"carried_{c}" for c in carry])
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op6_mixing": op6_mixing}
SQL = {
    "op6_mixing": rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) * {RATIO}::DOUBLE AS total,
             (CAST(sum(source_size) OVER () AS BIGINT) * {RATIO}::DOUBLE - 2 * coalesce(sum(source_size) OVER b, 0)::DOUBLE)
             / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
      FROM w WINDOW b AS (ORDER BY (2 * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, level * w > 2 * source_size AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN (2 * source_size)::DOUBLE ELSE
        w * ((total - coalesce(sum(2 * source_size) FILTER (capped) OVER (), 0)::DOUBLE) / (sum(w) FILTER (NOT capped) OVER ())::DOUBLE) END AS target FROM c),
p AS (SELECT d.*, coalesce(CAST(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM d),
e AS (SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * (epochs + CASE WHEN target - epochs * source_size > 0 AND before + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) AS taken FROM e
"""
}
