"""The corpus pipeline: documents to a sharded, mixed, decontaminated and deduplicated training set.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but the last return the
columns of `documents`. Counted as part of the subpackage llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, mixing, sharding, toxicity, widehash
from millrace.llm.common import fresh, table
from millrace.stages import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the model learns from labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(toxicity.fold(5) != 0)
    model = toxicity.fit(docs, labels)
    out = fresh(docs, "score")
    return toxicity.score(docs, model, out=out).where(F.col(out) < 0.5).drop(out)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by SimHash (five-word shingles, likeness 0.8 or more), the one with the smallest id."""
    return widehash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no window of a benchmark item."""
    found = decontamination.find_windows(docs, table(spark, sf_dir, "benchmark"), carry=tuple(docs.columns))
    return _carried(found.where(F.size("items") == 0), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    mixed = mixing.mix(docs, carry=tuple(docs.columns)).where("copies > 0")
    return _carried(mixed.withColumn(fresh(mixed, "copy"), F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest: for each row of the mixture its shard and its place in the shard."""
    return sharding.interleave_shards(docs)


def _carried(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"carried_{c}").alias(c) for c in columns])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: Training isn't SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
