"""Message sources. A source is a function from settings to a streaming DataFrame with MESSAGE_COLUMNS.

`build_source` looks the settings' type up; `register` adds a type. Reading, committing and closing are Spark's own: a
query's checkpoint holds what was read, is committed when a batch has been written, and `StreamingQuery.stop()` ends it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import FileInput, KafkaInput

MESSAGE_COLUMNS = ("key", "value", "topic", "partition", "offset", "timestamp")


def kafka_options(settings: KafkaInput) -> dict[str, str]:
    """Options of Spark's Kafka source for bounded micro-batches.

    A batch has `batch_size` messages, or what there is after `batch_timeout_sec`. The start position counts for the
    first start only; later the checkpoint tells, so it is the checkpoint that stands for the group.
    """
    if settings.topic.format != "json":
        raise ValueError("messages are read as JSON; a topic of Arrow batches can't be an input")
    c = settings.consumer
    return {
        "kafka.bootstrap.servers": settings.connection.broker,
        "subscribe": settings.topic.name,
        "startingOffsets": {"smallest": "earliest", "largest": "latest"}.get(c.auto_offset_reset, c.auto_offset_reset),
        "kafka.group.id": c.group_id,
        "maxOffsetsPerTrigger": str(c.batch_size),
        "minOffsetsPerTrigger": str(c.batch_size),
        "maxTriggerDelay": f"{c.batch_timeout_sec}s",
        **({} if c.fail_on_data_loss else {"failOnDataLoss": "false"}),
        **{f"kafka.{k}": v for k, v in settings.connection.options.items()},
    }


def kafka(spark: SparkSession, settings: KafkaInput) -> DataFrame:
    """Needs Spark's Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**kafka_options(settings)).load().select(*MESSAGE_COLUMNS)


def files(spark: SparkSession, settings: FileInput) -> DataFrame:
    """Messages from files: lines of small text files, or Parquet with `value` and optionally the other message columns.

    The offset of a line is its file's time of modification in microseconds plus its place, so that files follow each
    other by time; Parquet rows without an offset column have their place in the file.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", settings.files_per_batch)
    if settings.format == "text":
        lines = reader.option("wholetext", True).text(settings.path).select(F.unix_micros("_metadata.file_modification_time").alias("_file"), F.posexplode(F.split("value", "\n")).alias("_line", "value"))
        rows = lines.withColumn("offset", F.col("_file") + F.col("_line"))
    else:
        rows = reader.schema(spark.read.parquet(settings.path).schema).parquet(settings.path)
        if "offset" not in rows.columns:
            rows = rows.withColumn("offset", F.col("_metadata.row_index"))
    filled = {"key": F.lit(None).cast("string"), "topic": F.lit(settings.topic.name), "partition": F.lit(0), "timestamp": F.current_timestamp()}
    return rows.withColumns({c: e for c, e in filled.items() if c not in rows.columns}).select(*MESSAGE_COLUMNS)


SOURCES: dict[type, Callable[[SparkSession, object], DataFrame]] = {KafkaInput: kafka, FileInput: files}


def register(kind: type, source: Callable[[SparkSession, object], DataFrame]) -> None:
    SOURCES[kind] = source


def build_source(spark: SparkSession, settings) -> DataFrame:
    if type(settings) not in SOURCES:
        raise ValueError(f"no source for settings of type {type(settings).__name__}")
    return SOURCES[type(settings)](spark, settings)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder of tables, as queries over bounded data read it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
