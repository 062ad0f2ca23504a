"""Sinks: where a micro-batch goes. `build_sink` looks the settings' type up; `register` adds a type.

A sink's `write` returns when the batch is stored, so a query commits only what was delivered. A batch may be written
again after a failure: delivery is at least once.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame

from millrace.config import ClickHouseOutput, FileOutput, KafkaOutput
from millrace.functions.encode import encode
from millrace.operators.isolate import Insert, insert_all, insert_isolating
from millrace.stages import cut


class Sink(ABC):
    @abstractmethod
    def write(self, df: DataFrame, batch: int = 0) -> None:
        """Stores all rows of `df` before it returns."""

    def write_arrow(self, spark, data, batch: int = 0) -> None:
        """The same for an Arrow table or record batch."""
        import pyarrow as pa

        self.write(spark.createDataFrame(pa.Table.from_batches([data]) if isinstance(data, pa.RecordBatch) else data), batch)

    def write_rows(self, spark, rows: list[dict], schema, batch: int = 0) -> None:
        """The same for rows given as dicts, under an explicit schema."""
        self.write(spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema), batch)

    def flush(self) -> None:
        """Nothing waits: `write` delivers."""

    def close(self) -> None:
        self.flush()


class MessageSink(Sink):
    """A sink of encoded messages; rows are encoded as the topic's format and key column say."""

    def __init__(self, settings: KafkaOutput | FileOutput):
        self.settings = settings

    def write(self, df: DataFrame, batch: int = 0) -> None:
        topic = self.settings.topic
        self.write_messages(encode(df, topic.format, topic.key_column), batch)

    @abstractmethod
    def write_messages(self, messages: DataFrame, batch: int = 0) -> None:
        """Stores messages (key, value)."""


class KafkaSink(MessageSink):
    """Needs Spark's Kafka connector on the class path."""

    def options(self) -> dict[str, str]:
        c = self.settings.connection
        return {"kafka.bootstrap.servers": c.broker, "topic": self.settings.topic.name, **{f"kafka.{k}": v for k, v in c.options.items()}}

    def write_messages(self, messages: DataFrame, batch: int = 0) -> None:
        messages.write.format("kafka").options(**self.options()).save()


class FileSink(MessageSink):
    """Messages as Parquet, a folder per batch; a batch that is written again replaces its folder."""

    def write_messages(self, messages: DataFrame, batch: int = 0) -> None:
        messages.write.mode("overwrite").parquet(f"{self.settings.path}/batch={batch}")


class TableSink(Sink):
    """Inserts Arrow tables by a callable made on each executor task; rejected rows go to another sink if there is one."""

    def __init__(self, connect: Callable[[], Insert], dlq: Sink | None = None, split_factor: int = 10, **retry):
        if split_factor < 2:
            raise ValueError("the split factor must be 2 or more")
        self.connect, self.dlq, self.split_factor, self.retry = connect, dlq, split_factor, retry

    def write(self, df: DataFrame, batch: int = 0) -> None:
        if self.dlq is None:
            return insert_all(df, self.connect, **self.retry)
        bad = cut(insert_isolating(df, self.connect, self.split_factor, **self.retry), "rejected")  # once: a second read would insert again
        if not bad.isEmpty():
            self.dlq.write(bad, batch)
        self.dlq.flush()

    def close(self) -> None:
        if self.dlq is not None:
            self.dlq.close()


def _clickhouse_client(**options):
    import clickhouse_connect

    return clickhouse_connect.get_client(**options)


class ClientInsert:
    """Inserts into one table by a client of this task, which `close` closes."""

    def __init__(self, client, table: str):
        self.client, self.table = client, table

    def __call__(self, data) -> None:
        self.client.insert_arrow(table=self.table, arrow_table=data)

    def close(self) -> None:
        self.client.close()


class ClickHouseSink(TableSink):
    """Needs the `clickhouse_connect` package on the executors, unless `client` makes a client from its options."""

    def __init__(self, settings: ClickHouseOutput, dlq: Sink | None = None, client: Callable[..., object] = _clickhouse_client, **retry):
        self.settings = settings

        def connect() -> Insert:
            c = settings.connection
            return ClientInsert(client(host=c.host, port=c.port, username=c.user, password=c.password, secure=c.secure, database=settings.table.database), settings.table.name)

        super().__init__(connect, dlq, settings.dlq_split_factor, **retry)

    def jdbc_options(self) -> dict[str, str]:
        """For `df.write.format("jdbc")` with a driver of the user's own, where rows need no isolation."""
        c, t = self.settings.connection, self.settings.table
        return {"url": f"jdbc:clickhouse://{c.host}:{c.port}/{t.database}?ssl={str(c.secure).lower()}", "dbtable": t.name, "user": c.user, "password": c.password}


class MemorySink(Sink):
    """Keeps batches as lists of rows on the driver, for tests."""

    def __init__(self):
        self.batches: dict[int, list] = {}
        self.flushes = 0

    def write(self, df: DataFrame, batch: int = 0) -> None:
        self.batches.setdefault(batch, []).extend(df.collect())

    def flush(self) -> None:
        self.flushes += 1

    @property
    def rows(self) -> list:
        return [r for k in sorted(self.batches) for r in self.batches[k]]


SINKS: dict[type, Callable[..., Sink]] = {KafkaOutput: lambda s, dlq: KafkaSink(s), ClickHouseOutput: ClickHouseSink, FileOutput: lambda s, dlq: FileSink(s)}


def register(kind: type, sink: Callable[..., Sink]) -> None:
    SINKS[kind] = sink


def build_sink(settings, dlq: Sink | None = None) -> Sink:
    """The sink for `settings`; only sinks that reject single rows take a `dlq`."""
    if type(settings) not in SINKS:
        raise ValueError(f"no sink for settings of type {type(settings).__name__}")
    return SINKS[type(settings)](settings, dlq)
