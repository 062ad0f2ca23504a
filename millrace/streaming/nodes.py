"""The pipelines: extract-load, and the same with deduplication.

Each micro-batch is decoded strictly, written, and then committed by the query's checkpoint; a batch that fails to
decode or to write stops the query and is read again at the next start. Batch counts arrive in the query's progress as
observed metrics (`decode`: messages and rows or rejected ones; `dedup`: rows produced and keys marked, the difference
to the rows read being duplicates), and deliveries are logged.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from millrace.config import DedupApp, ElApp
from millrace.functions.decode import lenient, strict
from millrace.functions.encode import document_messages
from millrace.sinks import MessageSink, Sink, build_sink
from millrace.sources import build_source
from millrace.streaming.dedup import dedup_stream, guard_state

log = logging.getLogger(__name__)
_ALWAYS = {"processingTime": "0 seconds"}


def missing(metrics) -> int:
    """Messages of a batch that gave no row, by its `decode` metrics: blank ones, or those that didn't parse."""
    found = metrics.asDict()
    return found["rejected"] if "rejected" in found else found["messages"] - found["rows"]


class CountCheck(StreamingQueryListener):
    """Warns of batches in which messages and rows differ; leaves the session with its query."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.id = spark, name, None

    def onQueryStarted(self, event):
        if event.name == self.name:
            self.id = str(event.runId)

    def onQueryProgress(self, event):
        p = event.progress
        if str(p.runId) == self.id and "decode" in p.observedMetrics and (n := missing(p.observedMetrics["decode"])):
            log.warning("%s: batch %d, %d messages gave no row", self.name, p.batchId, n)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if str(event.runId) == self.id:
            self.spark.streams.removeListener(self)


def _start(rows: DataFrame, deliver, checkpoint: str, columns: list[str], trigger: dict, name: str) -> StreamingQuery:
    """Runs `deliver(batch, number)` on each batch that has rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.select(*[f"`{c}`" for c in columns]).persist()
        try:
            count = batch.count()
            if count:
                deliver(batch, number)
            log.info("%s: batch %d, %d rows delivered", name, number, count)
        finally:
            batch.unpersist()

    rows.sparkSession.streams.addListener(CountCheck(rows.sparkSession, name))
    return rows.writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _rows_to(sink: Sink):
    def deliver(batch: DataFrame, number: int) -> None:
        sink.write(batch, number)
        sink.flush()

    return deliver


def _sinks(app: ElApp | DedupApp) -> Sink:
    return build_sink(app.output, build_sink(app.dlq) if app.dlq is not None else None)


def start_el(spark: SparkSession, app: ElApp, *, sink: Sink | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Messages of the input, decoded strictly, to the output."""
    schema = app.input.topic.schema
    rows = strict(build_source(spark, app.input), schema, observe="decode")
    return _start(rows, _rows_to(sink or _sinks(app)), app.checkpoint, list(schema), trigger or _ALWAYS, "el")


def start_documents(spark: SparkSession, app: ElApp, *, sink: MessageSink | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Messages of any shape to a sink of messages, without a schema; those that don't parse are counted and skipped."""
    sink = sink or build_sink(app.output)
    if not isinstance(sink, MessageSink):
        raise ValueError("documents of any shape need a sink of messages")
    docs = lenient(build_source(spark, app.input), observe="decode")

    def deliver(batch: DataFrame, number: int) -> None:
        sink.write_messages(document_messages(batch, "doc", app.output.topic.key_column), number)
        sink.flush()

    return _start(docs, deliver, app.checkpoint, ["doc"], trigger or _ALWAYS, "documents")


def start_dedup(spark: SparkSession, app: DedupApp, *, sink: Sink | None = None, trigger: dict | None = None, clock=None) -> StreamingQuery:
    """The same, less rows whose key passed within the window. `clock` (a column) stands in for the time of processing."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    guard_state(spark, app.dedup.store_dir, app.dedup.bucket_hours)
    schema = app.input.topic.schema
    rows = strict(build_source(spark, app.input), schema, keep=("partition", "offset"), observe="decode")
    if clock is not None:
        rows = rows.withColumn("_clock", clock)
    kept = dedup_stream(rows, app.dedup.field, window_hours=app.dedup.window_hours, bucket_hours=app.dedup.bucket_hours, clock="_clock" if clock is not None else None)
    named = F.col(f"`{app.dedup.field}`").isNotNull() if app.dedup.field in kept.columns else F.lit(False)
    kept = kept.observe("dedup", F.count(F.lit(1)).alias("produced"), F.count_if(named).alias("marked"))
    return _start(kept, _rows_to(sink or _sinks(app)), f"{app.dedup.store_dir}/query", list(schema), trigger or _ALWAYS, "dedup")
