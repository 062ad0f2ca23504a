"""Deduplication of a stream in a rolling bucketed window of processing time.

The state of a key is the bucket in which a row of it was last let through. A row passes if there is none, or if that
bucket is no longer live (`functions.buckets`); a dropped row changes nothing. State is partitioned by key and kept in
the checkpoint, so it is shared by all executors and restored with the query, and a batch that fails is run again on
the state from before it: keys count as seen only with the batch that was delivered.

Rows with a null key pass without state; they are spread over all partitions.
"""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from millrace.functions.buckets import bucket, dedup_key, live_buckets

#: Session settings that the operator needs. Without the second, expiring state keeps an available-now query running.
CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
_SALTS = 1024


class _FirstWins(StatefulProcessor):
    def __init__(self, live: int, ttl_ms: int, order: list[str], columns: list[str]):
        self.live, self.ttl_ms, self.order, self.columns = live, ttl_ms, order, columns

    def init(self, handle) -> None:
        # time to live only frees storage: it never ends before the bucket does
        self.seen = handle.getValueState("seen", StructType([StructField("b", LongType())]), self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        from pyspark.sql import Row

        def place(row):
            return [(row[c] is None, row[c]) if row[c] is not None else (True, 0) for c in self.order]

        out = Row(*self.columns)
        if key[0] is None:
            for row in rows:
                yield out(*(row[c] for c in self.columns))
            return
        last = self.seen.get()[0] if self.seen.exists() else None
        before = last
        for row in sorted(rows, key=place):
            if last is None or row["_bucket"] - last >= self.live:
                last = row["_bucket"]
                yield out(*(row[c] for c in self.columns))
        if last != before:
            self.seen.update((last,))

    def close(self) -> None:
        pass


def dedup_stream(df: DataFrame, field: str, *, window_hours: int = 3, bucket_hours: int = 1, clock: str | None = None, order: tuple[str, ...] = ("partition", "offset")) -> DataFrame:
    """The rows of a stream that pass, with its columns.

    `clock` is a timestamp column with each row's processing time, the micro-batch's own if not given; `order` says
    which of a batch's rows comes first. Without the column `field` the stream is returned as it is.
    """
    if field not in df.columns:
        warnings.warn(f"no column {field!r}: rows pass as they are", stacklevel=2)
        return df
    for k, v in CONF.items():
        df.sparkSession.conf.set(k, v)
    order = [c for c in order if c in df.columns]
    key = dedup_key(F.col(f"`{field}`"))
    spread = F.when(key.isNull(), F.pmod(F.xxhash64(*(order or df.columns)), F.lit(_SALTS))).otherwise(0)
    marked = df.withColumns({"_key": key, "_salt": spread, "_bucket": bucket(F.col(clock) if clock else F.current_timestamp(), bucket_hours)})
    live = live_buckets(window_hours, bucket_hours)
    processor = _FirstWins(live, live * bucket_hours * 3_600_000, order, df.columns)
    return marked.groupBy("_key", "_salt").transformWithState(statefulProcessor=processor, outputStructType=df.schema, outputMode="Append", timeMode="ProcessingTime")


def guard_state(spark, folder: str, bucket_hours: int) -> None:
    """Notes the bucket length beside the state; a later start with another one would read its buckets wrongly and fails."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/millrace-dedup.json")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        stream = fs.open(path)
        found = json.loads(bytes(stream.readAllBytes()).decode())
        stream.close()
        if found["bucket_hours"] != bucket_hours:
            raise ValueError(f"the state in {folder} has buckets of {found['bucket_hours']} hours, not {bucket_hours}; start with a new folder")
        return
    stream = fs.create(path)
    stream.write(bytearray(json.dumps({"bucket_hours": bucket_hours}).encode()))
    stream.close()
