"""Queries that apply the pipeline's operators to the bounded tables, and their oracles.

`events` stands in for a stream: its order is (ts, event_id), its clock is ts, and keys are user_id or, where nulls
matter, NULLIF(user_id % 10, 0).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import buckets, decode, encode
from millrace.operators import dedup, isolate, microbatch
from millrace.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ORDER = ["ts", "event_id"]


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def _with_null_keys(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.expr("nullif(user_id % 10, 0)"))


@_query("SELECT event_id, ts, user_id, event_type, value, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def inbatch_dedup(spark, folder):
    return dedup.first_wins(_events(spark, folder), "user_id", ORDER)


@_query("SELECT event_id, ts, k FROM (SELECT *, nullif(user_id % 10, 0) AS k FROM events) QUALIFY k IS NULL OR row_number() OVER (PARTITION BY k ORDER BY ts, event_id) = 1")
def inbatch_dedup_nulls(spark, folder):
    return dedup.first_wins(_with_null_keys(_events(spark, folder)).select("event_id", "ts", "k"), "k", ORDER)


@_query("SELECT event_id, ts, user_id, event_type, value FROM events")
def dedup_missing_field(spark, folder):
    return dedup.first_wins(_events(spark, folder).select("event_id", "ts", "user_id", "event_type", "value"), "does_not_exist", ORDER)



@_query("""
WITH m AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS t FROM events), e AS (SELECT *, nullif(user_id % 1000, 0) AS k, ts < t AS early FROM events, m)
SELECT event_id, k FROM e WHERE NOT early AND NOT EXISTS (SELECT 1 FROM e AS o WHERE o.early AND o.k = e.k AND o.event_type = 'purchase')""")
def anti_seen_keys(spark, folder):
    events = _events(spark, folder).withColumn("k", F.expr("nullif(user_id % 1000, 0)"))
    middle = events.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("t")).first()["t"]
    early = F.col("ts") < F.lit(middle).cast("timestamp_ntz")
    seen = events.where(early & (F.col("event_type") == "purchase"))
    return dedup.not_seen(events.where(~early), "k", seen, "k").select("event_id", "k")


def _windowed_sql(window: int, bucket: int) -> str:
    n = -(-window // bucket)
    return f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, CAST(floor(epoch(ts) / {bucket * 3600}) AS BIGINT) AS b, ts FROM events),
h AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, b ORDER BY ts, event_id) = 1),
f AS (SELECT event_id, user_id, b, row_number() OVER (PARTITION BY user_id ORDER BY b) AS n FROM h),
w AS (SELECT user_id, event_id, b, n, b AS last, TRUE AS keep FROM f WHERE n = 1
  UNION ALL SELECT f.user_id, f.event_id, f.b, f.n, CASE WHEN f.b - w.last >= {n} THEN f.b ELSE w.last END, f.b - w.last >= {n} FROM w JOIN f ON f.user_id = w.user_id AND f.n = w.n + 1)
SELECT event_id, user_id, b AS bucket FROM w WHERE keep"""


def _windowed(spark, folder, window: int, bucket: int) -> DataFrame:
    rows = _events(spark, folder).select("event_id", "ts", "user_id")
    kept = dedup.windowed_first_wins(rows, "user_id", "ts", ORDER, window, bucket)
    return kept.select("event_id", "user_id", buckets.bucket(F.col("ts"), bucket).alias("bucket"))


@_query(_windowed_sql(3, 1))
def windowed_dedup_3h_1h(spark, folder):
    return _windowed(spark, folder, 3, 1)


@_query(_windowed_sql(1, 1))
def windowed_dedup_1h_1h(spark, folder):
    return _windowed(spark, folder, 1, 1)


@_query(_windowed_sql(5, 2))
def windowed_dedup_5h_2h(spark, folder):
    return _windowed(spark, folder, 5, 2)


@_query("""
WITH e AS (SELECT event_id, ts, nullif(user_id % 50, 0) AS k, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS b FROM events), m AS (SELECT k, max(b) AS b FROM e WHERE k IS NOT NULL AND event_id % 3 = 0 GROUP BY k)
SELECT e.event_id, e.k FROM e LEFT JOIN m USING (k) WHERE e.event_id % 3 = 1 AND (m.b IS NULL OR e.b - m.b >= 3)""")
def not_live_marks(spark, folder):
    events = _events(spark, folder).withColumn("k", F.expr("nullif(user_id % 50, 0)")).select("event_id", "ts", "k")
    marks = dedup.mark_seen(events.where("event_id % 3 = 0"), "k", "ts", 1)
    return dedup.not_live(events.where("event_id % 3 = 1"), "k", marks, "ts", 3, 1).select("event_id", "k")


@_query("""
WITH m AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS bucket FROM events)
SELECT key, bucket FROM m WHERE CAST(epoch(TIMESTAMP '2024-01-20') / 3600 AS BIGINT) - bucket < 3""")
def live_marks(spark, folder):
    marks = dedup.mark_seen(_events(spark, folder), "user_id", "ts", 1)
    return dedup.live_marks(marks, F.lit("2024-01-20").cast("timestamp_ntz"), 3, 1)


@_query("SELECT CAST(user_id AS VARCHAR) AS key, props AS value FROM events WHERE event_id % 5 <> 0")
def lenient_passthrough(spark, folder):
    """Documents of any shape, keyed by a field and written as they came; what doesn't parse is skipped."""
    events = _events(spark, folder)
    text = F.concat(F.lit('{"k":{"user":'), F.col("user_id").cast("string"), F.lit(',"props":'), F.to_json(F.struct("props")), F.lit("}}"))
    docs = decode.lenient(events.select(F.when(F.col("event_id") % 5 == 0, F.substring(text, 1, 9)).otherwise(text).alias("value")))
    inner = docs.select(F.try_variant_get("doc", "$.k", "variant").alias("doc"))
    keyed = encode.document_messages(inner, "doc", "user")
    return keyed.select("key", F.get_json_object("value", "$.props.props").alias("value"))


@_query("SELECT event_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS bucket, CAST(floor(epoch(ts) / 7200) AS BIGINT) AS bucket2 FROM events")
def bucket_assign(spark, folder):
    ts = F.col("ts")
    return _events(spark, folder).select("event_id", buckets.bucket(ts, 1).alias("bucket"), buckets.bucket(ts, 2).alias("bucket2"))


@_query("""
WITH b AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS bucket FROM events), n AS (SELECT max(bucket) AS now FROM b)
SELECT bucket, count(*) AS n, now - bucket < 3 AS live FROM b, n GROUP BY bucket, now""")
def bucket_live_expired(spark, folder):
    b = _events(spark, folder).select(buckets.bucket(F.col("ts"), 1).alias("bucket"))
    now = b.agg(F.max("bucket")).first()[0]
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("live", buckets.is_live(F.col("bucket"), F.lit(now), 3, 1))


@_query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) // 1000 AS BIGINT) AS batch FROM events")
def microbatch_assign(spark, folder):
    rows = microbatch.assign(_events(spark, folder).select("event_id", "ts"), [F.col("ts"), F.col("event_id")], 1000)
    return rows.select("event_id", F.col("_seq").alias("seq"), F.col("_batch").alias("batch"))


@_query("SELECT event_id FROM events QUALIFY row_number() OVER (ORDER BY ts, event_id) BETWEEN 501 AND 750")
def microbatch_slice(spark, folder):
    rows = microbatch.assign(_events(spark, folder).select("event_id", "ts"), [F.col("ts"), F.col("event_id")], 1000)
    return microbatch.slices(rows, 501, 250).select("event_id")


@_query("""
WITH e AS (SELECT nullif(user_id % 10, 0) AS k, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) // 1000 AS BIGINT) AS batch FROM events)
SELECT batch, count(*) AS rows_in, count(DISTINCT k) + count(*) FILTER (k IS NULL) AS produced, count(k) - count(DISTINCT k) AS deduped, count(DISTINCT k) AS marked FROM e GROUP BY batch""")
def batch_metrics(spark, folder):
    rows = _with_null_keys(_events(spark, folder)).select("event_id", "ts", "k")
    return microbatch.metrics(microbatch.assign(rows, [F.col("ts"), F.col("event_id")], 1000), "k")


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS absent FROM events")
def decode_props(spark, folder):
    return decode.strict(_events(spark, folder), {"k": "int64", "absent": "string"}, value="props", keep=("event_id",))


@_query("SELECT event_id, date_trunc('millisecond', ts) AS t FROM events")
def decode_ms_timestamp(spark, folder):
    messages = _events(spark, folder).select("event_id", F.concat(F.lit('{"t": '), F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.lit("}")).alias("value"))
    return decode.strict(messages, {"t": "timestamp[ms]"}, keep=("event_id",))


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 5 <> 0")
def lenient_decode(spark, folder):
    broken = F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    return decode.lenient(_events(spark, folder).withColumn("value", broken), keep=("event_id",)).select("event_id", F.try_variant_get("doc", "$.k", "bigint").alias("k"))


@_query("SELECT event_id, CAST(event_id % 256 AS SMALLINT) AS a, event_id * 100 % 4294967296 AS b, user_id AS c FROM events")
def unsigned_guard(spark, folder):
    fields = F.to_json(F.struct((F.col("event_id") % 256).alias("a"), (F.col("event_id") * 100 % 4294967296).alias("b"), F.col("user_id").alias("c"), F.lit(1).alias("unused")))
    return decode.strict(_events(spark, folder).select("event_id", fields.alias("value")), {"a": "uint8", "b": "uint32", "c": "int64"}, keep=("event_id",))


@_query("""SELECT CAST(o_orderkey AS VARCHAR) AS key, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '","none":null}' AS value FROM orders""")
def encode_json(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.lit(None).cast("string").alias("none"))
    return encode.encode(rows, "json", "o_orderkey")


@_query("SELECT event_id, coalesce(CAST(nullif(user_id % 10, 0) AS VARCHAR), 'None') AS key FROM events")
def encode_key(spark, folder):
    rows = _with_null_keys(_events(spark, folder))
    return rows.select("event_id", encode.message_key(rows, "k").alias("key"))


def _reject_large():
    """A sink that takes tables without a value of 95 or more."""
    import pyarrow.compute as pc

    def insert(data):
        if pc.any(pc.greater_equal(data["value"], 95.0)).as_py():
            raise ValueError("value out of range")

    return insert


def _rejected(spark, folder) -> DataFrame:
    rows = _events(spark, folder).select("event_id", "value")
    return isolate.insert_isolating(rows, _reject_large, wait=0.0)


@_query("SELECT event_id, value FROM events WHERE value >= 95")
def dlq_rejected(spark, folder):
    return _rejected(spark, folder)


@_query("SELECT event_id, value FROM events WHERE value < 95 OR value IS NULL")
def dlq_accepted(spark, folder):
    """What the sink took, as the sink itself tells."""
    rows = _events(spark, folder).select("event_id", "value")

    def run(batches):
        import pyarrow as pa

        reject = _reject_large()
        for batch in batches:
            taken = []

            def insert(data):
                reject(data)
                taken.append(data)

            for _ in isolate.rejected(insert, pa.Table.from_batches([batch]), wait=0.0):
                pass
            for part in taken:
                yield from part.to_batches()

    return rows.mapInArrow(run, rows.schema)


@_query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def el_passthrough(spark, folder):
    """Encoded as JSON messages, decoded under a declared schema, and delivered as they were."""
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    declared = {"o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "string"}
    return decode.strict(encode.encode(rows), declared)


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def arrow_roundtrip(spark, folder):
    """Encoded as one Arrow message and read back from it."""
    rows = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for value in batch.column(0).to_pylist():
                yield from pa.ipc.open_stream(value)

    return encode.encode(rows, "arrow-batch").select("value").mapInArrow(read, rows.schema)
