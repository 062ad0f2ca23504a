"""Encoding of rows as message values and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, MapType, StructType, TimestampNTZType, TimestampType

from millrace.functions.decode import path as _path

FORMATS = ("json", "arrow-batch")


def _iso(c: Column) -> Column:
    """ISO text with six digits of a second, or none if they are zero."""
    whole, digits = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(c, "SSSSSS")
    return F.when(digits == "000000", whole).otherwise(F.concat(whole, F.lit("."), digits))


def _plain(c: Column, kind: DataType) -> Column:
    """Values as JSON is to show them, at any depth: times as ISO text, NaN and infinities as null."""
    if isinstance(kind, TimestampNTZType):
        return _iso(c)
    if isinstance(kind, TimestampType):
        return F.concat(_iso(c), F.lit("+00:00"))
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_plain(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: _plain(v, kind.valueType))
    return c


def json_value(df: DataFrame) -> Column:
    """One JSON object per row, columns in order, null fields kept."""
    fields = [_plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def message_key(df: DataFrame, column: str | None, null_key: str = "None") -> Column:
    """Text of the key column; no key if there is no such column. A null key reads `null_key`."""
    if column is None or column not in df.columns:
        return F.lit(None).cast("string")
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, BooleanType):
        text = F.initcap(c.cast("string"))
    elif isinstance(kind, TimestampNTZType):
        text = F.replace(_iso(c), F.lit("T"), F.lit(" "))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(null_key))


def json_messages(df: DataFrame, key_column: str | None = None) -> DataFrame:
    return df.select(message_key(df, key_column).alias("key"), json_value(df).alias("value"))


def document_messages(df: DataFrame, doc: str = "doc", key_column: str | None = None, null_key: str = "None") -> DataFrame:
    """Messages of documents of any shape (variants). The key is that field's text; none if a document lacks the field."""
    key = F.lit(None).cast("string")
    if key_column is not None:
        field = F.try_variant_get(doc, _path(key_column), "variant")
        kind = F.schema_of_variant(field)
        text = F.when(kind == "BOOLEAN", F.initcap(F.try_variant_get(doc, _path(key_column), "string"))).otherwise(F.try_variant_get(doc, _path(key_column), "string"))
        key = F.when(kind.isNull(), key).otherwise(F.coalesce(text, F.lit(null_key)))
    return df.select(key.alias("key"), F.to_json(F.col(doc)).alias("value"))


def arrow_messages(df: DataFrame, per_partition: bool = False) -> DataFrame:
    """The batch as one Arrow IPC stream in one message without a key; an empty batch is a stream without rows.

    One message needs one task, and the message must fit in memory: a micro-batch is bounded by the source. With
    `per_partition` each partition becomes a message, for larger tables.
    """
    import pyarrow as pa

    rows = df if per_partition else df.coalesce(1)

    def write(batches):
        sink, writer = pa.BufferOutputStream(), None
        for batch in batches:
            writer = writer or pa.ipc.new_stream(sink, batch.schema)
            writer.write_batch(batch)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["key", "value"])

    return rows.mapInArrow(write, "key string, value binary")


def encode(df: DataFrame, format: str = "json", key_column: str | None = None) -> DataFrame:
    """Messages (key, value) of a batch in one of FORMATS."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}; known are {', '.join(FORMATS)}")
    return json_messages(df, key_column) if format == "json" else arrow_messages(df)
