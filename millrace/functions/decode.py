"""JSON decoding of message values as column expressions; each value is parsed once, to a variant.

Strict decoding fails the query, and with it the micro-batch, at the first bad message; messages name JSON parse
errors as such. Lenient decoding skips what doesn't parse. Two objects in one message count as the first of them, and
messages of any length parse; other than that, what is accepted is one JSON object with the declared value types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.functions.types import Declared, resolve


def schema_of(declared: dict[str, str]) -> StructType:
    """Decoded columns in the order of declaration; all may be null."""
    if not declared:
        raise ValueError("an empty schema would drop every message; declare at least one column")
    return StructType([StructField(c, resolve(t).result) for c, t in declared.items()])


def path(field: str) -> str:
    """The field's path in a variant."""
    quote = "'" if "'" not in field else '"'
    if quote in field:
        raise ValueError(f"field name {field!r} holds both kinds of quotes")
    return f"$[{quote}{field}{quote}]"


def _value(doc: Column, field: str, want: Declared) -> Column:
    at = path(field)
    found = F.try_variant_get(doc, at, "variant")
    kind = F.schema_of_variant(found)
    bad = F.raise_error(F.concat(F.lit(f"JSON parse error: column {field} can't be "), kind))
    if isinstance(want.result, StringType):
        value, fits = F.try_variant_get(doc, at, "string"), kind == "STRING"
    else:
        integral = (kind == "BIGINT") if want.sql == "bigint" else (kind == "BIGINT") | kind.isin("DECIMAL(19,0)", "DECIMAL(20,0)")
        number = F.try_variant_get(doc, at, want.sql)
        fits = integral
        if want.low is not None and (want.low, want.high) != (-(2**63), 2**63 - 1):
            fits = integral & number.between(F.lit(str(want.low)).cast(want.sql), F.lit(str(want.high)).cast(want.sql))
        if want.result.simpleString() == "timestamp_ntz":
            value = F.timestamp_add("MILLISECOND", number, F.lit("1970-01-01").cast("timestamp_ntz"))  # no session zone comes in
        else:
            value = number.cast(want.result)
    empty = kind.isNull() | (kind == "VOID")
    return F.when(empty, F.lit(None).cast(want.result)).when(fits, value).otherwise(bad.cast(want.result)).alias(field)


def strict(messages: DataFrame, declared: dict[str, str], *, value: str = "value", keep: tuple[str, ...] = (), observe: str | None = None) -> DataFrame:
    """`keep` columns, then the declared columns of each message; extra fields go, missing ones are null.

    Blank messages vanish; a null value, anything but one JSON object, and a value of another type fail the query. With
    `observe`, metrics of that name count messages and rows.
    """
    schema_of(declared)
    blank = F.regexp_like("_text", F.lit(r"^\s*$"))
    text = F.col(value).cast("string")
    checked = messages.withColumn("_text", F.when(F.col(value).isNull(), F.raise_error(F.lit("message without a value"))).otherwise(text))
    if observe:
        checked = checked.observe(observe, F.count(F.lit(1)).alias("messages"), F.count_if(~blank).alias("rows"))
    checked = checked.where(~blank)
    parsed = F.when(F.regexp_like("_text", F.lit(r"^\s*\{")), F.try_parse_json("_text"))
    doc = checked.withColumn("_doc", F.coalesce(parsed, F.parse_json(F.raise_error(F.lit("JSON parse error: a message is no JSON object")).cast("string"))))
    return doc.select(*keep, *[_value(F.col("_doc"), c, resolve(t)) for c, t in declared.items()])


def lenient(messages: DataFrame, *, value: str = "value", keep: tuple[str, ...] = (), observe: str | None = None) -> DataFrame:
    """`keep` columns and `doc`, the message as a variant of any shape; messages that don't parse are skipped."""
    docs = messages.select(*keep, F.try_parse_json(F.col(value).cast("string")).alias("doc"))
    if observe:
        docs = docs.observe(observe, F.count(F.lit(1)).alias("messages"), F.count_if(F.col("doc").isNull()).alias("rejected"))
    return docs.where("doc is not null")
