"""Declared column types of a message schema."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql.types import DataType, DecimalType, IntegerType, LongType, ShortType, StringType, TimestampNTZType


@dataclass(frozen=True)
class Declared:
    """How a declared column is read: `sql` is what the JSON value must be, low and high bound an integer's value."""

    sql: str
    result: DataType
    low: int | None = None
    high: int | None = None


_STRING = Declared("string", StringType())
# The type names a schema may use, with what each admits. There are no wider unsigned types in Spark, so
# unsigned ones are carried by the next wider signed type and bounded.
DECLARED = {
    "string": _STRING,
    "int32": Declared("bigint", IntegerType(), -(2**31), 2**31 - 1),
    "int64": Declared("bigint", LongType(), -(2**63), 2**63 - 1),
    "uint32": Declared("bigint", LongType(), 0, 2**32 - 1),
    "uint64": Declared("decimal(20,0)", DecimalType(20, 0), 0, 2**64 - 1),
    "uint8": Declared("bigint", ShortType(), 0, 255),
    "int": Declared("bigint", IntegerType(), -(2**31), 2**31 - 1),
    "timestamp[ms]": Declared("bigint", TimestampNTZType(), -(2**63), 2**63 - 1),
}


def resolve(name: str) -> Declared:
    """The declared type of that name; unknown names fall back to string, with a warning."""
    if name not in DECLARED:
        warnings.warn(f"unknown type {name!r} is read as string", stacklevel=2)
    return DECLARED.get(name, _STRING)
