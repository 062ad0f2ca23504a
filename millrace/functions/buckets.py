"""Time buckets of a rolling window, and the text form of dedup keys."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def live_buckets(window_hours: int, bucket_hours: int) -> int:
    """Buckets that count as live, the current one included. A key marked in bucket b is forgotten from bucket b + N on,
    so after more than (N - 1) and at most N bucket lengths."""
    if window_hours <= 0 or bucket_hours <= 0:
        raise ValueError("window and bucket must be positive numbers of hours")
    return math.ceil(window_hours / bucket_hours)


def bucket(clock: Column, bucket_hours: int) -> Column:
    """Whole bucket lengths since the epoch. Times without a zone count as UTC, whatever the session's zone."""
    micros = F.unix_micros(clock.cast("timestamp"))
    local = F.unix_date(F.to_date(clock)).cast("bigint") * 24 + F.hour(clock)
    hours = F.when(F.typeof(clock) == "timestamp_ntz", local).otherwise(_whole(micros, 3_600_000_000))
    return _whole(hours, bucket_hours)


def _whole(n: Column, length: int) -> Column:
    """n / length rounded down; what is divided has no remainder, so it is exact."""
    return ((n - F.pmod(n, F.lit(length))) / length).cast("bigint")


def is_live(seen: Column, now: Column, window_hours: int, bucket_hours: int) -> Column:
    return now - seen < live_buckets(window_hours, bucket_hours)


def dedup_key(column: Column) -> Column:
    """Keys are compared as text: the number 1 and the text 1 are one key. Null stays null."""
    return column.cast("string")
