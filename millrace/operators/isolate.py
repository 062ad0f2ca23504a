"""Inserts with retries, and isolation of the rows that a sink rejects.

A sink is any callable that takes an Arrow table and either stores it or raises; if it has a `close`, that is called when
its task ends, however it ends. Work is done on executors, one Arrow
batch at a time, so a table of any size is inserted in parallel; rejected rows come back as a DataFrame. An insert may
happen again when a task or a batch is run again: delivery is at least once.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame

log = logging.getLogger(__name__)

#: Fixed values of the insert policy.
ATTEMPTS = 3
WAIT_SECONDS = 1.0
SPLIT_FACTOR = 10

Insert = Callable[[pa.Table], None]


def insert_with_retry(insert: Insert, table: pa.Table, attempts: int = ATTEMPTS, wait: float = WAIT_SECONDS, sleep: Callable[[float], None] = time.sleep) -> None:
    """Calls `insert` until it succeeds, `attempts` times at most; the last error is the caller's."""
    for attempt in range(1, attempts + 1):
        try:
            return insert(table)
        except Exception as error:
            if attempt == attempts:
                raise
            log.warning("insert of %d rows failed at attempt %d of %d: %s", table.num_rows, attempt, attempts, error)
            sleep(wait)


def rejected(insert: Insert, table: pa.Table, factor: int = SPLIT_FACTOR, **retry) -> Iterator[pa.Table]:
    """Inserts what can be inserted and yields the rows that can't, one by one and in order.

    Ranges that fail are worked off from a stack, each cut in chunks of a `factor`-th of its rows.
    """
    if factor < 2:
        raise ValueError("the split factor must be 2 or more, or a failing chunk would never shrink")
    pending = [(0, table.num_rows)] if table.num_rows else []
    while pending:
        start, stop = pending.pop()
        part = table.slice(start, stop - start)
        try:
            insert_with_retry(insert, part, **retry)
        except Exception as error:
            if len(part) == 1:
                log.info("a row is rejected: %s", error)
                yield part
                continue
            size = max(1, len(part) // factor)
            log.info("%d rows failed, going on with chunks of %d: %s", len(part), size, error)
            pending += [(k, min(k + size, stop)) for k in range(start, stop, size)][::-1]


@contextmanager
def _opened(connect: Callable[[], Insert]) -> Iterator[Insert]:
    insert = connect()
    try:
        yield insert
    finally:
        getattr(insert, "close", lambda: None)()


def insert_isolating(df: DataFrame, connect: Callable[[], Insert], factor: int = SPLIT_FACTOR, whole_first: bool = True, **retry) -> DataFrame:
    """Lazily inserts `df` and returns the rejected rows, with its schema; `connect` makes the sink within each task.

    Materialise the result once: reading it twice inserts twice. With `whole_first` each batch is tried as a whole, with
    its own retries, before it is taken apart.
    """
    if factor < 2:
        raise ValueError("the split factor must be 2 or more, or a failing chunk would never shrink")

    def run(batches):
        with _opened(connect) as insert:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                if whole_first:
                    try:
                        insert_with_retry(insert, table, **retry)
                        continue
                    except Exception as error:
                        log.warning("batch of %d rows failed: %s", len(table), error)
                for part in rejected(insert, table, factor, **retry):
                    yield from part.to_batches()

    return df.mapInArrow(run, df.schema)


def insert_all(df: DataFrame, connect: Callable[[], Insert], **retry) -> None:
    """Inserts `df`; the first batch that fails for good fails the job."""

    def run(batches):
        with _opened(connect) as insert:
            for batch in batches:
                insert_with_retry(insert, pa.Table.from_batches([batch]), **retry)
        yield from ()

    df.mapInArrow(run, "ok boolean").write.format("noop").mode("overwrite").save()
