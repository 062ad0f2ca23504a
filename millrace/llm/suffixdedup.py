"""Suffix-array dedup: bytes in strings of `LENGTH` bytes that stand elsewhere too, by external induced sorting.

1. Every window of LENGTH bytes has a key, the least hash of the strings of `GRAMS[0]` bytes in it, so equal windows have
   equal keys wherever they stand. Neighbouring windows share their key for about 70 positions on end; such a run is
   a span, and every window is in exactly one.
2. A key that occurs once in the corpus, by one string of its span, has no repeated window; that span is dropped. Of the
   rest, spans equal in full are kept once, with their number, before any text moves: a passage in a third of all documents
   is one text here.
3. Texts of keys with several different spans go to shards of about `SHARD_BYTES` by key. Each shard is one string, sorted
   by external induction (`suffixes`) with queues, names and all arrays on disk; it has several times the entries that
   queues hold in memory and names beyond what is sorted there, so that queues spill and names recurse. Neighbours in
   suffix order with a common prefix of LENGTH bytes are equal windows.
4. A key with over half a shard of texts is a frequent passage with another continuation in each document. Its texts are
   keyed again by longer strings; if such a key is still too large, its windows are counted one by one under the hash of
   the whole window. So no task gets a hot key, however large it is.
5. Spans take the repeated windows of their text back, documents their spans; covered bytes are removed.

What counts as equal: spans of a key (steps 2 and 3) and single windows (step 4) whose hashes of 128 bits are equal are taken
as equal without another look at their bytes; everything else is compared byte by byte. No step samples or drops a text.
Joins are never broadcast, as none of their sides is bounded; the plan is the same at every size.

Defined cases: a null text is an empty one; texts shorter than LENGTH have no window; rows repeated in full are
documents that repeat each other; null ids are ordinary; windows may overlap and may repeat within one text; removed
bytes may leave incomplete characters, so kept bytes are binary; an empty table gives an empty result; columns that
aren't asked for by `carry` are left behind.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import suffixes
from millrace.llm.common import table
from millrace.stages import cut

LENGTH = 200
#: Lengths of the strings whose least hash is a window's key: of all texts, then of the texts of keys that are too large.
GRAMS = (64, 128)
#: Windows of a span at most; a longer run of one key is several spans.
RUN = 1024
#: Bytes of text that a shard is planned for.
SHARD_BYTES = 4_000_000
#: Texts are hashed in blocks of about so many bytes; longer ones in pieces that overlap by a window.
BLOCK_BYTES = 500_000
_BASE, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _hashes(block: list[bytes], most: int) -> tuple[np.ndarray, int]:
    """Hash of the string of `gram` bytes at each place of the joined texts, and gram, the largest power of two up to `most`."""
    h, power, k = _BYTE[np.frombuffer(b"".join(block), np.uint8)], 0x9E3779B97F4A7C15, 1
    while k * 2 <= most:
        h = h[:-k] * np.uint64(power) + h[k:]
        power, k = power * power % (1 << 64), k * 2
    return _mix(h), k


def _content(h: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hash of the `count` strings from each of `begin` on; `begin` ascends."""
    sums = np.r_[np.uint64(0), np.cumsum(_mix(h + _BASE) * _powers(len(h), _BASE))]
    return _mix((sums[begin + count] - sums[begin]) * _powers(int(begin[-1]) + 1, _BACK)[begin] + count.astype(np.uint64))


def single_windows(block: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, start, key, content) of every window by itself; its key are its first and last strings."""
    size = np.array([len(b) for b in block], np.int64)
    windows = np.maximum(0, size - length + 1)
    if not windows.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    h, gram = _hashes(block, min(GRAMS[0], length))
    start, ends = np.cumsum(size) - size, np.cumsum(windows)
    at = np.arange(ends[-1]) + np.repeat(start - (ends - windows), windows)
    text = np.repeat(np.arange(len(block)), windows)
    key = _mix(h[at] * np.uint64(3) + h[at + length - gram])
    return text, at - start[text], key, _content(h, at, np.full(len(at), length - gram + 1))


def spans(block: list[bytes], length: int = LENGTH, most: int = GRAMS[0]) -> tuple[np.ndarray, ...]:
    """(text, start, windows, key, content) of all spans of a block's texts; content tells spans of one key apart.

    The number of windows is negative where a span may repeat a window of its own.
    """
    size = np.array([len(b) for b in block], np.int64)
    windows = np.maximum(0, size - length + 1)
    if not windows.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    h, gram = _hashes(block, min(most, length))
    low, k, width = h, 1, length - gram + 1
    while k * 2 <= width:
        low, k = np.minimum(low[:-k], low[k:]), k * 2
    if width > k:
        low = np.minimum(low[: len(low) - (width - k)], low[width - k :])
    start = np.cumsum(size) - size
    ends = np.cumsum(windows)
    at = np.arange(ends[-1]) + np.repeat(start - (ends - windows), windows)
    key = low[at]
    first = np.r_[True, key[1:] != key[:-1]]
    first[(ends - windows)[windows > 0]] = True
    run = np.flatnonzero(first)
    n = np.diff(np.r_[run, len(at)])
    if n.max() > RUN:
        pieces = -(-n // RUN)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        run = np.repeat(run, pieces) + step * RUN
        n = np.minimum(RUN, np.repeat(n, pieces) - step * RUN)
    begin = at[run]
    content = _content(h, begin, n + (length - gram))
    # equal windows of one span have the least string at the same offset, so it is there twice: those spans are marked
    wide = n + (length - gram)
    spot = np.cumsum(wide) - wide
    least = h[np.arange(wide.sum()) + np.repeat(begin - spot, wide)] == np.repeat(key[run], wide)
    twice = np.add.reduceat(least, spot, dtype=np.int64) > 1
    text = np.searchsorted(ends, run, "right")
    return text, begin - start[text], np.where(twice, -n, n), key[run], content


def _pieces(texts, length: int):
    """Blocks of (text number, offset, bytes): every window of every text is in one piece, and no block is much over its size."""
    got, size = [], 0
    for k, raw in enumerate(texts):
        for at in range(0, max(1, len(raw) - length + 1), BLOCK_BYTES):
            piece = raw[at : at + BLOCK_BYTES + length - 1]
            if got and size + len(piece) > BLOCK_BYTES:
                yield got
                got, size = [], 0
            got.append((k, at, piece))
            size += len(piece)
    if got:
        yield got


def _spans_of(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            d, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for block in _pieces(batch.column(2).to_pylist(), length):
                text, start, n, key, content = spans([p[2] for p in block], length, gram)
                start = start + np.array([p[1] for p in block])[text]
                text = np.array([p[0] for p in block])[text]
                yield pa.RecordBatch.from_arrays([pa.array(d[text]), pa.array(c[text]), pa.array(start), pa.array(n.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(content.view(np.int64))], names=["_d", "_c", "start", "n", "key", "content"])

    return rows.select("_d", "_c", "_text").mapInArrow(run, "_d long, _c long, start long, n int, key long, content long")


def shard_repeats(texts, folder: str, length: int = LENGTH, **limits):
    """(number, weight, from, to): runs of window starts whose `length` bytes start elsewhere too, in one text or another.

    `texts` gives (weight, bytes); a text of weight over 1 stands for several equal ones and has no runs of its own. They are
    gone through once and written to `folder`; apart from their lengths and weights nothing of them is held.
    """
    path = os.path.join(folder, "text")
    sizes, weights = [], []
    with open(path, "wb") as f:
        for weight, t in texts:
            sizes.append(len(t))
            weights.append(weight)
            f.write((np.frombuffer(t, np.uint8) + np.uint8(1)).tobytes() + b"\0")  # no byte of UTF-8 is 255
    ends = np.cumsum(np.array(sizes, np.int64) + 1)
    if not len(ends):
        return
    again, last = suffixes.array(folder, int(ends[-1]), bool), None
    for at, lcp in suffixes.suffixes(np.asarray(np.memmap(path, np.uint8, "r")), folder, cap=length, **limits):
        near = np.flatnonzero(lcp >= length)
        again[at[near]] = True
        again[at[near[near > 0] - 1]] = True
        if last is not None and len(near) and near[0] == 0:
            again[last] = True
        last = at[-1]
    for k, end in enumerate(ends.tolist()):
        windows = max(0, sizes[k] - length + 1)
        if weights[k] == 1 and windows:
            start = end - 1 - sizes[k]
            edge = np.flatnonzero(np.diff(np.r_[False, again[start : start + windows], False].astype(np.int8)))
            yield from ((k, a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _sort_shards(texts: DataFrame, length: int) -> DataFrame:
    """One shard per partition, sorted by (key, content): (key, content, weight, span) to the repeated window runs of texts of weight 1."""

    def run(batches):
        key, content = [], []

        def once():
            for batch in batches:
                for k, c, weight, span in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if not key or (k, c) != (key[-1], content[-1]):  # rows repeated in full bring a text twice
                        key.append(k)
                        content.append(c)
                        yield weight, span

        held = []

        def out():
            columns = [pa.array([key[h[0]] for h in held], pa.int64()), pa.array([content[h[0]] for h in held], pa.int64()), *(pa.array([h[k] for h in held], pa.int32()) for k in (1, 2))]
            return pa.RecordBatch.from_arrays(columns, names=["key", "content", "a", "b"])

        with suffixes.scratch() as folder:
            for found in shard_repeats(once(), folder, length):
                held.append(found)
                if len(held) >= 50_000:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return texts.mapInArrow(run, "key long, content long, a int, b int")


def _deal_windows(texts: DataFrame, length: int) -> DataFrame:
    """(_d, _c, _text) to the repeated windows (_d, _c, a, b) of these texts, counted one by one under the hash of the whole
    window by an aggregate that combines on the map side: no task gets a whole key."""

    def run(batches):
        for batch in batches:
            d, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for start in range(0, batch.num_rows, 1000):
                text, at, window, rest = single_windows(batch.column(2).slice(start, 1000).to_pylist(), length)
                text = text + start
                yield pa.RecordBatch.from_arrays([pa.array(window.view(np.int64)), pa.array(rest.view(np.int64)), pa.array(d[text]), pa.array(c[text]), pa.array(at)], names=["w", "r", "_d", "_c", "a"])

    windows = cut(texts.select("_d", "_c", "_text").mapInArrow(run, "w long, r long, _d long, _c long, a long"), "suffix-windows")
    again = windows.groupBy("w", "r").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("w", "r")
    return windows.join(again.hint("merge"), ["w", "r"]).select("_d", "_c", "a", (F.col("a") + 1).alias("b"))


def _repeats(rows: DataFrame, length: int, grams: tuple[int, ...]) -> DataFrame:
    """(_d, _c, _text) to (_d, _c, a, b): runs of window starts whose `length` bytes start elsewhere too."""
    found = _spans_of(rows, length, grams[0])
    keys = found.groupBy("key").agg(F.sum(F.when(F.col("n") < 0, 2).otherwise(1)).alias("_n")).where("_n > 1").select("key")
    met = cut(found.join(keys.hint("merge"), "key", "left_semi"), "suffix-spans")
    distinct = cut(met.groupBy("key", "content").agg(F.count(F.lit(1)).alias("weight"), F.min("n").alias("n"), F.min(F.struct("_d", "_c", "start")).alias("at")), "suffix-texts")
    size = F.abs("n") + (length - 1)
    several = distinct.groupBy("key").agg(F.sum(F.when(F.col("n") < 0, 2).otherwise(1)).alias("_n"), F.sum(size).alias("_bytes")).where("_n > 1").select("key", (F.col("_bytes") > SHARD_BYTES // 2).alias("_many"), "_bytes")
    few, many, total = several.agg(F.count_if(~F.col("_many")), F.count_if("_many"), F.sum(F.when(~F.col("_many"), F.col("_bytes")))).first()
    runs = []

    def texts_of(which) -> DataFrame:
        part = distinct.join(several.where(which).select("key").hint("merge"), "key")
        part = part.select("key", "content", "weight", F.abs("n").alias("n"), F.col("at._d").alias("_d"), F.col("at._c").alias("_c"), F.col("at.start").alias("start"))
        span = F.substring(F.col("_text"), (F.col("start") + 1).cast("int"), F.col("n") + (length - 1)).alias("span")
        return part.join(rows.hint("merge"), ["_d", "_c"]).select("key", "content", "weight", span)

    if few:
        dealt = texts_of(~F.col("_many")).repartition(max(1, -(-total // SHARD_BYTES)), "key")
        runs.append(_sort_shards(dealt.sortWithinPartitions("key", "content"), length))
    if many:
        large = cut(texts_of(F.col("_many")).dropDuplicates(["key", "content"]).select(F.col("key").alias("_d"), F.col("content").alias("_c"), F.col("span").alias("_text")), "suffix-large")
        deeper = _repeats(large, length, grams[1:]) if len(grams) > 1 else _deal_windows(large, length)
        runs.append(deeper.select(F.col("_d").alias("key"), F.col("_c").alias("content"), F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")))
    known = distinct.where("weight > 1").select("key", "content", F.lit(0).alias("a"), F.abs("n").alias("b"))
    for r in runs:
        known = known.union(r)
    return met.join(known.hint("merge"), ["key", "content"]).select("_d", "_c", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, *, row_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_bytes, removed (array of [start, end) in bytes, maximal), kept (binary) and `carried_<name>`."""
    body = F.coalesce(F.col(text), F.lit(""))
    ident = F.col(row_id).cast("long") if docs.schema[row_id].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(F.col(row_id).cast("string"))
    rows = docs.select(
        F.col(row_id).alias("doc_id"),
        body.cast("binary").alias("_text"),
        F.when(F.col(row_id).isNull(), F.xxhash64(body)).otherwise(ident).alias("_d"),
        F.crc32(body.cast("binary")).alias("_c"),
        *[F.col(c).alias(f"carried_{c}") for c in carry],
    )
    marks = _repeats(rows.select("_d", "_c", "_text"), length, GRAMS)
    lists = marks.groupBy("_d", "_c").agg(F.collect_list(F.struct("a", (F.col("b") + (length - 1)).alias("b"))).alias("_marks"))
    out = rows.join(lists.hint("merge"), ["_d", "_c"], "left").drop("_d", "_c")
    schema = out.schema
    names = [f.name for f in schema.fields if f.name not in ("_text", "_marks")]

    def strip(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            made = []
            for raw, marks in zip(batch.column(at("_text")).to_pylist(), batch.column(at("_marks")).to_pylist(), strict=True):
                gone = _merge(marks or ())
                keep = [raw[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(raw)], strict=True)]
                made.append((len(raw), gone, b"".join(keep)))
            columns = [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.list_(pa.list_(pa.int64()))), pa.array([m[2] for m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in names), *columns], names=[*names, "n_bytes", "removed", "kept"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name in names)
    return out.mapInArrow(strip, f"{fields}, n_bytes long, removed array<array<long>>, kept binary")


def _merge(marks) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted((m["a"], m["b"]) for m in marks):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0])
    return out.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
#: DuckDB has no byte windows over text; tests/llm holds the query against a brute-force version.
SQL: dict[str, str] = {}
