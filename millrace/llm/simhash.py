"""SimHash near-dedup by pigeonhole blocks.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles. Fingerprints are cut into
`BLOCKS` blocks; two that differ in at most `DISTANCE` bits agree on at least BLOCKS - DISTANCE whole blocks, so they
meet in the bucket of some combination of that many blocks (with 6 blocks and 3 bits: 20 keys of 31 to 33 bits, far
more selective than one block of 16 bits). Buckets hold distinct fingerprints only: exact copies collapse before any
join. Within a bucket Hamming distances are verified, and instead of all close pairs a spanning forest is returned,
which keeps every connection with fewer links than members.

A bucket of over `BUCKET` fingerprints is not gathered: fingerprints within 3 bits are exactly those that some centre
is at most 1 bit from one of and at most 2 bits from the other. Each fingerprint is dealt to the centres around it in
the bits the bucket leaves free; wherever a centre has a member within 1 bit, all its members are connected, and one
aggregate per centre links them to the smallest. That is linear in the members and combines before the shuffle.

Defined cases: null and empty texts and texts of white space have no shingle and fingerprint zero, linked like any
other; a text of fewer words than a shingle is one shingle; null ids never are the smallest unless all are null; rows
that repeat an id each return; an empty table gives an empty result; carried columns are renamed.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.llm.common import fresh, table
from millrace.llm.components import components
from millrace.stages import cut

SHINGLE = 3
DISTANCE = 3
BLOCKS = 6
#: Fingerprints of a bucket that one task compares pair by pair.
BUCKET = 8192
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash; sums of bits are taken over blocks of shingles, whatever the text's length."""
    own = _WORD.findall((text or "").encode().lower())
    if not own:
        return 0
    line = b" ".join(own)
    starts = np.zeros(len(own) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1, out=starts[1:])
    n = max(1, len(own) - shingle + 1)
    firsts, lasts = starts[:n].tolist(), (starts[min(shingle, len(own)) :][:n] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, 65_536):
        hashes = np.array([digest(line[i:j], _SEED) for i, j in zip(firsts[k : k + 65_536], lasts[k : k + 65_536], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Replaces `text` by `fp`, the fingerprint as a signed long."""
    spot = docs.columns.index(text)
    schema = StructType([*(StructField(f.name, f.dataType) for k, f in enumerate(docs.schema.fields) if k != spot), StructField("fp", LongType())])

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch.column(spot).to_pylist()], np.uint64).view(np.int64)
            rest = [c for k, c in enumerate(batch.columns) if k != spot]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(values, pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _masks(blocks: int, distance: int) -> list[int]:
    """Signed masks that keep each combination of blocks - distance blocks."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    whole = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints within `distance` bits: each new member to one that reached it."""
    left, links = np.unique(fps), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= distance
            if near.any():
                links += [(int(x), int(y)) for y in left[near]]
                front += list(left[near])
                left = left[~near]
    return links


def links(distinct: DataFrame, *, distance: int = DISTANCE, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints (column fp, distinct) whose chains of close pairs connect."""
    masks = _masks(blocks, distance)
    keys = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    sizes = keys.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(keys.join(sizes, ["t", "key"]), "simhash-buckets")

    def verify(batches):
        """Rows come sorted by bucket; one bucket is held at a time."""
        held, last = [], None

        def out():
            got = _forest(np.array(held, np.int64), distance)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=["a", "b"])

        for batch in batches:
            for t, key, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (t, key) != last and held:
                    yield out()
                    held = []
                last = (t, key)
                held.append(fp)
        if held:
            yield out()

    small = met.where(F.col("n") <= bucket).select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(verify, "a long, b long")
    return small.union(_around(met.where(F.col("n") > bucket), masks, distance)).distinct()


def _around(hot: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """Links within large buckets by shared centres; see the module's text. Without large buckets it has no rows to deal."""
    inner, outer = distance // 2, distance - distance // 2
    around = []
    for m in masks:
        free = [b for b in range(64) if not m >> b & 1]
        flips = [(k, sum(1 << b for b in c)) for k in range(outer + 1) for c in combinations(free, k)]
        around.append([(int(k <= inner), f - (1 << 64) if f >> 63 else f) for k, f in flips])

    def deal(batches):
        for batch in batches:
            for t, key, fp in zip(*(c.to_numpy() for c in batch.columns), strict=True):
                near, flips = (np.array(x, np.int64) for x in zip(*around[t], strict=True))
                n = len(flips)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(fp ^ flips), pa.array(near), pa.array(np.full(n, fp, np.int64))], names=["t", "centre", "near", "fp"])

    dealt = hot.select("t", "key", "fp").repartition("fp").mapInArrow(deal, "t int, centre long, near long, fp long")
    least = dealt.groupBy("t", "centre").agg(F.min("fp").alias("a"), F.max("near").alias("near"), F.count(F.lit(1)).alias("n")).where("near = 1 and n > 1").drop("near", "n")
    return dealt.select("t", "centre", F.col("fp").alias("b")).join(least, ["t", "centre"]).where("a <> b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, *, row_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (smallest doc_id of its group), root (the group's
    least fingerprint, never null) and `carried_<name>`."""
    rows = docs.select(F.col(row_id).alias("doc_id"), F.col(text).alias("_text"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    marked = cut(fingerprints(rows, text="_text", shingle=shingle), "simhash")
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(links(distinct.select("fp"), distance=distance), "a", "b")
    roots = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = roots.join(groups, "root").select("fp", "component_id", "root")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id", "root", *[f"carried_{c}" for c in carry])


def keep_one(docs: DataFrame, *, row_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` with one row of each near-duplicate group: the one with the smallest id, null ids last.

    Texts move once, for the join with the kept rows' digests; a row repeated in full stays once.
    """
    ident = F.md5(F.concat(F.coalesce(F.col(row_id).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    digest, n = fresh(docs, "row_digest"), fresh(docs, "n")
    tagged = docs.withColumn(digest, ident)
    groups = near_duplicates(tagged, row_id=row_id, text=text, carry=(digest,), **options)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(f"carried_{digest}").alias("digest")))
    kept = groups.groupBy("root").agg(first.alias("first")).select(F.col("first.digest").alias(digest))
    again = Window.partitionBy(digest).orderBy(digest)
    return tagged.join(kept, digest, "left_semi").withColumn(n, F.row_number().over(again)).where(F.col(n) == 1).drop(n, digest)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
#: DuckDB has no XXH64; tests/llm holds the query against a brute-force version.
SQL: dict[str, str] = {}
