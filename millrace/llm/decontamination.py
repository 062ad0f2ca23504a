"""Benchmark decontamination: a prefix-filtered set join of item-sized windows.

Each benchmark item gives its windows of `window` consecutive words (one window of all words if it has fewer). A
document contains a window only if it contains all of its shingles, so at containment 1 the necessary prefix of a
window, with shingles ordered by document frequency over the whole corpus, is its rarest shingle alone. A document
position that holds such a shingle proposes the windows indexed under it; the shingle's offset in the window bounds
where the window begins, the document's length bounds where it ends, and only then are the words compared exactly.

The benchmark is the query set. It is taken in blocks of at most `BLOCK_WORDS` words, each broadcast and run over all
documents; a larger benchmark means more passes, never a larger broadcast. No text is shuffled.

Defined cases: null and empty texts, and texts of separators, have no words; items without words have no windows;
repeated items and items with common windows each count where their windows occur; a null item id counts as the text
`null`; empty tables give no hits or no rows; carried columns are renamed, so clashing names don't matter.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from millrace.llm.common import table
from millrace.stages import cut

WINDOW = 10
BLOCK_WORDS = 1_000_000
#: Words are digits, a-z and everything outside ASCII; in UTF-8 the latter are the bytes from 0x80 on.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())  # bytes.lower() changes A-Z only


class Index:
    """Windows of one block of items, and later the prefix shingle that each is found by."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, own in items:
            for i in range(max(1, len(own) - window + 1) if own else 0):
                self.owners[tuple(own[i : i + window])].add(item)
        self.windows = sorted(self.owners)
        self.items = [sorted(self.owners[w]) for w in self.windows]
        del self.owners
        self.follow: dict[bytes, dict[bytes, int]] = {}  # first word -> second -> number of the shingle
        self.singles: dict[bytes, int] = {}  # windows of one word
        self.shingles = 0
        for w in self.windows:
            for a, b in zip(w, w[1:], strict=False):
                if b not in (after := self.follow.setdefault(a, {})):
                    after[b] = self.shingles
                    self.shingles += 1
            if len(w) == 1:
                self.singles.setdefault(w[0], len(self.singles))

    def found(self, own: list[bytes]):
        """(position, shingle) for each shingle of the block in a document's words."""
        follow, end = self.follow, len(own) - 1
        for i, w in enumerate(own):
            if i < end and w in follow and (k := follow[w].get(own[i + 1])) is not None:
                yield i, k

    def choose(self, frequency: dict[int, int]) -> None:
        """Keeps for each window its rarest shingle, ties by text order, and drops the other shingles."""
        self.by_shingle: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.by_single: dict[bytes, list[int]] = defaultdict(list)
        kept = set()
        for n, w in enumerate(self.windows):
            if len(w) == 1:
                self.by_single[w[0]].append(n)
            else:
                at = min(range(len(w) - 1), key=lambda i: (frequency.get(self.follow[w[i]][w[i + 1]], 0), w[i], w[i + 1], i))
                k = self.follow[w[at]][w[at + 1]]
                kept.add(k)
                self.by_shingle[k].append((n, at))
        self.follow = {a: rest for a, after in self.follow.items() if (rest := {b: k for b, k in after.items() if k in kept})}

    def match(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [start, end) spans of hit words, and the items whose windows occur."""
        spans, items = [], set()
        n = len(own)
        for i, k in self.found(own):
            for w, at in self.by_shingle[k]:
                start, want = i - at, self.windows[w]
                if start >= 0 and start + len(want) <= n and tuple(own[start : start + len(want)]) == want:
                    spans.append((start, start + len(want)))
                    items.update(self.items[w])
        if self.by_single:
            for i, w in enumerate(own):
                for k in self.by_single.get(w, ()):
                    spans.append((i, i + 1))
                    items.update(self.items[k])
        return merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _frequencies(docs: DataFrame, index: Index) -> dict[int, int]:
    """In how many documents each shingle of the block occurs, over all documents; at most one row per shingle returns."""

    def count(batches):
        seen: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update({k for _, k in index.found(words(text))})
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["k", "n"])

    got = docs.select("_text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return {r["k"]: r["n"] for r in got.toLocalIterator()}


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int):
    """Benchmark items in blocks of bounded size; which block an item is in depends on its hash."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // (2 * block_words)) or 1  # a word and its separator take two bytes at least
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()
        yield Index([(r["item"], words(r["text"])) for r in part], window), n


def find_windows(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, row_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_words, spans (array of [start, end) in words), items (sorted ids) and `carried_<name>`."""
    rows = docs.select(F.col(row_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    spans_type, items_type = ArrayType(ArrayType(LongType())), ArrayType(StringType())
    out = rows.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.lit(None).cast(spans_type), "items": F.lit(None).cast(items_type)})
    schema = StructType([StructField(f.name, f.dataType) for f in out.schema.fields])
    arrow = {"n_words": pa.int64(), "spans": pa.list_(pa.list_(pa.int64())), "items": pa.list_(pa.string())}

    for index, n in _blocks(benchmark, item_id, item_text, window, block_words):
        index.choose(_frequencies(rows, index))
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                made = {"n_words": [], "spans": [], "items": []}
                at = batch.schema.get_field_index
                for body, spans, items in zip(*(batch.column(at(c)).to_pylist() for c in ("_text", "spans", "items")), strict=True):
                    own = words(body)
                    new_spans, new_items = index.match(own)
                    made["n_words"].append(len(own))
                    made["spans"].append(merge([*map(tuple, spans or ()), *new_spans]))
                    made["items"].append(sorted({*(items or ()), *new_items}))
                columns = [pa.array(made[c], arrow[c]) if c in made else batch.column(at(c)) for c in batch.schema.names]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        out = out.mapInArrow(run, schema)
        if n > 1:  # one block at a time in a worker's memory
            out = cut(out, "decontamination")
    return out.drop("_text")


def _sha256_of_list(items):
    return F.sha2(F.array_join(items, ","), 256)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), _sha256_of_list(F.col("items")).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


QUERIES = {"op4_decontamination": op4_decontamination}
_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW} - 1], ' ') AS win
       FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - {WINDOW} + 1))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, dw.n, i, item FROM dw JOIN bw USING (n, win)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
}
