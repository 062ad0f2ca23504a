"""Document fingerprints: improbable-feature digests.

Features are byte windows. Each window of a text gets the rank of its Shannon entropy among the entropies of all
windows of the corpus, rarest first. In every run of `RUN` neighbouring windows the leftmost of lowest rank scores a
point, and windows with at least `POINTS` points are the text's features: improbable ones, chosen alike wherever the
same passage stands. Distinct features go, in order, into a chain of Bloom filters of `FILTER_BITS` bits with at most
`PER_FILTER` features each. Two digests are compared filter by filter: the bits in common, less those expected by
chance, over the most that could be in common; each filter of the shorter digest takes its best partner, and filters
count by their bits. (After Roussev's similarity digests, 2010.)

Defined cases: a null text is an empty one; an empty text has an empty digest, which is like another empty one (1) and
unlike all others (0); short texts keep more and shorter windows (`FEW`, `SHORT_TEXT`); a text whose windows all score too
little keeps those with the most points; equal texts have equal digests, whatever else the corpus holds beside the rank table; ids
are of any type that has an order; null ids come last; rows with equal ids are ordered by text; a table of one row is its own next row; an empty table gives
an empty result; columns that aren't asked for are left behind.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType

from millrace.llm.common import global_index, partitions, ranged, split_join, table
from millrace.stages import cut

WINDOW = 64
RUN = 64
POINTS = 16
#: Texts of fewer windows keep every window with a point.
FEW = 1024
#: Texts of fewer bytes also keep all their windows of SHORT bytes.
SHORT_TEXT, SHORT = 256, 8
FILTER_BITS = 2048
PER_FILTER = 160
HASHES = 5
BINS = 1024
#: Texts are taken in blocks of about so many bytes, to bound memory; longer ones in pieces.
BLOCK_BYTES = 750_000
_LANE = 512
#: Integer steps of c log2 c from c to c + 1, so that sliding sums are exact.
_STEP = np.diff(np.round(4096 * np.arange(WINDOW + 1) * np.log2(np.maximum(1, np.arange(WINDOW + 1))))).astype(np.int32)
_TOP = int(_STEP.sum())


def entropy_bins(raw: np.ndarray) -> np.ndarray:
    """Bin of the entropy of each window of `raw`, 0 for the highest; lanes of the text slide in step."""
    m = len(raw) - WINDOW + 1
    lanes = -(-m // _LANE)
    padded = np.zeros(lanes * _LANE + WINDOW, np.uint8)
    padded[: len(raw)] = raw
    steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (_LANE + WINDOW - 1, lanes), (1, _LANE)))
    base = np.arange(lanes, dtype=np.int32) << 8
    count, total = np.zeros(lanes << 8, np.uint8), np.zeros(lanes, np.int32)
    out = np.empty((_LANE, lanes), np.int32)
    for j in range(_LANE + WINDOW - 1):
        at = base | steps[j]
        c = count[at]
        total += _STEP[c]
        count[at] = c + 1
        if j >= WINDOW - 1:
            out[j - WINDOW + 1] = total
            at = base | steps[j - WINDOW + 1]
            c = count[at] - 1
            total -= _STEP[c]
            count[at] = c
    return (out.T.ravel()[:m].astype(np.int64) * (BINS - 1) // _TOP).astype(np.int16)


def _spans(block: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(b) for b in block], np.int64)
    return np.frombuffer(b"".join(block), np.uint8), np.cumsum(size) - size, size


def histogram(block: list[bytes]) -> np.ndarray:
    """Windows of the block's texts by entropy bin."""
    if len(block) == 1 and len(block[0]) > 2 * BLOCK_BYTES:  # in pieces that share WINDOW - 1 bytes
        return sum(histogram([block[0][a : a + BLOCK_BYTES + WINDOW - 1]]) for a in range(0, len(block[0]) - WINDOW + 1, BLOCK_BYTES))
    raw, start, size = _spans(block)
    if len(raw) < WINDOW:
        return np.zeros(BINS, np.int64)
    bins = entropy_bins(raw)
    crosses = np.zeros(len(raw) + 1, np.int32)
    for a, n in zip(start + np.maximum(0, size - WINDOW + 1), start + size, strict=True):
        crosses[a] += 1
        crosses[n] -= 1
    return np.bincount(bins[np.cumsum(crosses)[: len(bins)] == 0], minlength=BINS)


def _hash(features: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of WINDOW bytes."""
    h = np.full(len(features), 0x9E3779B97F4A7C15, np.uint64)
    for word in np.ascontiguousarray(features).view("<u8").T:
        h = (h ^ word) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def _winners(raw: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each place, the leftmost window of lowest rank in the run of windows from there on (fewer at the end)."""
    low = (rank[entropy_bins(raw)].astype(np.int64) << 40) | np.arange(len(raw) - WINDOW + 1)
    step = 1
    while step < RUN:
        low[:-step] = np.minimum(low[:-step], low[step:])
        step *= 2
    return low & ((1 << 40) - 1)


def _points(best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, points): how many neighbouring runs chose each place; places ascend."""
    turn = np.flatnonzero(np.r_[True, best[1:] != best[:-1]]) if len(best) else np.zeros(0, np.int64)
    return best[turn], np.diff(np.r_[turn, len(best)])


def _unique(hashes: np.ndarray) -> np.ndarray:
    _, at = np.unique(hashes, return_index=True)
    return hashes[np.sort(at)]


def _long_features(text: bytes, rank: np.ndarray) -> np.ndarray:
    """`features` of one long text, taken in pieces that overlap by a run of windows."""
    raw = np.frombuffer(text, np.uint8)
    runs, found = len(raw) - WINDOW - RUN + 2, []
    for a in range(0, runs, BLOCK_BYTES):
        b = min(runs, a + BLOCK_BYTES)
        place, points = _points(_winners(raw[a : b + RUN + WINDOW - 2], rank)[: b - a])
        found.append((place + a, points))
    place, points = (np.concatenate(x) for x in zip(*found, strict=True))
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])  # a place may win on both sides of a cut
    place, points = place[first], np.add.reduceat(points, first)
    chosen = place[points >= min(POINTS, points.max())]
    windows = np.lib.stride_tricks.sliding_window_view(raw, WINDOW)
    return _unique(np.concatenate([_hash(windows[chosen[k : k + 65_536]]) for k in range(0, len(chosen), 65_536)]))


def features(block: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Hashes of the chosen features of each text, in order and distinct."""
    if len(block) == 1 and len(block[0]) > BLOCK_BYTES + FEW:
        return [_long_features(block[0], rank)]
    raw, start, size = _spans(block)
    windows = np.maximum(0, size - WINDOW + 1)
    chosen = [np.zeros(0, np.int64)] * len(block)
    if len(raw) >= WINDOW:
        winners = _winners(raw, rank)
        runs = np.maximum(0, windows - RUN + 1)
        ends = np.cumsum(runs)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - runs), runs)
        place, points = _points(winners[at])
        first = np.searchsorted(place, start)
        last = np.searchsorted(place, start + size)
        for k in np.flatnonzero(windows):
            if runs[k]:
                p, w = points[first[k] : last[k]], place[first[k] : last[k]]
                chosen[k] = w[p >= min(POINTS if windows[k] >= FEW else 1, p.max())]
            else:
                chosen[k] = start[k] + np.arange(windows[k])
    counts = np.array([len(c) for c in chosen])
    flat = np.concatenate(chosen) if len(chosen) else np.zeros(0, np.int64)
    hashes = _hash(np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[flat]) if len(flat) else np.zeros(0, np.uint64)
    out = []
    for k, own in enumerate(np.split(hashes, np.cumsum(counts)[:-1])):
        if 0 < size[k] < SHORT_TEXT:
            short = np.frombuffer(block[k], np.uint8)
            short = np.lib.stride_tricks.sliding_window_view(short, min(SHORT, max(1, len(short) // 4)))
            own = np.r_[own, _hash(np.pad(short, ((0, 0), (0, WINDOW - short.shape[1])))) + np.uint64(1)]
        out.append(_unique(own))
    return out


def digest(hashes: np.ndarray) -> np.ndarray:
    """Chain of Bloom filters, one row of uint64 words each."""
    n = -(-len(hashes) // PER_FILTER)
    bits = np.zeros((n, FILTER_BITS), bool)
    row = np.arange(len(hashes)) // PER_FILTER
    a, b = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        bits[row, ((a + np.uint64(k) * b) % np.uint64(FILTER_BITS)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def text_of(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised bit overlap of two digests, 0 to 1; the order doesn't matter."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    n_a, n_b = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a, b))
    total = 0.0
    for row, n in zip(a, n_a, strict=True):
        common = np.bitwise_count(b & row).sum(1, dtype=np.int64)
        chance, most = n * n_b / FILTER_BITS, np.minimum(n, n_b)
        total += n * float(np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return total / float(n_a.sum())


def rank_table(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each entropy bin by its windows in all texts, rarest first; one row per bin reaches the driver."""

    def run(batches):
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for block in _blocks(t.as_py().encode() for t in batch.column(0) if t.is_valid):
                total += histogram(block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(total)], names=["bin", "n"])

    got = docs.select(text).mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(BINS, np.int64)
    for r in got:
        count[r["bin"]] = r["n"]
    rank = np.empty(BINS, np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(BINS)
    return rank


def _blocks(texts):
    got, size = [], 0
    for b in texts:
        if got and size + len(b) > BLOCK_BYTES:
            yield got
            got, size = [], 0
        got.append(b)
        size += len(b)
    if got:
        yield got


def fingerprints(docs: DataFrame, rank: np.ndarray, *, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each whole text; no shuffle."""

    def run(batches):
        for batch in batches:
            out = [text_of(digest(h)) for block in _blocks((t.as_py() or "").encode() for t in batch.column(1)) for h in features(block, rank)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(row_id).alias("doc_id"), text).mapInArrow(run, f"doc_id {docs.schema[row_id].dataType.simpleString()}, fingerprint string")


def _ordered_ids(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, _text) with `_o`, a long in the order of the ids: whole numbers stand for themselves, ids of other
    types get their places among the distinct ids."""
    if isinstance(rows.schema["doc_id"].dataType, IntegralType):
        return rows.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("_o", F.col("doc_id"))
    named = rows.where("doc_id is not null")
    counts = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    places = cut(global_index(ranged(counts, [F.col("doc_id")], "next-ids")).select("doc_id", "_n", F.col("_idx").alias("_o")), "next-places")
    return split_join(named, places, ["doc_id"]).unionByName(rows.where("doc_id is null"), allowMissingColumns=True)


def with_next(docs: DataFrame, *, row_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """Rows (doc_id, _text, _last) dealt to partitions in descending id order, each run of ids followed by its next row.

    Bounds come from the id column alone; the greatest row of each run is also dealt to the run before it, marked as
    a guest, so that every row stands before the one that comes next in the whole order (the first after the last).
    Texts are shuffled once. Two numbers per partition reach the driver.
    """
    n = partitions(docs.sparkSession)
    rows = _ordered_ids(docs.select(F.col(row_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")))
    order = F.coalesce("_o", F.lit(-(1 << 63)))
    bounds = rows.select(order.alias("o")).agg(F.percentile_approx("o", [k / n for k in range(1, n)] or [0.5], 10 * n).alias("b")).first()["b"] or []
    inner = np.unique(np.array(bounds[: n - 1], np.int64))

    @F.pandas_udf("int")
    def run_of(o):
        import pandas as pd

        return pd.Series(len(inner) - np.searchsorted(inner, o.to_numpy(), "left")).astype("int32")

    rows = rows.select("doc_id", "_text", order.alias("_o"), run_of(order).alias("_run"))
    tops = {r["_run"]: r["top"] for r in rows.groupBy("_run").agg(F.max("_o").alias("top")).collect()}
    runs = sorted(tops)
    before = {tops[k]: runs[i - 1] for i, k in enumerate(runs)}  # of the first run: the last
    guests = docs.sparkSession.createDataFrame([*before.items()], "_o long, _before int")
    dealt = rows.join(F.broadcast(guests), "_o", "left").withColumn("_to", F.explode(F.filter(F.array(F.struct(F.col("_run").alias("run"), F.lit(False).alias("guest")), F.struct(F.col("_before").alias("run"), F.lit(True).alias("guest"))), lambda x: x["run"].isNotNull())))
    dealt = dealt.select("doc_id", "_text", "_o", F.col("_to.run").alias("_run"), F.col("_to.guest").alias("_guest"))
    return dealt.repartitionById(n, F.col("_run")).sortWithinPartitions("_run", "_guest", F.col("_o").desc(), "_text").select("doc_id", "_text", "_run", "_guest"), n


def edited(text: str, following: str) -> str:
    """The last third of the code points gives way to as many of the next text's first (or all that it has)."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compare_with_next(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """For each row the digests of its text and of its edited text, and their likenesses."""

    dealt, _ = with_next(docs)
    kind = dealt.schema["doc_id"].dataType
    arrow_kind = to_arrow_type(kind)

    def run(batches):
        def out(rows):
            """All rows but the last, which only serves as the next one; guests follow the rows of their run."""
            keep = [k for k in range(len(rows) - 1) if not rows[k][3]]
            plain = [r[1].encode() for r in rows]
            changed = [edited(rows[k][1], rows[k + 1][1]).encode() for k in keep]
            chains = [digest(h) for block in _blocks(plain) for h in features(block, rank)]
            other = [digest(h) for block in _blocks(changed) for h in features(block, rank)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[k][0] for k in keep], arrow_kind),
                    pa.array([len(rows[k][1]) for k in keep], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
                    pa.array([text_of(chains[k]) for k in keep], pa.string()),
                    pa.array([text_of(c) for c in other], pa.string()),
                    pa.array([likeness(chains[k], c) for k, c in zip(keep, other, strict=True)], pa.float64()),
                    pa.array([likeness(chains[k], chains[k + 1]) for k in keep], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        held, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for row in zip(*(c.to_pylist() for c in batch.slice(start, 64).columns), strict=True):
                    held.append(row)
                    size += len(row[1])
                    if size > BLOCK_BYTES and len(held) > 1:
                        yield out(held)
                        held, size = held[-1:], len(held[-1][1])
        if held:
            yield out(held)  # the last row is a guest

    return dealt.mapInArrow(run, f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compare_with_next(docs, rank_table(docs))


QUERIES = {"op2_fingerprint": op2_fingerprint}
#: Entropy digests aren't SQL; tests/llm holds the query against a plain version and exact edits.
SQL: dict[str, str] = {}
