"""SimHash near-dedup at a likeness: wide fingerprints, blocks that close pairs share, verified Hamming distance.

The fingerprint of a text has BLOCKS blocks of 24 bits; each bit is the majority over the distinct word shingles of the
text, each hashed to as many bits. Two sets whose shared part of the union is `like` have an angle between them, and each
bit differs with that angle's share of a half turn: 0.152 at a likeness of 0.8. Pairs that differ in fewer bits than there
are blocks always share one; at 0.8 two sets share 2.4 blocks on average (9 of 10 such pairs share one or more), at 0.9
they share 9. Fingerprints are joined on (block, value) and verified by Hamming distance; sets of up to `SMALL` shingles, for
which the angle is a poor measure, are compared themselves. Equal sets collapse to one row before any join.

Pairs are proposed in two rounds. First each fingerprint is held against one other: of the least ones of its buckets that
with which it shares most of them. That is a pair for each row and joins large groups; the aggregate behind it combines on
the map side, and no bucket can have more than one in BLOCKS of all rows. Then only buckets that still hold several
groups are compared, inside tasks: no pair leaves a task before it is verified. A bucket of over `TILE` fingerprints is
compared in tiles, so that none is gathered.

Defined cases: null and empty texts and texts of white space are copies of each other; a text of fewer words than a
shingle is one shingle; null ids come last; a row repeated in full stays once; an empty table gives an empty result;
columns of the input keep their names, whatever they are.
"""

from __future__ import annotations

from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import fresh
from millrace.llm.components import components
from millrace.stages import cut

SHINGLE = 5
LIKE = 0.8
#: Blocks of 24 bits; a multiple of 8, so that a fingerprint is a whole number of 64-bit words.
BLOCKS = 128
WORDS = BLOCKS * 24 // 64
#: Words of the fingerprint that buckets are compared on before a pair is proposed.
ROUGH = 8
#: Bits of the 128 that an entry carries beside its block in which like sets differ at most: small sets, of which most may differ,
#: are expected to differ in 24, with a standard deviation of 4.4; others in 20. Of chance pairs 0.2 % differ in so few.
SKETCH = 47
#: Entries of a bucket up to which they are compared before any leaves the task.
CROWD = 256
#: Sets up to this size are compared by their members.
SMALL = 64
#: Fingerprints of a bucket that one task compares with each other.
TILE = 4096
#: Texts are hashed in blocks of about so many bytes; longer ones in pieces.
BLOCK_BYTES = 500_000
_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[_LOWER]
_SALT = _mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_ODD, BLOCK_BYTES + 2), _powers(pow(_ODD, -1, 1 << 64), BLOCK_BYTES + 2)


def _pieces(raw: bytes):
    """A text in parts of at most BLOCK_BYTES that end after white space; a longer word is cut."""
    while len(raw) > BLOCK_BYTES:
        gaps = np.flatnonzero(_SPACE[np.frombuffer(raw[:BLOCK_BYTES], np.uint8)])
        end = int(gaps[-1]) + 1 if len(gaps) else BLOCK_BYTES
        yield raw[:end]
        raw = raw[end:]
    yield raw


def _word_hashes(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of the part it is from); upper-case A-Z count as lower-case."""
    raw = np.frombuffer(b" " + b" ".join(block) + b" ", np.uint8)
    gap = _SPACE[raw]
    first, last = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    up, down = (_UP, _DOWN) if len(raw) <= len(_UP) else (_powers(_ODD, len(raw)), _powers(pow(_ODD, -1, 1 << 64), len(raw)))
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[raw] * up[: len(raw)])]
    hashes = _mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    return hashes, np.searchsorted(np.cumsum([len(b) + 1 for b in block]), first - 1, "right")


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles; a text without words has the one member 0."""
    parts = [(k, p) for k, t in enumerate(texts) for p in _pieces((t or "").encode())]
    words, owner, at = [], [], 0
    while at < len(parts):
        end, size = at, 0
        while end < len(parts) and (end == at or size + len(parts[end][1]) < BLOCK_BYTES):
            size += len(parts[end][1]) + 1
            end += 1
        h, part = _word_hashes([p for _, p in parts[at:end]])
        words.append(h)
        owner.append(np.array([k for k, _ in parts[at:end]])[part] if len(part) else np.zeros(0, np.int64))
        at = end
    w, ends = np.concatenate(words or [np.zeros(0, np.uint64)]), np.searchsorted(np.concatenate(owner or [np.zeros(0)]), np.arange(len(texts)), "right")
    out, start = [], 0
    factor = _powers(_ODD, shingle)
    for end in ends.tolist():
        own, start = w[start:end], end
        n = max(1, len(own) - shingle + 1)
        total = np.zeros(n, np.uint64)
        for k in range(min(shingle, len(own))):
            total += own[k : k + n] * factor[k]
        out.append(np.unique(_mix(total + np.uint64(min(shingle, len(own))))) if len(own) else np.zeros(1, np.uint64))
    return out


def wide(members: np.ndarray) -> bytes:
    """Majority bits of a set. Bits are counted in place: numbers are kept as planes of equal binary digits and added in pairs."""
    total = np.zeros(WORDS * 64, np.int64)
    for k in range(0, len(members), 4096):
        h = (members[k : k + 4096, None] ^ _SALT) * np.uint64(0x7FB5D329728EA185)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x81DADEF4BC2DD44D)
        planes = [h ^ (h >> np.uint64(29))]
        while (m := len(planes[0])) > 1:
            if m % 2:
                planes = [np.concatenate([p, np.zeros((1, WORDS), np.uint64)]) for p in planes]
            carry, added = None, []
            for p in planes:
                a, b = p[0::2], p[1::2]
                x, both = a ^ b, a & b
                added.append(x if carry is None else x ^ carry)
                carry = both if carry is None else both | (x & carry)
            planes = [*added, carry]
        for digit, p in enumerate(planes):
            total += np.unpackbits(p.view(np.uint8), bitorder="little").astype(np.int64) << digit
    return np.packbits(total * 2 > len(members), bitorder="little").tobytes()


def bound(bits: int, like: float, spread: float) -> int:
    """Differing bits of two sets of the likeness `like`: the expected number and `spread` standard deviations."""
    share = acos(2 * like / (1 + like)) / pi
    return ceil(bits * share + spread * sqrt(bits * share * (1 - share)))


def _binary(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint64).reshape(batch.num_rows, -1)


def _marked(rows: DataFrame, shingle: int) -> DataFrame:
    """(digest, none, id, text) to (digest, none, id, content, size, fp, few): `few` holds the members of a small set."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                sets = shingle_sets(part.column(3).to_pylist(), shingle)
                made = [
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([wide(s) for s in sets], pa.binary()),
                    pa.array([s.tobytes() if len(s) <= SMALL else b"" for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *made], names=["digest", "none", "id", "content", "size", "fp", "few"])

    return rows.mapInArrow(run, f"digest binary, none boolean, id {rows.schema['id'].dataType.simpleString()}, content binary, size long, fp binary, few binary")


def _entries(distinct: DataFrame) -> DataFrame:
    """(bucket, set, s, t): a row for each block of each fingerprint, with two other words of it, from the half the block is not in."""

    def run(batches):
        at = (np.arange(BLOCKS) * 3 // 8 + WORDS // 2) % WORDS
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                fp = _binary(part, "fp")
                blocks = fp.view(np.uint8).reshape(part.num_rows, BLOCKS, 3).astype(np.int64)
                buckets = (np.arange(BLOCKS) << 24) + blocks @ np.array([65_536, 256, 1])
                sketch = [fp[:, (at + k) % WORDS].view(np.int64).ravel() for k in (0, 1)]
                made = [buckets.ravel(), np.repeat(part.column(0).to_numpy(), BLOCKS), *sketch]
                yield pa.RecordBatch.from_arrays([pa.array(m) for m in made], names=["bucket", "set", "s", "t"])

    return distinct.select("set", "fp").mapInArrow(run, "bucket long, set long, s long, t long")


def _close(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, set, s, t), in order, to (which rows are close to another of their bucket, the least set that each is close to or is)."""
    bucket, own, s, t = rows
    near, least, at = np.zeros(len(own), bool), own.copy(), np.arange(len(own) - 1)
    for gap in range(1, len(own)):
        at = at[at + gap < len(own)]
        at = at[bucket[at] == bucket[at + gap]]
        if not len(at):
            break
        differ = np.bitwise_count((s[at] ^ s[at + gap]).view(np.uint64)) + np.bitwise_count((t[at] ^ t[at + gap]).view(np.uint64))
        a = at[differ <= SKETCH]
        near[a] = near[a + gap] = True
        least[a + gap] = np.minimum(least[a + gap], own[a])
    return near, least


def _met(entries: DataFrame, crowd: int) -> DataFrame:
    """(bucket, set, least): the sets that are close to another one of their bucket, and the least one that each is close to.

    A bucket of over `crowd` sets, in which chance has little part, is passed on whole with its least set.
    """

    def run(batches):
        """Rows come sorted; all of a bucket that may go on are held until there are over `crowd` of them."""
        held, large = None, None

        def out(rows, last):
            """Rows that go on; what is held of the last bucket."""
            nonlocal large
            bucket, own = rows[:2]
            start = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1]
            count = np.diff(start, append=len(bucket))
            many = count > crowd
            begun = large is not None and bucket[0] == large[0]
            many[0] |= begun
            least = own[start]
            least[0] = large[1] if begun else least[0]
            large = (bucket[-1], least[-1]) if many[-1] else None
            keep = len(bucket) if last or many[-1] else start[-1]
            crowded, least = np.repeat(many, count), np.repeat(least, count)
            few = np.flatnonzero(~crowded[:keep])
            passed = crowded.copy()
            passed[few], least[few] = _close([r[few] for r in rows])
            passed[keep:] = False
            made = pa.RecordBatch.from_arrays([pa.array(x[passed]) for x in (bucket, own, least)], names=["bucket", "set", "least"])
            return made, [r[keep:] for r in rows] if keep < len(bucket) else None

        for batch in batches:
            if batch.num_rows:
                rows = [c.to_numpy() for c in batch.columns]
                made, held = out([np.concatenate(r) for r in zip(held, rows, strict=True)] if held else rows, False)
                yield made
        if held:
            yield out(held, True)[0]

    sorted_ = entries.repartition("bucket").sortWithinPartitions("bucket", "set")
    return cut(sorted_.mapInArrow(run, "bucket long, set long, least long"), "wide-buckets")


def _alike(m: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, p: list[bytes], q: list[bytes], like: float) -> np.ndarray:
    """Which pairs of sets (sizes, fingerprints, members of small ones) are alike: by Hamming distance, small ones by members."""
    alike = (np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= bound(WORDS * 64, like, 1.0)) & (np.minimum(m, n) >= np.maximum(m, n) * like)
    for k in np.flatnonzero(np.maximum(m, n) <= SMALL).tolist():
        shared = len(np.intersect1d(np.frombuffer(p[k], np.uint64), np.frombuffer(q[k], np.uint64), assume_unique=True))
        alike[k] = shared >= like * (m[k] + n[k] - shared)
    return alike


def _verified(pairs: DataFrame, distinct: DataFrame, like: float) -> DataFrame:
    """The pairs (a, b) that are alike."""
    part = distinct.select("set", "size", "fp", "few")
    left = part.select(F.col("set").alias("a"), F.col("size").alias("m"), F.col("fp").alias("x"), F.col("few").alias("p"))
    right = part.select(F.col("set").alias("b"), F.col("size").alias("n"), F.col("fp").alias("y"), F.col("few").alias("q"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b, m, n = (batch.column(c).to_numpy() for c in ("a", "b", "m", "n"))
                alike = _alike(m, n, _binary(batch, "x"), _binary(batch, "y"), batch.column("p").to_pylist(), batch.column("q").to_pylist(), like)
                yield pa.RecordBatch.from_arrays([pa.array(a[alike]), pa.array(b[alike])], names=["a", "b"])

    return cut(both.select("a", "b", "m", "n", "x", "y", "p", "q").mapInArrow(run, "a long, b long"), "wide-links")


def _grouped(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """(set, root) of all sets."""
    found = components(links, "a", "b").select(F.col("node").alias("set"), "root")
    return distinct.select("set").join(found.hint("merge"), "set", "left").select("set", F.coalesce("root", "set").alias("root"))


def _compare(left: DataFrame, like: float) -> DataFrame:
    """(bucket, i, j, tile, root, set, size, fp, few), a bucket's tile after the other, to links (a, b) between its groups.

    Members outside the largest group are held against all others, first on `ROUGH` words; one link of a member to each
    group it is like is enough.
    """
    most = bound(ROUGH * 64, like, 3.5)

    def close(held):
        tile, root, own, size, fp = (np.concatenate([h[k] for h in held]) for k in range(5))
        few = [f for h in held for f in h[5].to_pylist()]
        groups, inverse, count = np.unique(root, return_inverse=True, return_counts=True)
        one_tile, rough, found = len(np.unique(tile)) == 1, fp[:, :ROUGH], []
        for x in np.flatnonzero(inverse != count.argmax()) if len(groups) > 1 else ():
            y = np.flatnonzero((root != root[x]) & (one_tile | (tile != tile[x])) & (np.minimum(size, size[x]) >= np.maximum(size, size[x]) * like))
            y = y[(np.bitwise_count(rough[y] ^ rough[x]).sum(1, dtype=np.int64) <= most) | (np.maximum(size[y], size[x]) <= SMALL)]
            if len(y):
                y = y[_alike(size[y], np.full(len(y), size[x]), fp[y], fp[x : x + 1], [few[k] for k in y], [few[x]] * len(y), like)]
                y = y[np.unique(root[y], return_index=True)[1]]
                found += [(min(own[x], o), max(own[x], o)) for o in own[y]]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")], 1)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)].tolist()
            columns = [batch.column(c).to_numpy() for c in ("tile", "root", "set", "size")] + [_binary(batch, "fp"), batch.column("few")]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(keys[s]) != last:
                    yield close(held)
                    held = []
                last = tuple(keys[s])
                held.append([c[s:e] for c in columns])
        if held:
            yield close(held)

    return left.select("bucket", "i", "j", "tile", "root", "set", "size", "fp", "few").mapInArrow(run, "a long, b long")


def similar_links(distinct: DataFrame, like: float = LIKE, *, tile: int = TILE, crowd: int = CROWD) -> DataFrame:
    """(a, b): links that join the sets of `distinct` (set, size, fp, few) that share a block and are alike, in chains."""
    met = _met(_entries(distinct), crowd)
    shared = met.where("set <> least").groupBy("set", "least").agg(F.count(F.lit(1)).alias("n"))
    chosen = shared.groupBy("set").agg(F.max(F.struct("n", (-F.col("least")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), F.col("set").alias("b"))
    first = _verified(chosen, distinct, like)
    roots = cut(_grouped(distinct, first), "wide-roots")
    left = met.select("bucket", "set").join(roots.hint("merge"), "set")
    mixed = left.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("_n")).where("lo <> hi")
    left = left.join(mixed.select("bucket", F.ceil(F.col("_n") / tile).cast("int").alias("_t")).hint("merge"), "bucket")
    left = left.withColumn("tile", F.pmod(F.xxhash64("set"), F.col("_t")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)))
    left = left.select("bucket", F.least("tile", "_o").alias("i"), F.greatest("tile", "_o").alias("j"), "tile", "root", "set")
    dealt = left.join(distinct.select("set", "size", "fp", "few").hint("merge"), "set").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return first.union(_compare(dealt, like).distinct())


def keep_one(docs: DataFrame, *, row_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, like: float = LIKE) -> DataFrame:
    """The rows of `docs` with one row of each group of near copies: the one with the smallest id, null ids last."""
    mark, again = fresh(docs, "digest"), fresh(docs, "again")
    ident = F.unhex(F.md5(F.concat(F.coalesce(F.col(row_id).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary")))
    rows = docs.select(ident.alias("digest"), F.col(row_id).isNull().alias("none"), F.col(row_id).alias("id"), F.col(text).alias("text"))
    once = _marked(rows, shingle).groupBy("content").agg(F.min(F.struct("none", "id", "digest")).alias("least"), *[F.first(c).alias(c) for c in ("size", "fp", "few")])
    distinct = cut(once.drop("content").withColumn("set", F.monotonically_increasing_id()), "wide-distinct")
    roots = _grouped(distinct, similar_links(distinct, like))
    kept = distinct.select("set", "least").join(roots.hint("merge"), "set").groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.digest").alias(mark))
    out = docs.withColumn(mark, ident).join(kept.hint("merge"), mark, "left_semi")
    return out.withColumn(again, F.row_number().over(Window.partitionBy(mark).orderBy(mark))).where(F.col(again) == 1).drop(again, mark)
