import random
import re

import numpy as np
import pytest

import corpus_pipeline as C
from millrace.llm import widehash as W


def plain_set(text, shingle=5):
    own = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(own[i : i + shingle]) for i in range(max(1, len(own) - shingle + 1))}


def likeness(a, b):
    return len(a & b) / len(a | b)


def chained(n, linked):
    """Root of each of n places under all pairs that `linked` takes."""
    root = list(range(n))
    for j in range(n):
        for i in range(j):
            if root[i] != root[j] and linked(i, j):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return root


def plain_kept(texts):
    """Places that stay, by all pairs under the operator's rule: a shared block, and then Hamming distance or members."""
    sets = W.shingle_sets(texts)
    fps = [W.wide(s) for s in sets]
    most = W.bound(W.WORDS * 64, W.LIKE, 1.0)

    def linked(i, j):
        if np.array_equal(sets[i], sets[j]):
            return True
        small, large = sorted((len(sets[i]), len(sets[j])))
        if small < W.LIKE * large or not any(fps[i][k : k + 3] == fps[j][k : k + 3] for k in range(0, len(fps[i]), 3)):
            return False
        if large <= W.SMALL:
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            return len(a & b) >= W.LIKE * len(a | b)
        return (int.from_bytes(fps[i]) ^ int.from_bytes(fps[j])).bit_count() <= most

    return [i for i, r in enumerate(chained(len(texts), linked)) if i == r]


def near_texts(seed=5):
    """Chains of texts that differ by a few words each, around the likeness that decides, and texts that share a passage only."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage, out = [word() for _ in range(30)], [None, "", " \n", "one", "One", "two words"]
    for n in (4, 5, 6, 9, 14, 40, 60, 120, 400):
        for _ in range(3):
            text = [word() for _ in range(n)]
            for _ in range(6):
                out.append(" ".join(text))
                for k in rng.sample(range(n), rng.randint(0, 1 + n // 60)):
                    text[k] = word()
                text = text[: n - rng.choice([0, 0, 1])] + [word() for _ in range(rng.choice([0, 0, 1]))]
                n = len(text)
    out += [" ".join([*passage, *(word() for _ in range(rng.randint(0, 25)))]) for _ in range(40)]
    rng.shuffle(out)
    return out


def test_sets_equal_the_plain_version(monkeypatch):
    texts = [*near_texts()[:80], "É x\ty\x0bz É x y Z", "A b c d e a B c d e a b", "x " * 500, "no" + "space" * 90]
    sets, plain = W.shingle_sets(texts), [plain_set(t) for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])
    monkeypatch.setattr(W, "BLOCK_BYTES", 600)  # longer than any word: pieces and blocks change nothing
    assert all(np.array_equal(a, b) for a, b in zip(W.shingle_sets(texts), sets, strict=True))


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 5000])
def test_bits_are_majorities(n):
    members = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    mask, ones = (1 << 64) - 1, np.zeros(W.WORDS * 64, int)
    for m in members.tolist() if n < 100 else []:
        bits = 0
        for k, salt in enumerate(W._SALT.tolist()):
            h = (m ^ salt) * 0x7FB5D329728EA185 & mask
            h = (h ^ h >> 32) * 0x81DADEF4BC2DD44D & mask
            bits |= (h ^ h >> 29) << 64 * k
        ones += np.array([bits >> k & 1 for k in range(W.WORDS * 64)])
    got = np.unpackbits(np.frombuffer(W.wide(members), np.uint8), bitorder="little")
    assert 0.4 < got.mean() < 0.6 if n > 100 or n == 1 else got.tolist() == (ones * 2 > n).tolist()


def test_hamming_distance_measures_likeness():
    """Texts of a likeness clearly over or under the bound fall on its sides."""
    rng = np.random.default_rng(2)
    most = W.bound(W.WORDS * 64, W.LIKE, 1.0)
    for like, linked in ((0.84, True), (0.75, False)):
        for _ in range(20):
            shared = rng.integers(0, 1 << 63, int(600 * like)).astype(np.uint64)
            rest = rng.integers(0, 1 << 63, 600 - len(shared)).astype(np.uint64)
            a, b = (np.concatenate([shared, r]) for r in np.array_split(rest, 2))
            apart = np.bitwise_count(np.frombuffer(W.wide(a), np.uint8) ^ np.frombuffer(W.wide(b), np.uint8)).sum()
            assert (apart <= most) == linked


def test_stage_equals_the_plain_version_and_finds_near_copies(spark):
    texts = near_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in W.keep_one(df).collect())
    assert got == plain_kept(texts)
    sets = [plain_set(t) for t in texts]
    exact = chained(len(texts), lambda i, j: likeness(sets[i], sets[j]) >= 0.8)
    want = {i for i, r in enumerate(exact) if i == r}
    assert 20 < len(want) < len(texts) - 20
    gone, lost = set(range(len(texts))) - want, set(got) - want
    assert len(lost) <= 0.1 * len(gone) and len(want - set(got)) <= 1


@pytest.mark.parametrize("tile", [2, W.TILE])
def test_buckets_of_several_groups_are_compared_in_tiles(spark, tile):
    """Fingerprints that share a block and form two groups, neither of which holds the bucket's least member's likes only."""
    rng = np.random.default_rng(9)
    block = b"\1\2\3"
    rows = []
    for _ in range(5):
        base = bytearray(block + rng.bytes(W.BLOCKS * 3 - 3))
        for k in range(6):
            fp = bytearray(base)
            fp[100 + k] ^= 255
            rows.append((len(rows), 100, bytes(fp), b""))
    rng.shuffle(order := list(range(len(rows))))
    df = spark.createDataFrame([(order[i], *r[1:]) for i, r in enumerate(rows)], "set long, size long, fp binary, few binary")
    links = [(r.a, r.b) for r in W.similar_links(df, tile=tile).collect()]
    root = chained(len(rows), lambda i, j: (i, j) in set(links) or (j, i) in set(links))
    assert len({(root[order[i]], i // 6) for i in range(len(rows))}) == len(set(root)) == 5


def test_stage_on_the_table(spark, small):
    docs, rows = small
    got = sorted(r.doc_id for r in C.drop_near_copies(spark, docs, "").collect())
    assert got == [rows[i]["doc_id"] for i in plain_kept([r["text"] for r in rows])]


def test_odd_rows(spark, odd):
    kept = C.drop_near_copies(spark, odd, "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "5", "6", "8", "None"])
    assert kept.columns == odd.columns
    assert W.keep_one(odd.limit(0)).count() == 0
    from pyspark.sql import functions as F

    clash = odd.withColumns({c: F.lit(c) for c in ("_digest", "_again", "digest", "id", "none", "set", "root")})
    assert W.keep_one(clash).columns == clash.columns and {r["_digest"] for r in W.keep_one(clash).collect()} == {"_digest"}


def shared_blocks(seed=3):
    """Sets that share their first block with others by chance, and among them pairs of like ones; rows and the like pairs."""
    rng = np.random.default_rng(seed)
    rows, like = [], set()
    for group, n in enumerate((1, 2, 3, 40, 300)):
        for k in range(n):
            fp = bytearray(bytes([group, 1, 2]) + rng.bytes(W.BLOCKS * 3 - 3))
            rows.append((len(rows), 100, bytes(fp), b""))
            if k % 10 == 1:
                fp[40::4] = bytes(b ^ 1 << rng.integers(8) for b in fp[40::4])
                like.add((len(rows) - 1, len(rows)))
                rows.append((len(rows), 100, bytes(fp), b""))
    return rows, like


@pytest.mark.parametrize(("batch", "crowd"), [("10000", 1000), ("7", 1000), ("7", 20), ("10000", 20)])
def test_pairs_by_chance_stay_in_their_tasks(spark, batch, crowd):
    """Only sets that are close to another of their bucket go on, or those of a crowd, each with its least set."""
    rows, like = shared_blocks()
    df = spark.createDataFrame(rows, "set long, size long, fp binary, few binary")
    buckets = {}
    for k, _, fp, _ in rows:
        for b in range(W.BLOCKS):
            buckets.setdefault((b << 24) + int.from_bytes(fp[3 * b : 3 * b + 3]), []).append(k)

    def close(v, x, y):
        at = ((v >> 24) * 3 // 8 + W.WORDS // 2) % W.WORDS
        return sum((int.from_bytes(x[8 * k : 8 * k + 8]) ^ int.from_bytes(y[8 * k : 8 * k + 8])).bit_count() for k in (at, (at + 1) % W.WORDS)) <= W.SKETCH

    want = {(v, k, m[0]) for v, m in buckets.items() if len(m) > crowd for k in m}
    for v, m in ((v, m) for v, m in buckets.items() if len(m) <= crowd):
        met = {k: [o for o in m if o != k and close(v, rows[k][2], rows[o][2])] for k in m}
        want |= {(v, k, min(k, *others)) for k, others in met.items() if others}
    alone = {(v, k) for v, m in buckets.items() if len(m) > 1 for k in m} - {(v, k) for v, k, _ in want}
    assert all({(v, a), (v, b)} <= {(v, k) for v, k, _ in want} for a, b in like for v, m in buckets.items() if a in m and b in m)
    assert crowd < 1000 or len(alone) > 100
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [tuple(r) for r in W._met(W._entries(df), crowd).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(want) > 100 and sorted(got) == sorted(want)


def test_rows_do_not_grow_with_pairs_by_chance(spark, monkeypatch):
    """What leaves the buckets' tasks is the like sets, however many others share a block with them."""
    made = {}
    cut = W.cut
    monkeypatch.setattr(W, "cut", lambda df, label: made.setdefault(label, cut(df, label)))
    rng = np.random.default_rng(4)
    rows = [(k, 100, bytes([k % 50, k % 3, 2]) + rng.bytes(W.BLOCKS * 3 - 3), b"") for k in range(3000)]
    df = spark.createDataFrame(rows, "set long, size long, fp binary, few binary")
    assert W.similar_links(df).count() == 0
    assert made["wide-buckets"].count() < 0.25 * len(rows)  # all 3,000 before, in buckets of 20


@pytest.mark.parametrize(("c", "a", "b"), [(4, 0, 1), (12, 1, 2), (8, 1, 1), (20, 2, 3), (80, 10, 10), (400, 50, 50)])
def test_sketches_of_like_sets_are_close(c, a, b):
    """128 bits of two sets at a likeness of 0.8 never differ in more than SKETCH, in 1,000 draws."""
    rng = np.random.default_rng(c)
    for _ in range(50):
        h = rng.integers(0, 1 << 63, c + a + b).astype(np.uint64)
        x, y = (np.frombuffer(W.wide(s), np.uint64).reshape(-1, 2) for s in (h[: c + a], np.r_[h[:c], h[c + a :]]))
        assert np.bitwise_count(x ^ y).sum(1).max() <= W.SKETCH
