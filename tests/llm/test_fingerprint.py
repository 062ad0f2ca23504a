import hashlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import fingerprint as P


def bins(raw):
    f = [0, *np.cumsum(P._STEP).tolist()]
    return [sum(f[c] for c in Counter(raw[i : i + P.WINDOW]).values()) * (P.BINS - 1) // P._TOP for i in range(len(raw) - P.WINDOW + 1)]


RNG = np.random.default_rng(1)
TEXTS = [b"", b"a", b"short", bytes(RNG.integers(97, 110, 63).tolist()), bytes(RNG.integers(97, 110, 64).tolist()), bytes(RNG.integers(97, 110, 200).tolist()), b"ab" * 400, bytes(RNG.integers(97, 110, 3000).tolist())]


def test_entropy_bins():
    for t in TEXTS:
        if len(t) >= P.WINDOW:
            assert P.entropy_bins(np.frombuffer(t, np.uint8)).tolist() == bins(t)
    assert P.histogram(TEXTS).tolist() == [Counter(b for t in TEXTS for b in bins(t))[k] for k in range(P.BINS)]


def test_features_equal_the_plain_version_and_ignore_the_block():
    rank = np.random.default_rng(2).permutation(P.BINS)
    whole = P.features(TEXTS, rank)
    for t, got in zip(TEXTS, whole, strict=True):
        assert got.tolist() == P.features([t], rank)[0].tolist()
        r = [rank[b] for b in bins(t)]
        if len(r) >= P.RUN:
            points = Counter(min(range(i, i + P.RUN), key=lambda j: (r[j], j)) for i in range(len(r) - P.RUN + 1))
            least = min(P.POINTS if len(r) >= P.FEW else 1, max(points.values()))
            chosen = sorted(k for k, v in points.items() if v >= least)
        else:
            chosen = list(range(len(r)))
        raw = np.frombuffer(t, np.uint8)
        hashes = list(dict.fromkeys(P._hash(np.array([raw[k : k + P.WINDOW] for k in chosen])).tolist())) if chosen else []
        assert got[: len(hashes)].tolist() == hashes
        if not 0 < len(t) < P.SHORT_TEXT:
            assert len(got) == len(hashes)


def test_long_texts_are_taken_in_pieces(monkeypatch):
    rank = np.random.default_rng(3).permutation(P.BINS)
    text = bytes(np.random.default_rng(4).integers(97, 110, 9000).tolist()) + b"xyz" * 500
    whole, counts = P.features([text], rank)[0].tolist(), P.histogram([text]).tolist()
    monkeypatch.setattr(P, "BLOCK_BYTES", 700)
    assert P.features([text], rank)[0].tolist() == whole and P.histogram([text]).tolist() == counts


def test_likeness():
    rank = np.arange(P.BINS)
    chain = [P.digest(h) for h in P.features([*TEXTS, TEXTS[-1][:2000] + TEXTS[5] * 5], rank)]
    for a in chain:
        assert P.likeness(a, a) == 1.0
        for b in chain:
            assert 0 <= P.likeness(a, b) <= 1 and P.likeness(a, b) == P.likeness(b, a)
    assert P.likeness(chain[0], chain[1]) == 0.0
    assert P.likeness(chain[-1], chain[-2]) > 0.4 > P.likeness(chain[-1], chain[6])


def check(rows, texts):
    """rows: (doc_id, text) of all documents, in the order in which next ones follow."""
    following = texts[1:] + texts[:1]
    for r, t, f in zip(rows, texts, following, strict=True):
        k = len(t) // 3
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - k] + f[:k]).encode()).hexdigest()


def test_query(spark, small):
    _, rows = small
    got = sorted(P.op2_fingerprint(spark, "/root/testdata/sf0.001").collect(), key=lambda r: -r.doc_id)
    texts = [r["text"] or "" for r in reversed(rows)]
    check(got, texts)
    by = {}
    for r, t in zip(got, texts, strict=True):
        by.setdefault(t, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values())
    for r, n in zip(got, got[1:] + got[:1], strict=True):
        if r.fingerprint == n.fingerprint:
            assert r.near_next == 1.0
    long = [r for r in got if r.n_chars >= 400]
    assert np.mean([r.near_edited for r in long]) > 0.5 > 0.1 > np.mean([r.near_next for r in long])


@pytest.mark.parametrize("n", [1, 2, 5])
def test_neighbours_over_partitions(spark, n):
    rows = [(i * 7, f"text {i} " + "abcdefghij"[i % 10] * i) for i in range(n)]
    got = sorted(P.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string"), np.arange(P.BINS)).collect(), key=lambda r: -r.doc_id)
    check(got, [t for _, t in reversed(rows)])


def test_odd_rows(spark, odd):
    rank = P.rank_table(odd)
    got = P.compare_with_next(odd, rank).collect()
    assert len(got) == odd.count()
    assert {r.fingerprint for r in got if r.doc_id in (2, 3)} == {""}
    assert len({r.fingerprint for r in got if r.doc_id in (1, 7)}) == 1
    assert P.fingerprints(odd, rank).count() == odd.count()
    assert P.compare_with_next(odd.limit(0), P.rank_table(odd.limit(0))).count() == 0


def test_ids_of_any_type(spark):
    rows = [(None, "no id at all"), *[(f"doc-{i:03}", f"text {i} " * (i + 1)) for i in range(40)]]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = P.compare_with_next(df, np.arange(P.BINS)).collect()
    got = sorted((r for r in got if r.doc_id), key=lambda r: r.doc_id, reverse=True) + [r for r in got if not r.doc_id]
    check(got, [t for _, t in reversed(rows)])
    assert P.fingerprints(df, np.arange(P.BINS)).count() == 41
