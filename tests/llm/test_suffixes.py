import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import suffixdedup as D
from millrace.llm import suffixes as S


def check(text, folder, cap, **limits):
    got = list(S.suffixes(np.frombuffer(text, np.uint8), str(folder), cap=cap, **limits))
    at = np.concatenate([a for a, _ in got]).tolist() if got else []
    lcp = np.concatenate([v for _, v in got]).tolist() if got else []
    assert at == sorted(range(len(text)), key=lambda i: text[i:], reverse=True)
    for k in range(1, len(at)):
        x, y = text[at[k - 1] :], text[at[k] :]
        n = 0
        while n < min(len(x), len(y), cap) and x[n] == y[n]:
            n += 1
        assert lcp[k] == n


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=80).map(str.encode), st.integers(2, 30))
def test_order_and_common_prefixes(tmp_path_factory, text, cap):
    folder = tmp_path_factory.mktemp("sa")
    check(text, folder, cap)
    check(text, folder, cap, memory=3, base=1)  # every queue spills, names are sorted by recursion


@pytest.mark.parametrize("text", [b"a" * 500, b"ab" * 300, b"abcabcabd" * 60, bytes(range(1, 250)) * 3])
def test_runs_and_periods(tmp_path, text):
    check(text, tmp_path, 200)
    check(text, tmp_path, 200, memory=50, base=4)


def plain(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, length):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(D.remove_repeats(df, length).collect(), key=lambda r: r.doc_id)
    return [(r.n_bytes, sum(b - a for a, b in r.removed), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows]


def test_query_equals_brute_force(spark, small):
    _, rows = small
    got = sorted(D.op3_suffix_dedup(spark, "/root/testdata/sf0.001").collect(), key=lambda r: r.doc_id)
    want = plain([(r["text"] or "").encode() for r in rows], 200)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == want
    assert sum(w[1] for w in want) > 0


@pytest.mark.parametrize("length", [5, 40])
def test_small_strings_equal_brute_force(spark, length):
    rng = np.random.default_rng(length)
    texts = ["".join(rng.choice(list("abé"), n)) for n in (0, 3, 40, 41, 200, 77)]
    texts += [texts[4][50:150], "x" * 90, "ab" * 60, texts[5] + texts[4], texts[4], ""]
    assert run(spark, texts, length) == plain([t.encode() for t in texts], length)


@pytest.mark.parametrize("length", [5, 40, 150])
def test_keys_with_many_texts(spark, monkeypatch, length):
    """With tiny shards all texts of a key are too many: they are keyed again, and then their windows are counted."""
    monkeypatch.setattr(D, "SHARD_BYTES", 300)
    deeper = []
    monkeypatch.setattr(D, "_deal_windows", lambda *a, f=D._deal_windows: deeper.append(1) or f(*a))
    rng = np.random.default_rng(length)
    passage = "".join(rng.choice(list("abcd"), 220))
    texts = ["".join(rng.choice(list("abcdé"), 60)) + passage + "".join(rng.choice(list("abcdé"), 60)) for _ in range(12)]
    texts += [texts[0], passage, "x" * 190, passage[:60] + passage[:60]]
    assert run(spark, texts, length) == plain([t.encode() for t in texts], length)
    assert deeper


def test_a_planned_shard_spills_and_recurses_within_its_memory(tmp_path, monkeypatch):
    """With the limits of the query: queues spill, names recurse, and memory is far below that of a shard's
    suffixes (12 bytes each and more): it grows with the different names only, and three times the shard takes less than twice of it."""
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(3000)]
    peaks = []
    for shards in (1, 3):
        spills, levels = [], []
        monkeypatch.setattr(S.Queue, "spill", lambda q, f=S.Queue.spill: spills.append(1) or f(q))
        monkeypatch.setattr(S, "_star_order", lambda *a, f=S._star_order: levels.append(len(a[0])) or f(*a))
        texts, size = [], 0
        while size < D.SHARD_BYTES * shards:
            texts.append(" ".join(rng.choice(words, 60)).encode())
            size += len(texts[-1])
        texts[5] = texts[70][:250] + texts[5]
        tracemalloc.start()
        got = list(D.shard_repeats(((1, t) for t in texts), str(tmp_path)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        monkeypatch.undo()
        assert len(spills) > 5 and len(levels) > 1 and levels[1] > S.BASE
        want = sorted((k, a, b) for k, a, b in got)
        assert (5, 0, len(texts[70][:250]) - 199) in want and any(k == 70 for k, _, _ in want)
    assert peaks[1] < 2 * peaks[0] and peaks[1] < 60e6


def test_long_texts_are_taken_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abcdefgh"), 3000))
    whole = D.spans([text.encode()], 200)
    monkeypatch.setattr(D, "BLOCK_BYTES", 512)
    covered = Counter()
    for block in D._pieces([text.encode(), text[:100].encode()], 200):
        at, start, n, _, _ = D.spans([p[2] for p in block], 200)
        for k, a, m in zip(at, start, n, strict=True):
            covered.update(range(a + block[k][1], a + block[k][1] + abs(m)))
    assert covered == Counter(range(3000 - 199)) and abs(whole[2]).sum() == 3000 - 199


def test_shards_find_repeats_within_and_across(tmp_path):
    texts = [(1, b"abcdeabcde"), (1, b"xabcdex"), (1, b"zzz"), (2, b"qqqqqqq"), (1, b"ok"), (1, b"yqqqqqqy")]
    got = list(D.shard_repeats(texts, str(tmp_path), 5))
    assert got == [(0, 0, 1), (0, 5, 6), (1, 1, 2), (5, 1, 3)]
    assert list(D.shard_repeats([], str(tmp_path), 5)) == []


def test_odd_rows(spark, odd):
    rows = D.remove_repeats(odd, 50, carry=("source", "key", "n")).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [bytes(r.kept) for r in by[1]] == [bytes(r.kept) for r in by[7]] * 2 == [b"", b""]
    assert by[2][0].n_bytes == 0 and by[2][0].removed == [] and by[8][0].kept == b"one"
    assert by[6][0].n_bytes - sum(b - a for a, b in by[6][0].removed) < 50
    assert all(r.carried_key == 7 for r in rows)
    assert D.remove_repeats(odd.limit(0)).count() == 0
