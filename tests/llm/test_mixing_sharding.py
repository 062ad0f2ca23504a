import zlib
from collections import Counter, defaultdict

import pytest

from millrace.llm import mixing, sharding
from tests.llm.plain import water


@pytest.mark.parametrize("sizes", [[10, 20, 30], [1000, 1, 1, 1], [1, 1, 1000, 7, 0], [0, 0], [5], [3, 3, 3, 3, 3, 3, 3]])
def test_targets(spark, sizes):
    names = [None if i == len(sizes) - 1 and i else f"s{i}" for i in range(len(sizes))]
    df = spark.createDataFrame([(n, s) for n, s in zip(names, sizes, strict=True)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = water(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))], "1.5", 2)
    assert [got[n] for n in names] == pytest.approx(want)


def test_mix_meets_its_targets(spark, small):
    df, _ = small
    rows = mixing.mix(df).collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size) and r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    assert sum(target.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    again = mixing.mix(df.repartition(7)).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in rows}


def test_mix_odd_rows(spark, odd):
    rows = mixing.mix(odd, carry=("n_chars", "score")).collect()
    assert len(rows) == odd.count() and {r.source for r in rows} == {"a", "b", "c", None}
    assert {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert all(r.carried_score == 7 for r in rows)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_running_sums_cross_batches(spark):
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"source": pa.array(s, pa.string()), "size": pa.array(z, pa.int64())}) for s, z in ((["a", "a", None], [1, 2, 3]), ([None, "b"], [4, 5]), ([], []), (["b", "c"], [6, 7]))]
    assert [x for b in mixing._running(iter(batches)) for x in b.column(2).to_pylist()] == [0, 1, 0, 3, 0, 5, 0]


def plain_shards(rows, shards):
    import hashlib

    def key(i):
        return hashlib.md5(f"{sharding.SEED}:{'null' if i is None else i}".encode()).hexdigest()

    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    line = []
    for s, own in by.items():
        own.sort(key=lambda r: (key(r["doc_id"]), r["doc_id"]))
        line += [((2 * k - 1) / (2.0 * len(own)), key(r["doc_id"]), s, r["doc_id"]) for k, r in enumerate(own, 1)]
    line.sort()
    starts = [-(-k * len(line) // shards) for k in range(shards + 1)]
    return {x[3]: (s, g - starts[s]) for g, x in enumerate(line) for s in [g * shards // len(line)]}


def test_shards_equal_the_plain_version(spark, small):
    df, rows = small
    got = sharding.op10_sharding(spark, "/root/testdata/sf0.001").collect()
    want = plain_shards(rows, 8)
    texts = {r["doc_id"]: r["text"] for r in rows}
    for r in got:
        assert (r.shard, r.slot) == want[r.doc_id]
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.law == "rows" and r.grown_shard is None
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 8


def test_every_shard_has_the_mixture(spark, small):
    df, rows = small
    got = sharding.interleave_shards(df, 4).collect()
    n = Counter(r["source"] for r in rows)
    for s in n:
        own = Counter(r.shard for r in got if r.source == s)
        assert all(abs(own[k] - n[s] / 4) <= 1 for k in range(4))


def test_shards_of_odd_rows(spark, odd):
    got = sharding.interleave_shards(odd, 3, carry=("text", "shard")).collect()
    assert len(got) == odd.count()
    for k in range(3):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert {r.size for r in got if r.carried_text is None} == {1}
    assert sharding.interleave_shards(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.interleave_shards(odd, 0)
