import hashlib
from collections import defaultdict

import pytest

import corpus_pipeline as C
from millrace.llm import decontamination, mixing, sharding, toxicity
from tests.llm import plain
from tests.llm.test_widehash import plain_kept

SF = "/root/testdata/sf0.001"


def md5(seed, i):
    return hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()


def plain_mix(rows):
    """Rows as often as the mixture takes them, by running sums in order of hash."""
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((md5(mixing.SEED, r["doc_id"]), r["doc_id"], len(plain.spaced(r["text"])), r))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(x[2] for x in by[s]) for s in names]
    aims = plain.water(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(names))], "1.5", 2)
    out = []
    for s, size, aim in zip(names, sizes, aims, strict=True):
        epochs, total = int(aim // size) if size else 0, 0
        budget = aim - epochs * size
        for _, _, n, r in sorted(by[s], key=lambda x: x[:3]):
            out += [r] * (epochs + (budget > 0 and total + n / 2 <= budget))
            total += n
    return out


def plain_shards(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((md5(sharding.SEED, r["doc_id"]), r["doc_id"]))
    line = sorted(((2 * k - 1) / (2.0 * len(own)), key, s, i) for s, own in by.items() for k, (key, i) in enumerate(sorted(own), 1))
    starts = [-(-k * len(line) // shards) for k in range(shards + 1)]
    return sorted((i, g * shards // len(line), g - starts[g * shards // len(line)]) for g, (_, _, _, i) in enumerate(line))


def test_stages_equal_plain_versions(spark, tmp_path, small):
    _, rows = small
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), rows
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(toxicity.fold(5) != 0)
    scores = toxicity.fit(docs, labels).scores([r["text"] for r in rows])
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, SF)
        if name == "toxicity":
            kept = [r for r, s in zip(kept, scores, strict=True) if s < 0.5]
        elif name == "near_duplicates":
            kept = [kept[i] for i in plain_kept([r["text"] for r in kept])]
        elif name == "decontamination":
            found = plain.contained([r["text"] for r in kept], items, decontamination.WINDOW)
            kept = [r for r, f in zip(kept, found, strict=True) if not f[2]]
        elif name == "mixing":
            kept = plain_mix(kept)
        else:
            assert sorted((r.doc_id, r.shard, r.slot) for r in out.collect()) == plain_shards(kept, sharding.SHARDS)
            break
        out.write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        assert sorted(map(tuple, docs.collect()), key=str) == sorted((tuple(r.values()) for r in kept), key=str)


def test_run_applies_the_stages(spark):
    out = C.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))
    assert [len(C.STAGES), C.ORACLE_SQL] == [5, None]


@pytest.mark.parametrize("stage", [f for _, f in C.STAGES], ids=[n for n, _ in C.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, odd, stage):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    assert stage(spark, docs, SF).count() > 0
    assert stage(spark, docs.limit(0), SF).count() == 0
