import random

import numpy as np
import pytest

from millrace.llm import simhash as S
from millrace.llm.components import components
from tests.llm.plain import groups
from tests.llm.plain import simhash as plain


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two", "a b c", "a b c d e a b c", "É x y z", "x " * 500])
def test_fingerprint(text):
    assert S.fingerprint(text) == plain(text)


def test_query_equals_the_plain_version(spark, small):
    _, rows = small
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op8_simhash(spark, "/root/testdata/sf0.001").collect()}
    fps = [plain(r["text"]) for r in rows]
    assert [got[r["doc_id"]] for r in rows] == [(f"{f:016x}", rows[g]["doc_id"]) for f, g in zip(fps, groups(fps), strict=True)]


@pytest.mark.parametrize("bucket", [1, 8192])
def test_links_connect_what_is_close(spark, bucket):
    rng = random.Random(3)
    fps = [0, (1 << 64) - 1]
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(6):
            fps.append(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
                x ^= 1 << b
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket=bucket)
    found = {r.node: r.root for r in components(links, "a", "b").collect()}
    mine = [found.get(x, x) for x in signed]
    assert len({(g, m) for g, m in zip(groups(fps), mine, strict=True)}) == len(set(groups(fps))) == len(set(mine))


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "x long, y long")
    got = {r.node: r.root for r in components(chain, "x", "y").collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}
    assert components(chain.limit(0), "x", "y").count() == 0


def test_odd_rows(spark, odd):
    got = S.near_duplicates(odd, carry=("source", "fp")).collect()
    assert len(got) == odd.count()
    zero = [r for r in got if r.fp == 0]
    assert {r.component_id for r in zero} == {2} and len(zero) == 4  # null, empty, white space, null without id
    assert {r.component_id for r in got if r.doc_id in (1, 7)} == {1}
    kept = S.keep_one(odd).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "2", "5", "6", "8", "None"])
    assert S.keep_one(odd).columns == odd.columns
    assert S.near_duplicates(odd.limit(0)).count() == 0


def test_kept_rows_keep_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", "x", 5), (2, "a b c d", "y", 6)], "doc_id long, text string, _row_digest string, _n int")
    assert [tuple(r) for r in S.keep_one(df).collect()] == [(1, "a b c d", "x", 5)]
