import pytest

from millrace.llm import decontamination as D
from tests.llm.plain import contained as plain
from tests.llm.plain import words

DOCS = ["a b c d e f", "x A b C d", "b c d e", None, "", "...", "c c c c", "É é é x", "a b a b a b", "1 2 3", "a b c d e f g h a b c"]
ITEMS = [(1, "a b c d"), (2, "B, c. d; e!"), (3, "c c"), (4, "É é"), (5, "2"), (6, None), (7, ""), (None, "a b"), (8, "a b c d"), (9, "a b a")]


@pytest.mark.parametrize("window", [1, 2, 3, 10])
@pytest.mark.parametrize("block_words", [1, 1_000_000])
def test_equals_the_plain_version(spark, window, block_words):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.find_windows(docs, items, window=window, block_words=block_words).orderBy("doc_id").collect()
    assert [(r.n_words, sum(b - a for a, b in r["spans"]), r["items"]) for r in got] == plain(DOCS, ITEMS, window)


def test_odd_rows_and_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "beta gamma delta"), (2, None)], "item_id long, text string")
    got = D.find_windows(odd, items, carry=("source", "spans")).collect()
    assert sum(len(r["items"]) for r in got) == 3 and len(got) == odd.count()
    assert D.find_windows(odd.limit(0), items).count() == 0
    assert all(not r["items"] for r in D.find_windows(odd, items.limit(0)).collect())


def test_words_agree_with_the_contract():
    for t in ("Ab1é_x-Y z", "ÀB c\u0000d", "a{b}[c]~d`e", "日本 語"):
        assert [w.decode() for w in D.words(t)] == words(t)
