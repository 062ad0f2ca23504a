import pytest

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet consetetur sadipscing elitr " * 30_000  # about 1.6 MB
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \n\t ", "en", "b"),
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu.", "en", "a"),
    (None, "a row without an id", "en", "b"),
    (None, None, None, None),
    (5, "éàü " * 10, "fr", None),
    (6, LONG, "la", "a"),
    (7, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu.", "en", "c"),
    (8, "one", "en", "c"),
]
CLASHING = ["score", "x", "key", "_text", "size", "shard", "slot", "rank", "items", "spans", "fp", "line", "pos", "doc", "n", "start", "a", "b", "url_", "carried_doc_id", "removed", "kept", "component_id", "_pid", "_key", "target", "copies", "bin"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(7) for c in CLASHING})


@pytest.fixture(scope="session")
def small(spark):
    """(DataFrame, rows as dicts ordered by id) of the smallest documents table."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, [r.asDict() for r in df.orderBy("doc_id").collect()]
