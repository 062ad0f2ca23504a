import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.functions.buckets import live_buckets
from millrace import stages
from millrace.operators import dedup, microbatch


def at(seconds):
    return datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=seconds)


def plain(rows, window, bucket):
    """Row by row: (seconds, key) in order to the indexes that pass."""
    last, out = {}, []
    for i, (t, k) in enumerate(rows):
        b = t // (3600 * bucket)
        if k is None or k not in last or b - last[k] >= live_buckets(window, bucket):
            out.append(i)
            if k is not None:
                last[k] = b
    return out


def run(spark, rows, window, bucket):
    df = spark.createDataFrame([(i, at(t), k) for i, (t, k) in enumerate(rows)], "i long, t timestamp_ntz, k string")
    return sorted(r.i for r in dedup.windowed_first_wins(df, "k", "t", ["t", "i"], window, bucket).collect())


@pytest.mark.parametrize("window, bucket, first, repeat, kept", [(1, 1, 3599, 3600, True), (1, 1, 0, 3599, False), (3, 1, 3599, 10799, False), (3, 1, 3599, 10800, True), (3, 2, 0, 14399, False), (3, 2, 0, 14400, True)])
def test_window_edges(spark, window, bucket, first, repeat, kept):
    assert run(spark, [(first, "a"), (repeat, "a")], window, bucket) == ([0, 1] if kept else [0])


def test_a_duplicate_does_not_extend_the_window(spark):
    assert run(spark, [(0, "a"), (7200, "a"), (10800, "a")], 3, 1) == [0, 2]


def test_null_keys_pass(spark):
    assert run(spark, [(0, None), (0, None), (1, "a"), (2, "a")], 3, 1) == [0, 1, 2]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60_000), st.sampled_from(["a", "b", None])), max_size=30).map(lambda x: sorted(x, key=lambda r: r[0])), st.integers(1, 5), st.integers(1, 3))
def test_windowed_equals_row_by_row(spark, rows, window, bucket):
    assert run(spark, rows, window, bucket) == plain(rows, window, bucket)


def test_first_wins_by_text_and_order(spark):
    df = spark.createDataFrame([("1", 2, {"a": 1}), ("1", 1, {"a": 2}), (None, 3, None), (None, 4, None), ("x", None, None), ("x", 9, None)], "k string, n long, m map<string,int>")
    assert sorted((r.k or "", r.n) for r in dedup.first_wins(df, "k", ["n"]).collect()) == [("", 3), ("", 4), ("1", 1), ("x", 9)]
    with pytest.warns(UserWarning, match="pass as they are"):
        assert dedup.first_wins(df, "absent", ["n"]).count() == 6
    assert dedup.first_wins(df.limit(0), "k", ["n"]).count() == 0


def test_numbers_and_texts_are_one_key(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    seen = spark.createDataFrame([("1",), (None,)], "s string")
    assert sorted((r.k or 0) for r in dedup.not_seen(df, "k", seen, "s").collect()) == [0, 2]


def test_marks(spark):
    old = spark.createDataFrame([("a", at(0)), ("a", at(10)), (None, at(0)), ("b", at(7200))], "k string, t timestamp_ntz")
    marks = dedup.mark_seen(old, "k", "t", 1)
    assert sorted(map(tuple, marks.collect())) == [("a", 0), ("b", 2)]
    assert dedup.contains(marks, "a") and not dedup.contains(marks, "c")
    from pyspark.sql import functions as F

    assert sorted(map(tuple, dedup.live_marks(marks, F.lit("1970-01-01 03:00:00").cast("timestamp_ntz"), 3, 1).collect())) == [("b", 2)]
    new = spark.createDataFrame([("a", at(10800)), ("b", at(10800)), ("c", at(10800)), (None, at(10800)), ("b", at(0))], "k string, t timestamp_ntz")
    assert sorted(str(r.k) for r in dedup.not_live(new, "k", marks, "t", 3, 1).collect()) == ["None", "a", "c"]


def test_buckets_are_exact(spark):
    from pyspark.sql import functions as F

    from millrace.functions.buckets import bucket

    edges = [(-1, -1), (0, 0), (3_599_999_999, 0), (3_600_000_000, 1), (36_000_000_000_000_000 - 1, 9_999_999), (36_000_000_000_000_000, 10_000_000), (-3_600_000_000, -1), (-3_600_000_001, -2)]
    df = spark.createDataFrame([(m,) for m, _ in edges], "m long").select(bucket(F.timestamp_micros("m"), 1).alias("b"))
    assert [r.b for r in df.collect()] == [b for _, b in edges]


def test_times_without_a_zone_are_utc_in_any_session(spark):
    from pyspark.sql import functions as F

    from millrace.functions import decode
    from millrace.functions.buckets import bucket

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([('{"t":1710055800000}',)], "value string")  # 2024-03-10 07:30 UTC, half past three in New York
        got = decode.strict(df, {"t": "timestamp[ms]"}).select(F.col("t").cast("string").alias("t"), bucket(F.col("t"), 1).alias("b"), bucket(F.col("t"), 2).alias("c"))
        assert tuple(got.first()) == ("2024-03-10 07:30:00", 475015, 237507)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_bad_windows():
    for w, b in ((0, 1), (1, 0), (-1, 1)):
        with pytest.raises(ValueError, match="positive"):
            live_buckets(w, b)
    assert [live_buckets(*x) for x in ((3, 1), (1, 1), (3, 2), (5, 2), (1, 5))] == [3, 1, 2, 3, 1]


def test_microbatches(spark):
    df = spark.range(25).withColumnRenamed("id", "n")
    got = microbatch.assign(df, [df["n"].desc()], 10)
    assert [(r._seq, r._batch) for r in got.orderBy("n").collect()] == [(25 - n, (24 - n) // 10) for n in range(25)]
    with pytest.raises(ValueError, match="positive"):
        microbatch.assign(df, [df["n"]], 0)


def test_null_keys_stay_out_of_exchanges(spark):
    """What is exchanged for an anti or a live lookup has a filter on the key below it; null keys pass all the same."""
    df = spark.createDataFrame([(1, at(0), "a"), (2, at(0), None), (3, at(0), "b"), (4, at(0), None)], "i long, t timestamp_ntz, k string")
    seen = spark.createDataFrame([("a",), (None,)], "s string")
    marks = spark.createDataFrame([("a", 0)], "key string, bucket long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for out in (dedup.not_seen(df, "k", seen, "s"), dedup.not_live(df, "k", marks, "t", 3, 1)):
            assert sorted(r.i for r in out.collect()) == [2, 3, 4] and out.columns == df.columns
            plan = out._jdf.queryExecution().sparkPlan().toString()
            assert "isnotnull" in plan.lower() and "isnull" in plan.lower() and "Union" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stages.shared_dir(Session())


def test_one_key_is_added_once(spark):
    marks = spark.createDataFrame([("a", 1)], "key string, bucket long")
    more = dedup.add(dedup.add(marks, "b", 2), "b", 2)
    assert dedup.contains(more, "b") and not dedup.contains(marks, "b") and more.count() == 2
