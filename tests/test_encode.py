import datetime

import pyarrow as pa
import pytest

from millrace.functions import encode


def values(df, **options):
    return [(r.key, r.value) for r in encode.encode(df, "json", **options).collect()]


def test_rows_become_objects_in_order_with_nulls(spark):
    df = spark.createDataFrame([("alice", 10, None), ("bób/<", 20, True)], "name string, score long, ok boolean")
    assert values(df) == [(None, '{"name":"alice","score":10,"ok":null}'), (None, '{"name":"bób/<","score":20,"ok":true}')]


def test_times_and_numbers(spark):
    t = datetime.datetime(2023, 11, 14, 22, 13, 20)
    df = spark.createDataFrame([(t, float("nan"), [1.5, float("inf")]), (t.replace(microsecond=123000), 2.0, None)], "t timestamp_ntz, x double, l array<double>")
    assert [v for _, v in values(df)] == ['{"t":"2023-11-14T22:13:20","x":null,"l":[1.5,null]}', '{"t":"2023-11-14T22:13:20.123000","x":2.0,"l":null}']


def test_keys(spark):
    df = spark.createDataFrame([("u1", 100, True), (None, 200, None)], "user_id string, value long, flag boolean")
    assert [k for k, _ in values(df, key_column="user_id")] == ["u1", "None"]
    assert [k for k, _ in values(df, key_column="value")] == ["100", "200"]
    assert [k for k, _ in values(df, key_column="flag")] == ["True", "None"]
    assert [k for k, _ in values(df, key_column="absent")] == [None, None]


def test_arrow_batch_is_one_message(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "id string, n long").repartition(3)
    got = encode.encode(df, "arrow-batch", "id").collect()
    assert len(got) == 1 and got[0].key is None
    table = pa.ipc.open_stream(bytes(got[0].value)).read_all()
    assert sorted(table.to_pylist(), key=lambda r: r["id"]) == [{"id": "x", "n": 1}, {"id": "y", "n": 2}, {"id": "z", "n": 3}]


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="format"):
        encode.encode(spark.range(1), "csv")
