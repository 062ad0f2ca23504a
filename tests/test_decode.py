import datetime
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation

from millrace.functions import decode, types

SCHEMA = {"id": "string", "v": "uint32"}


def read(spark, values, schema=None, **options):
    messages = spark.createDataFrame([(v,) for v in values], "value string")
    return decode.strict(messages, schema or SCHEMA, **options)


@pytest.mark.parametrize(
    "message, row",
    [
        ('{"id":"a","v":1}', ("a", 1)),
        ('{"v":1,"id":"a","more":{"x":[1]}}', ("a", 1)),
        ('{"id":"a"}', ("a", None)),
        ('{"id":null,"v":4294967295}', (None, 4294967295)),
        ('{\n "id" : "a" ,\n "v" : 0 }\n', ("a", 0)),
        ('{"ID":"a","V":1}', (None, None)),
        ("{}", (None, None)),
    ],
)
def test_strict_accepts(spark, message, row):
    assert [tuple(r) for r in read(spark, [message]).collect()] == [row]


@pytest.mark.parametrize(
    "message",
    ["not json", "[1]", "5", '"x"', '{"id":1}', '{"id":{"x":1}}', '{"id":true}', '{"v":"1"}', '{"v":1.5}', '{"v":1.0}', '{"v":true}', '{"v":-1}', '{"v":4294967296}', '{"id":"a","id":"b"}', '{"id":"a"'],
)
def test_strict_rejects(spark, message):
    with pytest.raises(PySparkException, match="JSON parse error"):
        read(spark, ['{"id":"a","v":1}', message]).collect()


@pytest.mark.parametrize("kind, low, high", [("int32", -(2**31), 2**31 - 1), ("int", -(2**31), 2**31 - 1), ("int64", -(2**63), 2**63 - 1), ("uint8", 0, 255), ("uint32", 0, 2**32 - 1), ("uint64", 0, 2**64 - 1)])
def test_integer_bounds(spark, kind, low, high):
    for n in (low, high):
        assert int(read(spark, [f'{{"n":{n}}}'], {"n": kind}).first()[0]) == n
    for n in (low - 1, high + 1):
        with pytest.raises(PySparkException, match="JSON parse error"):
            read(spark, [f'{{"n":{n}}}'], {"n": kind}).collect()


def test_timestamp_is_milliseconds(spark):
    df = read(spark, ['{"ts":1700000000000}', '{"ts":1700000000123}'], {"ts": "timestamp[ms]"})
    assert df.dtypes == [("ts", "timestamp_ntz")]
    assert [r.ts for r in df.collect()] == [datetime.datetime(2023, 11, 14, 22, 13, 20), datetime.datetime(2023, 11, 14, 22, 13, 20, 123000)]
    with pytest.raises(PySparkException, match="JSON parse error"):
        read(spark, ['{"ts":"2023-11-14"}'], {"ts": "timestamp[ms]"}).collect()


def test_blank_messages_vanish_and_are_counted(spark):
    seen = Observation("decode")
    messages = spark.createDataFrame([("",), (" \n",), ('{"id":"a"}',)], "value string")
    df = decode.strict(messages, SCHEMA, observe=seen)
    assert df.count() == 1
    assert seen.get == {"messages": 3, "rows": 1}


def test_null_message_fails(spark):
    with pytest.raises(PySparkException, match="without a value"):
        read(spark, [None]).collect()


def test_unknown_type_is_string(spark):
    with pytest.warns(UserWarning, match="float"):
        assert types.resolve("float").result.simpleString() == "string"


def test_empty_schema_is_refused(spark):
    with pytest.raises(ValueError, match="schema"):
        decode.strict(spark.createDataFrame([("{}",)], "value string"), {})


def test_odd_field_names(spark):
    got = read(spark, ['''{"a.b":1,"it's":"x","c d":2}'''], {"a.b": "int64", "it's": "string", "c d": "int64"})
    assert tuple(got.first()) == (1, "x", 2)
    with pytest.raises(ValueError, match="quotes"):
        read(spark, ["{}"], {"""a'b"c""": "string"})


def test_columns_in_order_of_declaration(spark):
    assert read(spark, ['{"a":1,"b":"x"}'], {"b": "string", "a": "int64"}).columns == ["b", "a"]
    assert decode.schema_of({"b": "string", "a": "uint64"}).simpleString() == "struct<b:string,a:decimal(20,0)>"
    assert read(spark, ['{"a":18446744073709551615}'], {"a": "uint64"}).first().a == Decimal(18446744073709551615)


def test_lenient_skips_what_does_not_parse(spark):
    messages = spark.createDataFrame([('{"a":1}',), ("nope",), (None,), ("[1,2]",), ("3",), ("",)], "value string")
    seen = Observation("lenient")
    df = decode.lenient(messages, observe=seen)
    assert [str(r.doc) for r in df.collect()] == ['{"a":1}', "[1,2]", "3"]
    assert seen.get == {"messages": 6, "rejected": 3}


def test_empty_input(spark):
    assert read(spark, []).count() == 0
