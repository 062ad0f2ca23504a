import pytest

from millrace import build_sink, build_source, config
from millrace.sinks import ClickHouseSink, FileSink, KafkaSink, MemorySink, Sink, TableSink
from millrace.sources import kafka_options

TOML = """
[input]
type = "kafka"
[input.connection]
broker = "one:9092"
[input.topic]
name = "raw"
[input.topic.schema]
uid = "string"
time = "timestamp[ms]"
[input.consumer]
group_id = "g"
[output]
type = "clickhouse"
dlq_split_factor = 4
[output.connection]
host = "db"
port = 8123
[output.table]
name = "t"
[dlq]
type = "kafka"
[dlq.connection]
broker = "two:9092"
[dlq.topic]
name = "dead"
format = "arrow-batch"
[dedup]
field = "uid"
[unknown]
x = 1
"""


@pytest.fixture
def file(tmp_path):
    path = tmp_path / "settings.toml"
    path.write_text(TOML)
    return str(path)


def load(file, environ=None, kind=config.DedupApp, **given):
    return config.load(kind, file=file, environ=environ or {}, dotenv=file + ".env", **given)


def test_file_and_defaults(file):
    app = load(file)
    c = app.input.consumer
    assert (c.batch_size, c.batch_timeout_sec, c.auto_offset_reset) == (1000, 5, "latest")
    assert app.input.topic.schema == {"uid": "string", "time": "timestamp[ms]"} and list(app.input.topic.schema) == ["uid", "time"]
    assert (app.dedup.window_hours, app.dedup.bucket_hours, app.dedup.store_dir) == (3, 1, "./dedup_store")
    assert isinstance(app.output, config.ClickHouseOutput) and app.output.dlq_split_factor == 4
    assert app.output.table.database == "default" and app.output.connection.user == "default"
    assert isinstance(app.dlq, config.KafkaOutput) and app.dlq.topic.format == "arrow-batch" and app.dlq.topic.key_column is None


def test_precedence(file, tmp_path):
    with open(file + ".env", "w") as f:
        f.write("# note\nDEDUP__WINDOW_HOURS=7\nINPUT__CONSUMER__BATCH_SIZE='70'\nOTHER=1\n")
    secrets = tmp_path / "secrets"
    secrets.mkdir()
    (secrets / "output__connection__password").write_text("hush\n")
    (secrets / "dedup__window_hours").write_text("1")
    app = load(file, {"INPUT__CONSUMER__BATCH_SIZE": "50", "INPUT__TOPIC__SCHEMA": '{"a":"int"}'}, secrets=str(secrets), dedup={"field": "a"})
    assert (app.dedup.window_hours, app.input.consumer.batch_size, app.dedup.field) == (7, 50, "a")
    assert app.output.connection.password == "hush"
    assert app.input.topic.schema["a"] == "int"


def test_settings_file_is_looked_up_at_load(file, monkeypatch):
    assert config.load(config.DedupApp, environ={"SETTINGS_FILE": file}, dotenv="none").input.topic.name == "raw"


@pytest.mark.parametrize("path, value, text", [("DEDUP__WINDOW_HOURS", "0", "positive"), ("DEDUP__BUCKET_HOURS", "-1", "positive"), ("OUTPUT__DLQ_SPLIT_FACTOR", "1", "2 or more"), ("OUTPUT__TYPE", "stone", "none of"), ("DLQ__TOPIC__FORMAT", "csv", "none of"), ("DEDUP__WINDOW_HOURS", "x", "whole number"), ("OUTPUT__CONNECTION__SECURE", "maybe", "truth")])
def test_bad_values(file, path, value, text):
    with pytest.raises(ValueError, match=text):
        load(file, {path: value})


def test_missing_values_say_where(file):
    with pytest.raises(ValueError, match=r"settings.input.*broker: missing"):
        config.build(config.ElApp, {"input": {"topic": {"name": "a"}}, "output": {}})


def test_kafka_options(file):
    app = load(file, {"INPUT__CONSUMER__AUTO_OFFSET_RESET": "earliest", "INPUT__CONNECTION__OPTIONS": '{"security.protocol":"SSL"}'})
    assert kafka_options(app.input) == {"kafka.bootstrap.servers": "one:9092", "subscribe": "raw", "startingOffsets": "earliest", "kafka.group.id": "g", "maxOffsetsPerTrigger": "1000", "minOffsetsPerTrigger": "1000", "maxTriggerDelay": "5s", "kafka.security.protocol": "SSL"}
    with pytest.raises(ValueError, match="Arrow"):
        kafka_options(load(file, {"INPUT__TOPIC__FORMAT": "arrow-batch"}).input)


def test_sinks_by_type(file, spark, tmp_path):
    app = load(file)
    dlq = build_sink(app.dlq)
    assert isinstance(dlq, KafkaSink) and dlq.options() == {"kafka.bootstrap.servers": "two:9092", "topic": "dead"}
    sink = build_sink(app.output, dlq)
    assert isinstance(sink, ClickHouseSink) and isinstance(sink, TableSink) and sink.dlq is dlq and sink.split_factor == 4
    assert sink.jdbc_options()["url"] == "jdbc:clickhouse://db:8123/default?ssl=false"
    with pytest.raises(ValueError, match="sink"):
        build_sink("x")
    with pytest.raises(ValueError, match="source"):
        build_source(spark, "x")
    with pytest.raises(ValueError, match="factor"):
        TableSink(lambda: None, split_factor=1)
    out = FileSink(config.FileOutput(str(tmp_path / "o"), config.KafkaTopic("t", key_column="id")))
    out.write(spark.range(3), 1)
    out.write(spark.range(2), 1)  # the batch again
    assert [(r.key, r.value) for r in spark.read.parquet(str(tmp_path / "o")).orderBy("key").collect()] == [("0", '{"id":0}'), ("1", '{"id":1}')]
    rows, config_schema = MemorySink(), spark.createDataFrame([], "id long").schema
    rows.write_rows(spark, [{"id": 4}, {"other": 1}], config_schema)
    import pyarrow as pa

    table = pa.table({"id": [7, 8]})
    rows.write_arrow(spark, table, 1)
    rows.write_arrow(spark, table.to_batches()[0], 1)
    rows.close()
    assert [r.id for r in rows.rows] == [4, None, 7, 8, 7, 8] and isinstance(rows, Sink)


def test_lost_data_can_be_skipped(file):
    assert kafka_options(load(file, {"INPUT__CONSUMER__FAIL_ON_DATA_LOSS": "false"}).input)["failOnDataLoss"] == "false"
