import json
import os

import pytest
from pyspark.sql import functions as F

from millrace import config
from millrace.functions.buckets import live_buckets
from millrace.sinks import MemorySink
from millrace.streaming.nodes import start_dedup, start_documents, start_el

HOUR = 3_600_000
SCHEMA = {"uid": "string", "time": "timestamp[ms]", "val": "int64"}


class Stream:
    def __init__(self, spark, tmp_path, field="uid", window=3, bucket=1, files_per_batch=1):
        self.spark, self.path, self.n, self.sink = spark, tmp_path, 0, MemorySink()
        os.makedirs(tmp_path / "in")
        source = config.FileInput(str(tmp_path / "in"), config.KafkaTopic("t", SCHEMA), files_per_batch=files_per_batch)
        out = config.FileOutput(str(tmp_path / "out"), config.KafkaTopic("o"))
        self.app = config.DedupApp(source, out, config.Dedup(field, window, bucket, str(tmp_path / "state")))

    def put(self, *rows):
        path = self.path / "in" / f"{self.n:04}.txt"
        path.write_text("\n".join(x if isinstance(x, str) else json.dumps(dict(zip(SCHEMA, x, strict=True))) for x in rows))
        os.utime(path, (1_700_000_000 + self.n, 1_700_000_000 + self.n))
        self.n += 1

    def run(self, sink=None):
        query = start_dedup(self.spark, self.app, sink=sink or self.sink, trigger={"availableNow": True}, clock=F.col("time"))
        query.awaitTermination()
        return query

    def values(self):
        return sorted(r.val for r in self.sink.rows)


def test_within_a_batch_across_batches_and_after_restart(spark, tmp_path):
    s = Stream(spark, tmp_path)
    s.put(("x", 0, 1), ("x", 0, 2), (None, 0, 3), (None, 0, 4))
    s.put(("x", HOUR, 5), ("y", HOUR, 6))
    query = s.run()
    assert s.values() == [1, 3, 4, 6]
    counts = [p.observedMetrics["dedup"].asDict() for p in query.recentProgress if "dedup" in p.observedMetrics]
    assert counts[:2] == [{"produced": 3, "marked": 1}, {"produced": 1, "marked": 1}]
    s.put(("x", 2 * HOUR, 7), ("y", 4 * HOUR, 8), (None, 4 * HOUR, 9))
    s.run()
    assert s.values() == [1, 3, 4, 6, 8, 9]


@pytest.mark.parametrize("files_per_batch", [1, 3])
def test_batch_boundaries_change_nothing(spark, tmp_path, files_per_batch):
    s = Stream(spark, tmp_path, window=2, files_per_batch=files_per_batch)
    rows = [(k, t * HOUR // 2) for t in range(9) for k in ("a", "b")]
    last, expected = {}, []
    for i, (k, t) in enumerate(rows):
        if k not in last or t // HOUR - last[k] >= live_buckets(2, 1):
            last[k] = t // HOUR
            expected.append(i)
    for start in range(0, len(rows), 6):
        s.put(*[(k, t, start + i) for i, (k, t) in enumerate(rows[start : start + 6])])
    s.run()
    assert s.values() == expected


class Breaks(MemorySink):
    def write(self, df, batch=0):
        raise RuntimeError("sink is down")


def test_a_failed_batch_marks_nothing(spark, tmp_path):
    s = Stream(spark, tmp_path)
    s.put(("crash", 0, 1))
    with pytest.raises(Exception, match="sink is down"):
        s.run(Breaks())
    s.run()
    assert s.values() == [1]


def test_a_malformed_message_stops_the_query(spark, tmp_path):
    s = Stream(spark, tmp_path)
    s.put("not json")
    with pytest.raises(Exception, match="JSON parse error"):
        s.run()
    assert s.values() == []


def test_other_bucket_lengths_are_refused(spark, tmp_path):
    s = Stream(spark, tmp_path)
    s.put(("x", 0, 1))
    s.run()
    s.app = config.DedupApp(s.app.input, s.app.output, config.Dedup("uid", 3, 2, s.app.dedup.store_dir))
    with pytest.raises(ValueError, match="buckets of 1 hours"):
        s.run()


def test_missing_field_passes_all(spark, tmp_path):
    s = Stream(spark, tmp_path, field="absent")
    s.put(("x", 0, 1), ("x", 0, 2))
    with pytest.warns(UserWarning, match="pass as they are"):
        s.run()
    assert s.values() == [1, 2]


def test_el_delivers_to_files(spark, tmp_path):
    s = Stream(spark, tmp_path)
    s.put(("a", 1, 1), "", ("b", 2, 2))
    app = config.ElApp(s.app.input, s.app.output, checkpoint=str(tmp_path / "el"))
    query = start_el(spark, app, trigger={"availableNow": True})
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(json.loads(r.value)["uid"] for r in got) == ["a", "b"]
    assert query.recentProgress[0].observedMetrics["decode"].asDict() == {"messages": 3, "rows": 2}


def test_documents_pass_without_a_schema(spark, tmp_path):
    s = Stream(spark, tmp_path)
    s.put('{"uid":"a","deep":{"x":[1,null]}}', "not json", '{"uid":null}', '{"other":true}')
    out = config.FileOutput(str(tmp_path / "out"), config.KafkaTopic("o", key_column="uid"))
    query = start_documents(spark, config.ElApp(s.app.input, out, checkpoint=str(tmp_path / "docs")), trigger={"availableNow": True})
    query.awaitTermination()
    got = {r.value: r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {'{"deep":{"x":[1,null]},"uid":"a"}': "a", '{"uid":null}': "None", '{"other":true}': None}
    assert query.recentProgress[0].observedMetrics["decode"].asDict() == {"messages": 4, "rejected": 1}
    with pytest.raises(ValueError, match="sink of messages"):
        start_documents(spark, config.ElApp(s.app.input, out), sink=MemorySink())


def test_cli_usage(capsys):
    from millrace.streaming.__main__ import main

    assert main([]) == 2 and "el|dedup|documents" in capsys.readouterr().err


def test_messages_without_rows_are_warned_of(spark, tmp_path, caplog):
    import time

    s = Stream(spark, tmp_path)
    s.put(("x", 0, 1), "  ", "", ("y", 0, 2))
    with caplog.at_level("WARNING", "millrace.streaming.nodes"):
        s.run()
        until = time.time() + 20
        # progress of a query before may still arrive
        while not (said := [m for r in caplog.records if (m := r.getMessage()).startswith("dedup: ") and m.endswith("gave no row")]) and time.time() < until:
            time.sleep(0.1)
    assert said == ["dedup: batch 0, 2 messages gave no row"]
