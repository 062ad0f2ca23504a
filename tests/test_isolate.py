import pyarrow as pa
import pytest

from millrace.operators import isolate
from millrace.sinks import MemorySink, TableSink


def uids(n):
    return pa.table({"uid": [f"uid-{i}" for i in range(n)], "traffic_in": [100 + i for i in range(n)]})


class Script:
    """A sink that fails as told and counts."""

    def __init__(self, bad):
        self.bad, self.calls, self.stored = bad, 0, []

    def __call__(self, table):
        self.calls += 1
        if self.bad(self, table):
            raise RuntimeError("refused")
        self.stored += table["uid"].to_pylist()


def test_retry_succeeds_at_the_third_attempt():
    waits = []
    sink = Script(lambda s, t: s.calls < 3)
    isolate.insert_with_retry(sink, uids(2), sleep=waits.append)
    assert sink.calls == 3 and waits == [1.0, 1.0] and sink.stored == ["uid-0", "uid-1"]


def test_retry_gives_up_with_the_last_error():
    sink = Script(lambda s, t: True)
    with pytest.raises(RuntimeError, match="refused"):
        isolate.insert_with_retry(sink, uids(1), wait=0)
    assert sink.calls == 3


@pytest.mark.parametrize("n, factor", [(4, 2), (19, 10), (1000, 10), (7, 3), (1, 2)])
def test_exactly_the_bad_rows_come_back_in_order(n, factor):
    bad = {f"uid-{i}" for i in range(n) if i % 7 == 2 or n == 1}
    sink = Script(lambda s, t: bool(bad & set(t["uid"].to_pylist())))
    out = [t["uid"][0].as_py() for t in isolate.rejected(sink, uids(n), factor, wait=0)]
    assert out == sorted(bad, key=lambda u: int(u[4:]))
    assert sorted(sink.stored) == sorted(set(uids(n)["uid"].to_pylist()) - bad)


def test_a_sink_that_takes_chunks_rejects_nothing():
    sink = Script(lambda s, t: len(t) == 4)
    assert list(isolate.rejected(sink, uids(4), 2, wait=0)) == []
    assert sink.stored == [f"uid-{i}" for i in range(4)]


def test_empty_tables_and_bad_factors():
    assert list(isolate.rejected(Script(lambda s, t: True), uids(0), 2)) == []
    for f in (0, 1):
        with pytest.raises(ValueError, match="factor"):
            list(isolate.rejected(Script(lambda s, t: False), uids(2), f))


def test_attempts_for_one_bad_row_among_a_thousand():
    sink = Script(lambda s, t: "uid-123" in t["uid"].to_pylist())
    whole = pytest.raises(RuntimeError)
    with whole:
        isolate.insert_with_retry(sink, uids(1000), wait=0)
    assert len(list(isolate.rejected(sink, uids(1000), 10, wait=0))) == 1
    assert sink.calls == 42


def picky():
    """Made anew, so that it is shipped to the workers by value."""

    def connect():
        def insert(table):
            if any(v is not None and v % 50 == 7 for v in table["id"].to_pylist()):
                raise ValueError("bad id")

        return insert

    return connect


def test_table_sink_sends_bad_rows_to_the_dlq_once(spark):
    dlq = MemorySink()
    TableSink(picky(), dlq, 10, wait=0.0).write(spark.range(200), 5)
    assert sorted(r.id for r in dlq.batches[5]) == [7, 57, 107, 157] and dlq.flushes == 1


def test_table_sink_without_dlq_fails(spark):
    with pytest.raises(Exception, match="bad id"):
        TableSink(picky(), wait=0.0).write(spark.range(200))
    TableSink(picky(), wait=0.0).write(spark.range(5))


def test_chained_table_sinks(spark):
    last = MemorySink()
    inner = TableSink(picky(), last, 10, wait=0.0)
    TableSink(picky(), inner, 10, wait=0.0).write(spark.range(60))
    assert sorted(r.id for r in last.rows) == [7, 57]


def test_retries_are_warned_of(caplog):
    sink = Script(lambda s, t: s.calls < 3)
    with caplog.at_level("WARNING"):
        isolate.insert_with_retry(sink, uids(2), wait=0)
    assert [r.getMessage().split(": ")[0] for r in caplog.records] == [f"insert of 2 rows failed at attempt {k} of 3" for k in (1, 2)]


def fake_client(folder):
    """A client that records its calls as files, as tasks run in other processes."""

    def client(**options):
        import json
        import uuid
        from pathlib import Path

        path = Path(folder) / uuid.uuid4().hex

        class Client:
            ids, closed = [], 0

            def insert_arrow(self, table, arrow_table):
                got = arrow_table["id"].to_pylist()
                if any(v % 50 == 7 for v in got):
                    raise ValueError("bad id")
                self.ids = self.ids + [[table, v] for v in got]

            def close(self):
                self.closed += 1
                path.write_text(json.dumps([options, self.ids, self.closed]))

        return Client()

    return client


def test_clickhouse_sink_with_a_client_of_ours(spark, tmp_path):
    import json

    from millrace.config import ClickHouseConnection, ClickHouseOutput, ClickHouseTable
    from millrace.sinks import ClickHouseSink

    dlq = MemorySink()
    settings = ClickHouseOutput(ClickHouseConnection("db"), ClickHouseTable("events"))
    ClickHouseSink(settings, dlq, fake_client(str(tmp_path)), wait=0.0).write(spark.range(200), 1)
    tasks = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    assert sorted(v for _, ids, _ in tasks for t, v in ids if t == "events") == [v for v in range(200) if v % 50 != 7]
    assert all(options["host"] == "db" and closed == 1 for options, _, closed in tasks)
    assert sorted(r.id for r in dlq.rows) == [7, 57, 107, 157]
    before = len(tasks)
    with pytest.raises(Exception, match="bad id"):
        ClickHouseSink(settings, None, fake_client(str(tmp_path)), wait=0.0).write(spark.range(200), 2)
    assert len(list(tmp_path.iterdir())) > before  # closed though it failed
