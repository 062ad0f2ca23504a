import datetime
import re
import time

import pytest

from millrace.llm import linededup as L
from millrace.llm import urlfilter as U


def plain(texts, k, words=50):
    """Texts in order of id; windows of k lines that stand earlier are deleted, and single lines of `words` words."""
    lines = [t.split("\n") if t is not None else [] for t in texts]
    seen, gone, known = set(), [set() for _ in texts], set()
    for d, own in enumerate(lines):
        for i in range(len(own) - k + 1):
            w = tuple(own[i : i + k])
            if w in seen and any(x.strip(" ") for x in w):
                gone[d].update(range(i, i + k))
            seen.add(w)
        for i, x in enumerate(own):
            if x in known and len(re.findall("[^\x20\x09-\x0d]+", x)) >= words:
                gone[d].add(i)
            known.add(x)
    return [(None if t is None else "\n".join(x for i, x in enumerate(own) if i not in g), sorted(g)) for t, own, g in zip(texts, lines, gone, strict=True)]


TEXTS = ["a\nb\nc", "x\na\nb\nc\ny", None, "", "a\nb", "b\nc\na\nb", "q\nq\nq\nq", "\n\n\n", "\n\n", "a\nb\nc", "lone", "x\na\nz"]


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_equals_the_plain_version(spark, k):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = sorted(L.dedup_lines(df, k).collect(), key=lambda r: r.doc_id)
    assert [(r.text, r.removed) for r in got] == plain(TEXTS, k)
    got = sorted(L.dedup_lines(df, k, min_words=1).collect(), key=lambda r: r.doc_id)
    assert [(r.text, r.removed) for r in got] == plain(TEXTS, k, 1)
    for r in got:
        assert r.n_runs == sum(x - 1 not in r.removed for x in r.removed)


@pytest.mark.parametrize("k", [2, 3])
def test_runs_go_on_until_the_copy_ends_or_an_earlier_one_takes_over(spark, k):
    body = "\n".join(f"l{i}" for i in range(40))
    texts = [*(t for t in TEXTS if t is not None), "p\n" * 50, body, "s\n" + body + "\nt", body[:90] + "\n" + body, "u\n\n\nv", "u\n\n\nw"]
    own = [t.split("\n") for t in texts]
    first, later = {}, {}
    for d, lines in enumerate(own):
        for i in range(len(lines) - k + 1):
            at = first.setdefault(tuple(lines[i : i + k]), (d, i))
            if at != (d, i):
                later[d, i] = at
    rows = [(bytes([d]), d, i, x.encode(), False, False) for d, lines in enumerate(own) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc binary, doc_id long, pos int, line binary, blank boolean, long boolean")
    covered = []
    for r in L.repeated_runs(L.repeated_suffixes(df, k)[1], k).collect():
        d, i, e, j = r.doc[0], r.pos, r.first.doc[0], r.first.pos
        assert (e, j) < (d, i) and own[d][i : i + r.length] == own[e][j : j + r.length]
        n = r.length - k + 1
        assert [later[d, i + x] for x in range(n)] == [(e, j + x) for x in range(n)]
        assert later.get((d, i + n)) != (e, j + n) and later.get((d, i - 1)) != (e, j - 1)
        covered += [(d, i + x) for x in range(n)]
    assert sorted(covered) == sorted(later)


def test_a_long_text_of_one_line_takes_linear_work(spark):
    df = spark.createDataFrame([(1, "\n".join(["same"] * 4_000))], "doc_id long, text string")
    start = time.time()
    got = L.dedup_lines(df).first()
    assert got.text == "same" and got.n_runs == 1 and len(got.removed) == 3_999
    assert time.time() - start < 60


def test_passages_on_one_line_and_hot_lines(spark):
    """A line of 50 words counts by itself, one of 49 doesn't; a line in most documents is no obstacle."""
    words = " ".join(f"w{i}" for i in range(50))
    texts = [f"{i}\n{words if i % 3 else words[:-4]}\nx{i}" for i in range(40)] + [words, words + " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(L.dedup_lines(df).collect(), key=lambda r: r.doc_id)
    assert [(r.text, r.removed) for r in got] == plain(texts, 2)
    assert [r.doc_id for r in got if r.removed] == [i for i in range(2, 40) if i % 3] + [40]


def test_a_very_long_text_is_split_once(spark):
    body = "\n".join(f"line {i}" for i in range(24_000))
    df = spark.createDataFrame([(1, body), (2, "first\n" + body + "\nlast")], "doc_id long, text string")
    start = time.time()
    got = sorted(L.dedup_lines(df).collect(), key=lambda r: r.doc_id)
    assert got[0].text == body and got[1].text == "first\nlast" and got[1].n_runs == 1
    assert time.time() - start < 60


def test_lines_of_odd_rows(spark, odd):
    got = L.dedup_lines(odd, 1, carry=("line", "removed")).collect()
    assert len(got) == odd.count()
    copies = [r.text for r in got if r.doc_id == 1]
    assert len(copies) == 2 and copies[0] == copies[1] != ""
    assert [r.text for r in got if r.doc_id == 7] == [""]
    assert L.dedup_lines(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        L.dedup_lines(odd, 0)


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


EVENTS = [("host", "a.x.org", 1, "add"), ("host", "a.x.org", 3, "add"), ("host", "a.x.org", 5, "remove"), ("host", "a.x.org", 8, "add"), ("domain", "y.org", 2, "add"), ("domain", "y.org", 2, "remove"), ("domain", "y.org", 4, "add"), ("prefix", "z.com/p/q", 0, "add"), ("host", "z.com", 6, "remove"), (None, "a.x.org", 0, "add"), ("host", None, 0, "add")]
URLS = ["http://a.x.org/", "HTTPS://u:p@A.X.org:80/z?y.org", "http://b.a.x.org/", "http://s.y.org/p/q", "http://y.org", "http://xy.org/", "http://z.com/p/q/r?x=1", "http://z.com/p", "http://z.com/p//q#f", "http://z.com/pp/q", None, "", "no url", "http:///p/q"]


def active(url, n):
    """Entries active on day n that match."""
    on = {}
    for kind, pattern, d, action in sorted((e for e in EVENTS if None not in e), key=lambda e: (e[2], e[3])):
        if d <= n:
            on[kind, pattern] = action == "add"
    if not url or "://" not in url or url.startswith("http:///"):
        return []
    rest = url.split("://", 1)[1]
    host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower()
    path = ("/" + rest.split("/", 1)[1] if "/" in rest else "").split("?")[0].split("#")[0]
    parts = [p for p in path.split("/") if p]
    keys = {("host", host)} | {("domain", ".".join(host.split(".")[i:])) for i in range(len(host.split(".")))} | {("prefix", host + "/" + "/".join(parts[: i + 1])) for i in range(len(parts))}
    return sorted(f"{k}:{p}" for (k, p), v in on.items() if v and (k, p) in keys)


def test_captures_are_held_against_the_list_of_their_day(spark):
    events = spark.createDataFrame([(k, p, day(d), a) for k, p, d, a in EVENTS], "kind string, pattern string, day date, action string")
    captures = [(u, n) for u in URLS for n in range(10)]
    df = spark.createDataFrame([(u, day(n), n, "x") for u, n in captures], "url string, day date, n long, entry string")
    got = {(r.url, r.carried_n): r for r in U.judge(df, events, carry=("n", "entry")).collect()}
    assert len(got) == len(captures)
    for u, n in captures:
        want, r = active(u, n), got[u, n]
        assert (r.n_active, r.blocked, r.entry) == (len(want), bool(want), want[0] if want else None), (u, n)
    assert got[URLS[0], 4].since == day(1) and got[URLS[0], 9].since == day(8)


def test_odd_captures(spark):
    events = spark.createDataFrame([], "kind string, pattern string, day date, action string")
    df = spark.createDataFrame([("http://a.b/", None), (None, None), ("http://a.b/", day(1)), ("http://a.b/", day(1)), ("http://a.b/" + "p/" * 2000, day(1))], "url string, day date")
    assert [r.n_active for r in U.judge(df, events).collect()] == [0] * 5
    assert U.judge(df.limit(0), events).count() == 0


def test_hot_keys_stay_out_of_exchanges(spark):
    """A list that can't be broadcast, a domain in most captures, an unlisted suffix in all, and one capture repeated."""
    from pyspark.sql import functions as F

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        events = spark.createDataFrame([("domain", "hot.com", day(1), "add"), ("domain", "hot.com", day(3), "remove")], "kind string, pattern string, day date, action string")
        events = events.union(spark.range(2000).select(F.lit("host"), F.concat(F.lit("h"), "id", F.lit(".com")), F.lit(day(0)), F.lit("add")))
        hot = spark.range(9000).select(F.concat(F.lit("http://w"), "id", F.lit(".hot.com/")).alias("url"), F.expr("date_add(DATE '2024-01-01', cast(id % 5 as int))").alias("day"))
        cold = spark.range(1000).select(F.concat(F.lit("http://h"), F.col("id") * 3, F.lit(".com/")), F.lit(day(2)))
        same = spark.range(3000).select(F.lit("http://w1.hot.com/x"), F.lit(day(2)))
        none = spark.range(500).select(F.lit(None).cast("string"), F.lit(day(2)))
        out = U.judge(hot.union(cold).union(same).union(none), events)
        # date_add(2024-01-01, 1) and 2 are the days on which hot.com is listed
        assert {tuple(r) for r in out.groupBy("entry").count().collect() if r.entry == "domain:hot.com" or r.entry is None} == {("domain:hot.com", 3600 + 3000), (None, 5400 + 333 + 500)}
        assert out.count() == 13_500 and out.where("blocked").count() == 3600 + 667 + 3000
        # hot rows meet their verdicts by broadcast though plain joins may not
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
