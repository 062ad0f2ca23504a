"""URL filters by temporal list join.

A list is a log of dated events (add, remove) for entries of three kinds: `host` (one host), `domain` (a domain and
all hosts below it) and `prefix` (a host with leading path segments). Events become validity intervals; a capture is
held against the entries that were active on the day it was fetched, whatever was listed before or since.

A capture's verdict depends on its URL and day alone, so distinct pairs are judged: each yields its host, its parent
domains and its path prefixes as keys, an equi-join on (kind, key) finds intervals, and the as-of condition keeps
those that hold the day. Keys are counted first, by an aggregate that combines on the map side, and the counts meet the
list; the intervals of a key, one a day at most, are then one row with its count. So the rows of frequent keys, listed or
not (`com`), and of frequent captures stay where they are (`split_join`), and only the rest is exchanged. Captures
without a URL or a day take part in no exchange.

Defined cases: null URLs and URLs without a scheme or host match nothing and stay in the result; a null day matches
nothing; an add while listed changes nothing, a remove while not listed neither; an entry added and removed on the same day is off
that day; events without kind, pattern, day or action are left out; repeated rows each return; empty tables
give no matches or no rows; carried columns are renamed, so clashing names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import split_join, table
from millrace.stages import cut

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-cased host without user and port; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), "^.*@", ""), ":[0-9]*$", ""))


def intervals(events: DataFrame) -> DataFrame:
    """Events (kind, pattern, day, action) to validity intervals (kind, pattern, since, until), until exclusive or null.

    Of several events of a day the removal counts. An interval begins at an add that follows a remove or nothing.
    """
    daily = events.dropna(subset=["kind", "pattern", "day", "action"]).groupBy("kind", "pattern", "day").agg(F.max(F.col("action") == "remove").alias("off"))
    line = Window.partitionBy("kind", "pattern").orderBy("day")
    turns = daily.withColumn("_was", F.lag("off").over(line)).where("off <> coalesce(_was, true)")
    return turns.withColumn("until", F.lead("day").over(line)).where("not off").select("kind", "pattern", F.col("day").alias("since"), "until")


def _keys(host: Column, path: Column) -> Column:
    labels, parts = F.split(host, "\\."), F.filter(F.split(path, "/"), lambda x: x != "")
    n, m = F.size(labels), F.size(parts)

    def key(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("pattern"))

    none = F.array().cast("array<struct<kind:string,pattern:string>>")
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: key("domain", F.array_join(F.slice(labels, i, n - i + 1), ".")))
    prefixes = F.transform(F.sequence(F.lit(1), m), lambda i: key("prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))
    return F.concat(F.array(key("host", host)), domains, F.when(m > 0, prefixes).otherwise(none))


def judge(captures: DataFrame, events: DataFrame, *, url: str = "url", day: str = "day", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per capture: url, host, day, blocked, n_active (entries active that day), entry (the first of them as
    kind:pattern), since (when that one's interval began) and `carried_<name>`."""
    rows = captures.select(F.col(url).alias("url"), F.col(day).cast("date").alias("day"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    dated = "url is not null and day is not null"
    asked = cut(rows.where(dated).groupBy("url", "day").agg(F.count(F.lit(1)).alias("_n")), "url-asked")
    hosts = asked.select("url", "day", host_of(F.col("url")).alias("_host")).where("_host <> ''")
    keys = hosts.select("url", "day", F.explode(_keys(F.col("_host"), F.regexp_extract("url", _PATH, 1))).alias("k")).select("url", "day", "k.kind", "k.pattern")
    listed = intervals(events).groupBy("kind", "pattern").agg(F.collect_list(F.struct("since", "until")).alias("spans"))
    known = cut(keys.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("_n")).join(listed, ["kind", "pattern"], "left"), "url-keys")
    met = split_join(keys, known, ["kind", "pattern"]).where("spans is not null")
    held = met.select("url", "day", "kind", "pattern", F.explode("spans").alias("span")).where("day >= span.since and (span.until is null or day < span.until)")
    first = F.min(F.struct(F.concat_ws(":", "kind", "pattern").alias("entry"), F.col("span.since").alias("since"))).alias("first")
    verdicts = held.groupBy("url", "day").agg(F.count(F.lit(1)).alias("n"), first)
    judged = cut(asked.join(verdicts, ["url", "day"], "left"), "url-judged")
    out = split_join(rows.where(dated), judged, ["url", "day"]).unionByName(rows.where(f"not ({dated})"), allowMissingColumns=True)
    return out.select(
        "url",
        F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
        "day",
        F.col("n").isNotNull().alias("blocked"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_active"),
        F.col("first.entry").alias("entry"),
        F.col("first.since").alias("since"),
        *[f"carried_{c}" for c in carry],
    )


# The tables have no capture days and no list, so both follow from rules over hashes: every host in seven, every first
# path segment of a host in eleven and one domain are listed, some are removed, and some of these listed again.
_HASH = "CAST(conv(substr(md5({0}), 1, 8), 16, 10) AS BIGINT)"
_LISTED = """
WITH h AS (SELECT DISTINCT host FROM pages_of WHERE host <> ''),
p AS (SELECT DISTINCT 'prefix' AS kind, host || '/' || regexp_extract(url, '://[^/?#]*/([^/?#]+)', 1) AS pattern FROM pages_of WHERE host <> '' AND regexp_extract(url, '://[^/?#]*/([^/?#]+)', 1) <> ''),
n AS (SELECT 'host' AS kind, host AS pattern, {host_hash} AS x FROM h UNION ALL SELECT kind, pattern, {pattern_hash} AS x FROM p),
e AS (SELECT kind, pattern, x, CAST(DATE '2024-01-01' + CAST(x % 300 AS INT) AS DATE) AS day FROM n WHERE (kind = 'host' AND x % 7 = 0) OR (kind = 'prefix' AND x % 11 = 0))
SELECT kind, pattern, day, 'add' AS action FROM e
UNION ALL SELECT kind, pattern, CAST(day + CAST(30 + x % 60 AS INT) AS DATE), 'remove' FROM e WHERE x % 2 = 0
UNION ALL SELECT kind, pattern, CAST(day + CAST(130 + x % 60 AS INT) AS DATE), 'add' FROM e WHERE x % 6 = 0
UNION ALL SELECT 'domain', 'example.org', DATE '2024-10-01', 'add'
UNION ALL SELECT 'domain', 'example.org', DATE '2024-10-15', 'remove'
"""


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    day = F.expr(f"DATE '2024-01-01' + CAST({_HASH.format('CAST(page_id AS STRING)')} % 366 AS INT)")
    sql = _LISTED.format(host_hash=_HASH.format("host"), pattern_hash=_HASH.format("pattern"))
    events = spark.sql(sql.replace("pages_of", "{pages_of}"), pages_of=pages)
    judged = judge(pages.withColumn("day", day), events, carry=("page_id",))
    return judged.select(F.col("carried_page_id").alias("page_id"), "url", "host", F.col("day").alias("fetched_on"), "blocked", "n_active", "entry", "since")


QUERIES = {"op7_url_filter": op7_url_filter}
_DUCK_HASH = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"
_DUCK_HOST = rf"lower(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '{_AUTHORITY}', 1), '^.*@', ''), ':[0-9]*$', ''))"
SQL = {
    "op7_url_filter": rf"""
WITH pages_of AS (SELECT page_id, url, {_DUCK_HOST} AS host, CAST(DATE '2024-01-01' + CAST({_DUCK_HASH.format("CAST(page_id AS VARCHAR)")} % 366 AS INT) AS DATE) AS day FROM pages),
events AS ({_LISTED.format(host_hash=_DUCK_HASH.format("host"), pattern_hash=_DUCK_HASH.format("pattern"))}),
daily AS (SELECT kind, pattern, day, bool_or(action = 'remove') AS off FROM events GROUP BY ALL),
turns AS (SELECT * FROM (SELECT *, lag(off) OVER (PARTITION BY kind, pattern ORDER BY day) AS was FROM daily) WHERE off <> coalesce(was, true)),
spans AS (SELECT * FROM (SELECT kind, pattern, off, day AS since, lead(day) OVER (PARTITION BY kind, pattern ORDER BY day) AS until FROM turns) WHERE NOT off),
split AS (SELECT page_id, url, host, day, string_split(host, '.') AS labels, list_filter(string_split(regexp_extract(url, '{_PATH}', 1), '/'), lambda x: x <> '') AS parts FROM pages_of WHERE host <> ''),
keys AS (SELECT page_id, url, day, 'host' AS kind, host AS pattern FROM split
  UNION ALL SELECT page_id, url, day, 'domain', array_to_string(labels[i:], '.') FROM (SELECT *, unnest(generate_series(1, len(labels))) AS i FROM split)
  UNION ALL SELECT page_id, url, day, 'prefix', host || '/' || array_to_string(parts[1:i], '/') FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM split)),
held AS (SELECT page_id, count(*) AS n, min({{'entry': kind || ':' || pattern, 'since': since}}) AS first FROM keys JOIN spans USING (kind, pattern) WHERE day >= since AND (until IS NULL OR day < until) GROUP BY page_id)
SELECT p.page_id, p.url, p.host, p.day AS fetched_on, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_active, first.entry AS entry, first.since AS since
FROM pages_of p LEFT JOIN held USING (page_id)
"""
}
