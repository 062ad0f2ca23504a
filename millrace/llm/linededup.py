"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

Every distinct line that occurs more than once gets an ID, its rank among them. A suffix of a document's lines is
ranked by its first 1, 2, 4, ... lines: the rank at twice the depth is the rank of the pair (rank here, rank that many
lines on) among the distinct repeated pairs. Suffixes of equal rank at depth `min_run` are an interval of the suffix
array whose common prefixes are at least that long; suffixes that fall out of every such interval (an end of document
or a line that is nowhere else lies within the depth) are dropped at once, as they repeat nothing. In each interval the
occurrence with the smallest (id, line) is the first copy, and all others are later copies.

Ranks stop at that depth, as those beyond it would only order suffixes within an interval and change no deletion. How far the
common prefix of a later copy and the first one goes on is told by the suffixes after it: the next suffix shares one line
less with the one after the first copy. So neighbouring later copies whose first copies are neighbours too are
one run, which is as long as their number and the depth less one; it ends where the copy ends or where an earlier first copy
takes over. The lines of the runs are deleted. A single line of at least `min_words` words is a passage of its own:
the intervals of depth 1 give its later copies, which are deleted too.

All of it is DataFrame operations. Ranks are dealt to distinct lines and pairs after an aggregate that combines on the
map side, so that a line or passage in a third of all documents is one row there; joins on lines and ranks leave the rows
of hot keys where they are (`split_join`). No document's lines are gathered except to write that document's text.

Defined cases: a null text has no lines; an empty text is one empty line; windows of nothing but white space never
count as repeated; rows with equal id and equal text are one document, each copy with the same result; null ids come
last; an empty table gives an empty result; columns that aren't asked for by `carry` are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import global_index, ranged, split_join, table, word_count
from millrace.stages import cut

MIN_RUN = 2
#: Words of a single line that count as a passage.
MIN_WORDS = 50


def _rank(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct repeated keys with `rank`, their place in order, `first`, the first suffix that has them, and `_n`, how many do."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("doc"), F.col("pos"))
    found = keys.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("first")).where("_n > 1")
    first = F.struct("first.doc", "first.pos").alias("first")
    return cut(global_index(ranged(found, [F.col(c) for c in columns], "line-ranks")).select(*columns, F.col("_idx").alias("rank"), first, "_n"), "line-ranked")


def repeated_suffixes(lines: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(doc, doc_id, pos, line, blank, long) to (doc, doc_id, pos, rank, first) of the suffixes whose first line (with `blank` and
    `long`), and whose first `depth` lines, stand elsewhere too; `first` is the first copy."""
    own = ("doc", "doc_id", "pos")
    single = ranks = cut(split_join(lines, _rank(lines, ["line"]), ["line"]).select(*own, "rank", "first", "blank", "long"), "line-suffixes")
    have = 1
    while have < depth:
        step = min(have, depth - have)  # the last step overlaps where the depth is no power of two
        on = ranks.select("doc", (F.col("pos") - step).alias("pos"), F.col("rank").alias("b"))
        pairs = cut(ranks.select(*own, F.col("rank").alias("a")).join(on.hint("merge"), ["doc", "pos"]), "line-pairs")
        ranks = cut(split_join(pairs, _rank(pairs, ["a", "b"]), ["a", "b"]).select(*own, "rank", "first"), "line-suffixes")
        have += step
    return single, ranks


def _later() -> Column:
    """Whether a suffix isn't the first of its interval."""
    return (F.col("doc") != F.col("first.doc")) | (F.col("pos") != F.col("first.pos"))


def repeated_runs(suffixes: DataFrame, depth: int) -> DataFrame:
    """(doc, pos, length, first) of the runs of `depth` lines or more that stand earlier too, at `first`."""
    order = Window.partitionBy("doc").orderBy("pos")  # one document's lines at most
    last, was = F.lag("first").over(order), F.lag("pos").over(order)
    goes_on = (was == F.col("pos") - 1) & (last["doc"] == F.col("first.doc")) & (last["pos"] == F.col("first.pos") - 1)
    copies = suffixes.where(_later()).select("doc", "pos", "first")
    told = copies.withColumn("starts", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("run", F.sum("starts").over(order))
    runs = told.groupBy("doc", "run").agg(F.min("pos").alias("pos"), (F.count(F.lit(1)) + (depth - 1)).cast("int").alias("length"), F.min_by("first", "pos").alias("first"))
    return runs.select("doc", "pos", "length", "first")


def _gone(single: DataFrame, suffixes: DataFrame, min_run: int) -> DataFrame:
    """(doc, pos) of the lines to delete: later copies of long single lines, and of the runs' windows that aren't blank."""
    # of runs that overlap, a later one is cut back to the windows that the others don't have, so that no line is told often
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("pos") + F.col("length")).over(before) - (min_run - 1)
    runs = repeated_runs(suffixes, min_run).select("doc", F.greatest("pos", reach).alias("start"), (F.col("pos") + F.col("length") - 1).alias("end"))
    covered = runs.where(F.col("end") - F.col("start") >= min_run - 1).select("*", F.explode(F.sequence("start", "end")).alias("pos"))
    # a line that isn't blank takes with it the lines of the run that share a window with it
    solid = covered.join(single.where("not blank").select("doc", "pos").hint("merge"), ["doc", "pos"])
    near = F.sequence(F.greatest("start", F.col("pos") - (min_run - 1)), F.least("end", F.col("pos") + (min_run - 1)))
    return single.where(F.col("long") & _later()).select("doc", "pos").union(solid.select("doc", F.explode(near).alias("pos")))


def dedup_lines(docs: DataFrame, min_run: int = MIN_RUN, *, min_words: int = MIN_WORDS, row_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, text (kept lines, null stays null), n_lines, removed (sorted line numbers from 0),
    n_runs (maximal removed runs) and `carried_<name>`."""
    if min_run < 1 or min_words < 1:
        raise ValueError("min_run and min_words must be positive")
    digest = F.md5(F.concat(F.coalesce(F.col(row_id).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    rows = docs.select(F.col(row_id).alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(f"carried_{c}") for c in carry], F.unhex(digest).alias("doc"))
    split = F.split("text", "\n", -1)
    exploded = rows.where("text is not null").select("doc", "doc_id", F.posexplode(split).alias("pos", "_line"))
    long = F.when(F.octet_length("_line") >= 2 * min_words - 1, word_count(F.col("_line")) >= min_words).otherwise(False)
    lines = cut(exploded.select("doc", "doc_id", "pos", F.unhex(F.md5(F.col("_line").cast("binary"))).alias("line"), (F.trim("_line") == "").alias("blank"), long.alias("long")), "lines")
    # a row repeated in full gives each line twice: one of them stands for both
    lines = cut(lines.groupBy("doc", "doc_id", "pos").agg(*[F.first(c).alias(c) for c in ("line", "blank", "long")]), "lines-once")
    gone = _gone(*repeated_suffixes(lines, min_run), min_run)
    removed = gone.groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("removed"))
    out = rows.join(removed.hint("merge"), "doc", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(split))
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("removed"))
    # the split text is bound to a name, as it would be split again for each kept line
    joined = F.transform(F.array(split), lambda own: F.array_join(F.transform(left, lambda i: F.element_at(own, i + 1)), "\n"))
    kept = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.element_at(joined, 1))
    runs = F.size(F.array_except("removed", F.transform("removed", lambda i: i + 1)))
    return out.select("doc_id", kept.alias("text"), n_lines.cast("long").alias("n_lines"), "removed", runs.cast("long").alias("n_runs"), *[f"carried_{c}" for c in carry])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "n_runs", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op9_line_dedup": op9_line_dedup}
SQL = {
    "op9_line_dedup": rf"""
WITH d AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents),
w AS (SELECT doc_id, i, array_to_string(l[i:i + {MIN_RUN - 1}], chr(10)) AS win FROM (SELECT *, unnest(generate_series(1, len(l) - {MIN_RUN - 1})) AS i FROM d WHERE len(l) >= {MIN_RUN})),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS LAST, i) AS n FROM w) WHERE n > 1 AND trim(win, ' ' || chr(10)) <> ''),
passages AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id NULLS LAST, i) AS n FROM (SELECT doc_id, unnest(l) AS x, unnest(generate_series(1, len(l))) AS i FROM d)) WHERE n > 1 AND len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= {MIN_WORDS}),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {MIN_RUN - 1})) AS i FROM later UNION SELECT doc_id, i FROM passages),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (was IS NULL OR was <> i - 1) AS n_runs FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS was FROM gone) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, unnest(l) AS x, unnest(generate_series(1, len(l))) AS i FROM d) AS e ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
}
