"""The lineage tables, projected onto the test tables, as DataFrames and as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")).cast("long")


# documents as file versions: even ids are the old version, odd ids the new one


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, side, content, content_id) of every document."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 2 == 0, "old").otherwise("new").alias("side"), F.coalesce("text", F.lit("")).alias("content"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content_id"))


VERSIONS = "v AS (SELECT doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS side, coalesce(text, '') AS content, md5(coalesce(text, '')) AS content_id FROM documents)"
#: tracked lines of every version
LINES = VERSIONS + r""",
raw AS (SELECT path, side, content_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS number FROM v),
t AS (SELECT path, side, content_id, number, regexp_extract_all(line, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]') AS tokens FROM raw),
l AS (SELECT path, side, content_id, CAST(number AS INTEGER) AS number, tokens, md5(array_to_string(tokens, ' ')) AS fingerprint, CAST(len(list_filter(tokens, lambda x: regexp_matches(x, '[\p{L}\p{N}_]'))) AS INTEGER) AS content_tokens FROM t WHERE len(tokens) > 0)"""


# conversations as version chains: a turn is a version of the conversation's file


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, ord, text, content_id, size) of every turn."""
    turns = read(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    return turns.select("conv_id", F.col("turn").alias("ord"), "role", text.alias("text"), F.md5(text.cast("binary")).alias("content_id"), F.length(text).cast("long").alias("size"))


CHAIN = "c AS (SELECT conv_id, turn AS ord, role, coalesce(text, '') AS text, md5(coalesce(text, '')) AS content_id, CAST(length(coalesce(text, '')) AS BIGINT) AS size FROM conversations)"


# events as lines and fates: a signup is a line's birth, later events of its user are its sightings and fates


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the store."""
    e = _events(spark, sf_dir)
    seen = e.where(F.col("line_id").isNotNull()).groupBy("line_id").agg(F.max("at").alias("last_seen_at"))
    born = e.where("event_type = 'signup'").select(
        F.col("event_id").alias("line_id"),
        F.md5(F.col("user_id").cast("string").cast("binary")).alias("file_path_hash"),
        F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("c"), F.col("event_id") % 40)).alias("birth_commit"),
        F.col("at").alias("birth_ts"),
        (F.col("event_id") % 13 != 0).alias("birth_observed"),
        F.when(F.col("value") > 40, F.concat(F.lit("s"), F.col("event_id") % 7)).alias("session_id"),
        F.when(F.col("event_id") % 3 == 0, "function").when(F.col("event_id") % 3 == 1, "call").otherwise("comment").alias("syntactic_role"),
    )
    return born.join(seen, "line_id")


def fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fates of the store."""
    e = _events(spark, sf_dir).where(F.col("line_id").isNotNull() & F.col("event_type").isin("error", "click", "purchase"))
    state = F.when(F.col("event_type") == "error", "dead").when(F.col("event_type") == "click", "edited").otherwise("moved")
    return e.select(
        F.col("event_id").alias("seq"),
        "line_id",
        F.col("at").alias("observed_at"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("c"), F.col("event_id") % 40)).alias("observed_commit"),
        F.col("before").alias("previous_seen_at"),
        state.alias("state"),
        F.when(F.col("event_type") == "click", F.col("value") / 500).alias("birth_similarity"),
        (F.col("event_id") % 7 == 0).alias("before_first_commit"),
        F.element_at(F.array(F.lit("histogram_diff"), F.lit("within_hunk_alignment"), F.lit("no_match"), F.lit("intra_file_move")), (F.col("event_id") % 4 + 1).cast("int")).alias("deciding_layer"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha, committed_at) of 40 commits."""
    e = read(spark, sf_dir, "events").where("event_id % 40 < 30")
    return e.groupBy(F.concat(F.lit("c"), F.col("event_id") % 40).alias("sha")).agg(F.min(seconds(F.col("ts"))).alias("committed_at"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").withColumn("at", seconds(F.col("ts")))
    return e.withColumn("line_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.lag("at").over(w))


STORE = """
e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS seen, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS line_id,
  lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lines AS (SELECT b.event_id AS line_id, md5(CAST(b.user_id AS VARCHAR)) AS file_path_hash, CASE WHEN b.event_id % 11 <> 0 THEN 'c' || (b.event_id % 40) END AS birth_commit,
  b.seen AS birth_ts, b.event_id % 13 <> 0 AS birth_observed, CASE WHEN b.value > 40 THEN 's' || (b.event_id % 7) END AS session_id,
  CASE b.event_id % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'call' ELSE 'comment' END AS syntactic_role, s.last_seen_at
  FROM e b JOIN (SELECT line_id, max(seen) AS last_seen_at FROM e WHERE line_id IS NOT NULL GROUP BY 1) s ON s.line_id = b.event_id WHERE b.event_type = 'signup'),
fates AS (SELECT event_id AS seq, line_id, seen AS observed_at, CASE WHEN event_id % 5 <> 0 THEN 'c' || (event_id % 40) END AS observed_commit, before AS previous_seen_at,
  CASE event_type WHEN 'error' THEN 'dead' WHEN 'click' THEN 'edited' ELSE 'moved' END AS state, CASE WHEN event_type = 'click' THEN value / 500 END AS birth_similarity,
  event_id % 7 = 0 AS before_first_commit, CASE event_id % 4 WHEN 0 THEN 'histogram_diff' WHEN 1 THEN 'within_hunk_alignment' WHEN 2 THEN 'no_match' ELSE 'intra_file_move' END AS deciding_layer
  FROM e WHERE line_id IS NOT NULL AND event_type IN ('error', 'click', 'purchase')),
commits AS (SELECT 'c' || (event_id % 40) AS sha, min(CAST(floor(epoch(ts)) AS BIGINT)) AS committed_at FROM events WHERE event_id % 40 < 30 GROUP BY 1),
el AS (SELECT l.*, greatest(coalesce(c.committed_at, l.birth_ts), l.birth_ts) AS entered_at FROM lines l LEFT JOIN commits c ON c.sha = l.birth_commit)"""


def history_sql(threshold: float | None = None) -> str:
    """CTEs h (lines with what their fates say), pop and life."""
    dies = "f.state = 'dead'" + (f" OR coalesce(f.birth_similarity < {threshold}, false)" if threshold is not None else "")
    return STORE + f""",
f2 AS (SELECT f.*, l.entered_at, l.birth_commit, CASE WHEN f.observed_commit IS NOT NULL THEN f.observed_commit IS DISTINCT FROM l.birth_commit ELSE NOT f.before_first_commit END AS counts FROM fates f JOIN el l USING (line_id)),
fa AS (SELECT line_id, bool_or(counts AND observed_at < entered_at - 3600) AS early, bool_or(state = 'dead') AS dead,
  bool_or(state = 'edited' AND coalesce(observed_commit = birth_commit, false)) AS revised_on_entry FROM f2 GROUP BY 1),
fd AS (SELECT line_id, previous_seen_at, observed_at, row_number() OVER (PARTITION BY line_id ORDER BY seq) AS k FROM f2 f WHERE counts AND ({dies})),
h AS (SELECT el.*, coalesce(fa.early, false) AS early, coalesce(fa.dead, false) AS dead, coalesce(fa.revised_on_entry, false) AS revised_on_entry, fd.previous_seen_at, fd.observed_at
  FROM el LEFT JOIN fa USING (line_id) LEFT JOIN (SELECT * FROM fd WHERE k = 1) fd USING (line_id)),
hb AS (SELECT *, early OR (NOT dead AND last_seen_at < entered_at - 3600) AS bad FROM h),
pop AS (SELECT *, CASE WHEN session_id IS NULL THEN 'human' WHEN revised_on_entry THEN 'agent_then_human_revised' ELSE 'agent' END AS entry_origin FROM hb WHERE birth_commit IS NOT NULL AND birth_observed AND NOT bad),
dd AS (SELECT *, (greatest(observed_at, entered_at) - entered_at) / 86400.0 AS r, (greatest(coalesce(previous_seen_at, entered_at), entered_at) - entered_at) / 86400.0 AS l0 FROM pop),
life AS (SELECT *, CASE WHEN observed_at IS NULL THEN (greatest(last_seen_at, entered_at) - entered_at) / 86400.0 WHEN least(l0, r) < r THEN least(l0, r) ELSE r - 0.001 / 86400.0 END AS "left",
  CASE WHEN observed_at IS NULL THEN CAST('inf' AS DOUBLE) ELSE r END AS "right" FROM dd)"""
