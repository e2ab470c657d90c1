"""Registered queries of the lineage and survival operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import GENERATED_PATH_PATTERNS, LANGUAGES, REPORT_AGES, SWEEP_THRESHOLDS
from ..functions import text
from ..operators import compare, correspond, grading, history, lineage, lines, report, store, survival, turnbull
from ..sources import lifetimes, snapshots
from ..streaming import record
from . import domain
from .domain import CHAIN, LINES, STORE, VERSIONS, history_sql, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = domain.versions(spark, sf_dir)
    return v.where("side = 'old'").drop("side"), v.where("side = 'new'").drop("side")


def _side_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old, new = _sides(spark, sf_dir)
    return lines.tracked_lines(old, "path", "content_id"), lines.tracked_lines(new, "path", "content_id")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new paths of equal content; of several, the least of each side."""
    old, new = _sides(spark, sf_dir)
    return old.groupBy("content_id").agg(F.min("path").alias("old_path")).join(new.groupBy("content_id").agg(F.min("path").alias("new_path")), "content_id")


PAIRS = ", p AS (SELECT o.content_id, o.path AS old_path, n.path AS new_path FROM (SELECT content_id, min(path) AS path FROM v WHERE side = 'old' GROUP BY 1) o JOIN (SELECT content_id, min(path) AS path FROM v WHERE side = 'new' GROUP BY 1) n USING (content_id))"


@query(f"WITH {LINES} SELECT path, side, number, fingerprint, content_tokens, CAST(len(tokens) AS INTEGER) AS n_tokens FROM l")
def tracked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = domain.versions(spark, sf_dir)
    return lines.tracked_lines(v, "path", "side").select("path", "side", "number", "fingerprint", "content_tokens", F.size("tokens").alias("n_tokens"))


@query(f"WITH {LINES} SELECT path, number, CAST(len(list_distinct(tokens)) AS INTEGER) AS unigrams, CAST(len(tokens) + 1 AS INTEGER) AS bigrams, md5(array_to_string(list_sort(list_distinct(tokens)), ' ')) AS unigram_digest FROM l")
def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lines.tracked_lines(domain.versions(spark, sf_dir), "path")
    return held.select("path", "number", F.size(F.array_distinct("tokens")).alias("unigrams"), F.size(text.bigrams(F.col("tokens"))).alias("bigrams"), F.md5(F.array_join(F.array_sort(F.array_distinct("tokens")), " ").cast("binary")).alias("unigram_digest"))


@query(f"WITH {LINES}{PAIRS}, k AS (SELECT p.old_path, p.new_path, count(*) AS verbatim FROM p JOIN l ON l.path = p.old_path GROUP BY 1, 2), s AS (SELECT side, path, count(*) AS n FROM l GROUP BY 1, 2) SELECT 'verbatim' AS fate, CAST(sum(verbatim) AS BIGINT) AS n, count(*) AS files FROM k UNION ALL SELECT CASE side WHEN 'old' THEN 'dead' ELSE 'born' END, CAST(sum(n) AS BIGINT), count(*) FROM s WHERE path NOT IN (SELECT old_path FROM p) AND path NOT IN (SELECT new_path FROM p) GROUP BY 1")
def verbatim_born_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a document set: lines kept word for word, born and dead."""
    old, new = _side_lines(spark, sf_dir)
    pairs = _pairs(spark, sf_dir)
    paired_old = old.join(pairs.select(F.col("old_path").alias("path"), "new_path"), "path").withColumnRenamed("path", "old_path")
    same = lines.unchanged(paired_old.select(F.col("old_path").alias("path"), F.col("new_path").alias("key"), "number", "fingerprint"), new.select("path", F.col("path").alias("key"), "number", "fingerprint"), "key")
    kept = same.groupBy("old_path").agg(F.count(F.lit(1)).alias("n")).agg(F.lit("verbatim").alias("fate"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"))

    def rest(side: DataFrame, column: str, fate: str) -> DataFrame:
        left = side.join(pairs.select(F.col(column).alias("path")), "path", "left_anti")
        return left.groupBy("path").agg(F.count(F.lit(1)).alias("n")).agg(F.lit(fate).alias("fate"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"))

    return kept.unionByName(rest(old, "old_path", "dead")).unionByName(rest(new, "new_path", "born"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verbatim_born_dead(spark, sf_dir)


TOKENS = CHAIN + r""", k AS (SELECT conv_id, ord, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]') AS t FROM c),
q AS (SELECT conv_id, ord, t, lag(t) OVER (PARTITION BY conv_id ORDER BY ord) AS b FROM k)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("ord")
    held = domain.chain(spark, sf_dir).select("conv_id", "ord", text.words(F.col("text")).alias("t"))
    return held.withColumn("b", F.lag("t").over(w)).where("b is not null")


@query(f"WITH {TOKENS} SELECT conv_id, ord, round(coalesce(len(list_intersect(list_distinct(t), list_distinct(b))) / nullif(len(list_distinct(list_concat(t, b))), 0), 0), 6) AS jaccard FROM q WHERE b IS NOT NULL")
def unigram_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "ord", F.round(text.jaccard(F.col("t"), F.col("b")), 6).alias("jaccard"))


@query(f"""WITH {TOKENS}, m AS (SELECT conv_id, ord, list_concat(list_concat([chr(1)], t), [chr(2)]) AS t, list_concat(list_concat([chr(1)], b), [chr(2)]) AS b FROM q WHERE b IS NOT NULL),
n AS (SELECT conv_id, ord, unnest(list_transform(range(1, len(t)), lambda i: t[i] || chr(3) || t[i + 1])) AS g FROM m), o AS (SELECT conv_id, ord, unnest(list_transform(range(1, len(b)), lambda i: b[i] || chr(3) || b[i + 1])) AS g FROM m),
s AS (SELECT conv_id, ord, sum(least(x, y)) AS shared FROM (SELECT conv_id, ord, g, count(*) AS x FROM n GROUP BY 1, 2, 3) JOIN (SELECT conv_id, ord, g, count(*) AS y FROM o GROUP BY 1, 2, 3) USING (conv_id, ord, g) GROUP BY 1, 2)
SELECT conv_id, ord, round(2 * coalesce(shared, 0) / (len(t) + len(b) - 2), 6) AS dice FROM m LEFT JOIN s USING (conv_id, ord)""")
def bigram_dice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of consecutive versions over multisets of bigrams, counted by joins so that long texts stay linear."""
    turns = _turns(spark, sf_dir)
    grams = lambda c: turns.select("conv_id", "ord", F.explode(text.bigrams(F.col(c))).alias("g")).groupBy("conv_id", "ord", "g").agg(F.count(F.lit(1)).alias(c))
    shared = grams("t").join(grams("b"), ["conv_id", "ord", "g"]).groupBy("conv_id", "ord").agg(F.sum(F.least("t", "b")).alias("shared"))
    total = F.size("t") + F.size("b") + 2
    return turns.join(shared, ["conv_id", "ord"], "left").select("conv_id", "ord", F.round(2 * F.coalesce("shared", F.lit(0)) / total, 6).alias("dice"))


def _path() -> F.Column:
    return F.concat(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), F.element_at(F.array(*[F.lit(x) for x in (".rs", ".py", ".min.js", "/vendor/a.ts", ".generated.js", ".txt", "/build/x.py", ".tsx")]), (F.col("page_id") % 8 + 1).cast("int")))


_ENDINGS = "CASE regexp_extract(path, '[^/]*\\.([^./]*)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items()) + " END"


@query(f"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || ['.rs', '.py', '.min.js', '/vendor/a.ts', '.generated.js', '.txt', '/build/x.py', '.tsx'][page_id % 8 + 1] AS path FROM pages)
SELECT page_id, path, {_ENDINGS} AS language, CASE WHEN NOT ({' OR '.join(f"regexp_matches(path, '{text.glob_regex(g)}')" for g in GENERATED_PATH_PATTERNS)}) THEN {_ENDINGS} END AS tracked FROM u""")
def tracked_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read(spark, sf_dir, "pages").select("page_id", _path().alias("path"))
    return held.select("page_id", "path", text.language(F.col("path")).alias("language"), text.tracked_language(F.col("path")).alias("tracked"))


@query("SELECT doc_id, sha1('blob ' || strlen(coalesce(text, '')) || chr(0) || coalesce(text, '')) AS blob_id FROM documents")
def git_blob_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.git_blob_id(F.coalesce("text", F.lit("")).cast("binary")).alias("blob_id"))


@query("SELECT page_id, regexp_replace(url, '^.*/', '') AS file_name, regexp_replace(url, '/?[^/]*$', '') AS parent FROM pages")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.file_name(F.col("url")).alias("file_name"), text.parent(F.col("url")).alias("parent"))


@query(f"WITH {VERSIONS} SELECT o.path AS old_path, n.path AS new_path FROM v o JOIN v n USING (content_id) WHERE o.side = 'old' AND n.side = 'new'")
def exact_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correspond.exact_renames(*_sides(spark, sf_dir))


@query(f"""WITH {LINES}, f AS (SELECT DISTINCT side, path, fingerprint FROM l WHERE content_tokens > 0), z AS (SELECT side, path, count(*) AS n FROM f GROUP BY 1, 2),
s AS (SELECT o.path AS old_path, n.path AS new_path, count(*) AS shared FROM f o JOIN f n USING (fingerprint) WHERE o.side = 'old' AND n.side = 'new' GROUP BY 1, 2)
SELECT old_path, new_path, shared, round(shared / (a.n + b.n - shared), 6) AS similarity FROM s JOIN z a ON a.path = old_path JOIN z b ON b.path = new_path WHERE 2 * shared >= a.n + b.n - shared""")
def similar_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (x.where("content_tokens > 0") for x in _side_lines(spark, sf_dir))
    return correspond.similar_renames(old, new).withColumn("similarity", F.round("similarity", 6))


@query()
def rename_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one renames within each language's documents."""
    old, new = (x.where("content_tokens > 0") for x in _side_lines(spark, sf_dir))
    found = correspond.similar_renames(old, new).withColumn("old_path", F.col("old_path").cast("string")).withColumn("new_path", F.col("new_path").cast("string"))
    return correspond.assign(found.withColumn("pair", F.lit(1)), "pair").select("old_path", "new_path", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {CHAIN}, o AS (SELECT * FROM c WHERE ord = 0), n AS (SELECT * FROM c WHERE ord = 1) SELECT conv_id, CASE WHEN o.ord IS NULL THEN 'added' WHEN n.ord IS NULL THEN 'deleted' WHEN o.content_id = n.content_id THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN n USING (conv_id)")
def deleted_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same-path pairing of the first two versions of each conversation's file."""
    c = domain.chain(spark, sf_dir).withColumn("path", F.col("conv_id"))
    return correspond.by_path(c.where("ord = 0"), c.where("ord = 1")).select(F.col("path").alias("conv_id"), "change")


@query(f"WITH {CHAIN}, z AS (SELECT max(ord) AS last FROM c), o AS (SELECT conv_id, ord + 1 AS ord, content_id FROM c, z WHERE ord < last), n AS (SELECT conv_id, ord, content_id FROM c WHERE ord > 0) SELECT conv_id, ord, CASE WHEN o.content_id IS NULL THEN 'added' WHEN n.content_id IS NULL THEN 'deleted' WHEN o.content_id = n.content_id THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN n USING (conv_id, ord)")
def deleted_added_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same-path pairing of every version of each conversation's file with the next, up to the last version of any."""
    c = domain.chain(spark, sf_dir).withColumn("path", F.col("conv_id"))
    last = c.agg(F.max("ord").alias("last"))
    old = c.crossJoin(F.broadcast(last)).where("ord < last").withColumn("ord", F.col("ord") + 1)  # one row
    return correspond.by_path(old, c.where("ord > 0"), "ord").select(F.col("path").alias("conv_id"), "ord", "change")


@query(f"WITH {LINES}{PAIRS} SELECT p.old_path, p.new_path, number FROM p JOIN l ON l.path = p.old_path")
def unchanged_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _side_lines(spark, sf_dir)
    pairs = _pairs(spark, sf_dir)
    left = old.join(pairs.select(F.col("old_path").alias("path"), F.col("new_path").alias("key")), "path").select("path", "key", "number", "fingerprint")
    return lines.unchanged(left, new.select("path", F.col("path").alias("key"), "number", "fingerprint"), "key").select("old_path", "new_path", "number")


@query(f"""WITH {LINES}, q AS (SELECT CAST(floor(path / 2) AS BIGINT) AS pair, side, fingerprint, number, content_tokens, count(*) OVER (PARTITION BY path, fingerprint) AS k FROM l)
SELECT o.pair, o.fingerprint, o.number AS old_number, n.number AS new_number FROM q o JOIN q n ON o.pair = n.pair AND o.fingerprint = n.fingerprint WHERE o.side = 'old' AND n.side = 'new' AND o.k = 1 AND n.k = 1 AND o.content_tokens >= 2 AND n.content_tokens >= 2""")
def unique_line_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (x.withColumn("pair", F.floor(F.col("path") / 2)) for x in _side_lines(spark, sf_dir))
    return lines.unique_moves(old, new, "pair")


@query(f"""WITH {LINES}, x AS (SELECT content_id, side, path, fingerprint, content_tokens, row_number() OVER (PARTITION BY path ORDER BY number) AS idx FROM l),
g AS (SELECT p.old_path, p.new_path FROM (SELECT path AS old_path, lead(path) OVER (ORDER BY path) AS new_path, side FROM v) p WHERE side = 'old' AND new_path IS NOT NULL),
o AS (SELECT old_path AS pair, idx AS o, fingerprint, content_tokens FROM g JOIN x ON x.path = old_path), n AS (SELECT old_path AS pair, idx AS n, fingerprint FROM g JOIN x ON x.path = new_path),
k AS (SELECT pair, fingerprint, count(*) AS partners FROM n GROUP BY 1, 2),
j AS (SELECT o.pair, o.o, n.n, o.o - n.n AS d, o.content_tokens, k.partners FROM o JOIN n USING (pair, fingerprint) JOIN k USING (pair, fingerprint)),
i AS (SELECT *, o - row_number() OVER (PARTITION BY pair, d ORDER BY o) AS island FROM j)
SELECT pair, min(o) AS old_start, min(n) AS new_start, count(*) AS n_lines, CAST(sum(content_tokens) AS BIGINT) AS tokens FROM i GROUP BY pair, d, island HAVING min(partners) <= 64 AND count(*) >= 3 AND sum(content_tokens) >= 8""")
def move_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal equal runs between each even document and the next one."""
    v = domain.versions(spark, sf_dir)
    held = lines.tracked_lines(v, "path", "side").withColumn("idx", F.row_number().over(Window.partitionBy("path").orderBy("number")))
    old = held.where("side = 'old'").withColumn("pair", F.col("path"))
    new = held.where("side = 'new'").withColumn("pair", F.col("path") - 1)
    return lines.move_blocks(old, new, "pair")


# store


@query(f"WITH {STORE} SELECT state, deciding_layer, count(*) AS n FROM fates GROUP BY 1, 2")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.fates(spark, sf_dir).groupBy("state", "deciding_layer").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {STORE} SELECT (SELECT count(*) FROM lines) AS n_lines, (SELECT count(*) FROM lines WHERE session_id IS NOT NULL) AS agent_lines, (SELECT count(*) FROM fates) AS n_fates, (SELECT count(*) FROM fates WHERE state = 'dead') AS dead, (SELECT count(*) FROM fates WHERE state = 'edited') AS edited, (SELECT count(*) FROM fates WHERE state = 'moved') AS moved, (SELECT count(*) FROM commits) AS n_commits, (SELECT count(DISTINCT session_id) FROM lines) AS n_sessions")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, f = domain.lines(spark, sf_dir), domain.fates(spark, sf_dir)
    a = held.agg(F.count(F.lit(1)).alias("n_lines"), F.count("session_id").alias("agent_lines"), F.countDistinct("session_id").alias("n_sessions"))
    b = f.agg(F.count(F.lit(1)).alias("n_fates"), F.count_if(F.col("state") == "dead").alias("dead"), F.count_if(F.col("state") == "edited").alias("edited"), F.count_if(F.col("state") == "moved").alias("moved"))
    c = domain.commits(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_commits"))
    return a.crossJoin(b).crossJoin(c)  # one row each


@query(f"WITH {STORE}, d AS (SELECT DISTINCT line_id FROM fates WHERE state = 'dead') SELECT file_path_hash, count(*) AS born, count(*) FILTER (WHERE line_id IN (SELECT line_id FROM d)) AS dead, count(*) FILTER (WHERE line_id NOT IN (SELECT line_id FROM d)) AS alive FROM lines GROUP BY 1")
def births_deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, dead = domain.lines(spark, sf_dir), domain.fates(spark, sf_dir).where("state = 'dead'").select("line_id").distinct()
    marked = held.join(dead.withColumn("gone", F.lit(True)), "line_id", "left")
    return marked.groupBy("file_path_hash").agg(F.count(F.lit(1)).alias("born"), F.count_if("gone").alias("dead"), F.count_if(F.col("gone").isNull()).alias("alive"))


@query(f"""WITH {STORE}, s AS (SELECT line_id, max(observed_at) AS seen FROM fates GROUP BY 1), k AS (SELECT f.line_id, max(observed_commit) AS commit FROM fates f JOIN s ON s.line_id = f.line_id AND s.seen = f.observed_at GROUP BY 1)
SELECT l.line_id, greatest(birth_ts, coalesce(seen, birth_ts)) AS last_seen_at, CASE WHEN seen >= birth_ts THEN coalesce(commit, birth_commit) ELSE birth_commit END AS last_seen_commit FROM lines l LEFT JOIN s USING (line_id) LEFT JOIN k USING (line_id)""")
def alive_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = domain.lines(spark, sf_dir).select("line_id", F.col("birth_ts").alias("last_seen_at"), F.col("birth_commit").alias("last_seen_commit"))
    seen = domain.fates(spark, sf_dir).select("line_id", F.col("observed_at").alias("at"), F.col("observed_commit").alias("commit"))
    return store.checkpoints(held, seen).select("line_id", "last_seen_at", "last_seen_commit")


SESSIONS = """, so AS (SELECT DISTINCT 's' || (user_id % 60) AS session_id, 'write' AS tool, CASE WHEN user_id % 60 < 20 THEN 'm' || (user_id % 60 % 3) END AS model, user_id % 60 AS started_at FROM events WHERE user_id % 60 < 40),
sn AS (SELECT DISTINCT 's' || (user_id % 60) AS session_id, 'edit' AS tool, CASE WHEN user_id % 60 % 2 = 0 THEN 'n' || (user_id % 60 % 5) END AS model, 100 + user_id % 60 AS started_at FROM events WHERE user_id % 60 >= 10)"""


def _sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("user_id") % 60
    e = read(spark, sf_dir, "events")
    old = e.where(k < 40).select(F.concat(F.lit("s"), k).alias("session_id"), F.lit("write").alias("tool"), F.when(k < 20, F.concat(F.lit("m"), k % 3)).alias("model"), k.alias("started_at")).distinct()
    new = e.where(k >= 10).select(F.concat(F.lit("s"), k).alias("session_id"), F.lit("edit").alias("tool"), F.when(k % 2 == 0, F.concat(F.lit("n"), k % 5)).alias("model"), (k + 100).alias("started_at")).distinct()
    return old, new


@query(f"WITH {STORE}{SESSIONS} SELECT coalesce(o.session_id, n.session_id) AS session_id, coalesce(o.tool, n.tool) AS tool, coalesce(n.model, o.model) AS model, coalesce(o.started_at, n.started_at) AS started_at FROM so o FULL JOIN sn n ON o.session_id = n.session_id")
def upsert_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert_sessions(*_sessions(spark, sf_dir))


@query(f"WITH {STORE}{SESSIONS} SELECT * FROM so UNION ALL SELECT * FROM sn WHERE session_id NOT IN (SELECT session_id FROM so)")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.insert_absent(*_sessions(spark, sf_dir), "session_id")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, CAST(1 AS INTEGER), CAST(0 AS DOUBLE) FROM orders WHERE o_orderkey % 5 = 0")
def replace_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the files that have a new snapshot are replaced."""
    old = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = read(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return store.replace_groups(old, new, "l_orderkey")


@query(f"WITH {STORE}, p AS (SELECT line_id FROM lines WHERE line_id % 2 = 0), s AS (SELECT line_id FROM lines WHERE line_id % 3 = 0) SELECT line_id FROM p WHERE line_id NOT IN (SELECT line_id FROM s)")
def unpark_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = domain.lines(spark, sf_dir).select("line_id")
    return store.unpark_present(held.where("line_id % 2 = 0"), held.where("line_id % 3 = 0"))


@query(f"WITH {STORE} SELECT line_id, CASE WHEN birth_commit IS NULL AND line_id % 2 = 0 THEN 'head' ELSE birth_commit END AS birth_commit, CASE WHEN birth_commit IS NULL AND line_id % 2 = 0 THEN line_id * 2 ELSE line_id END AS birth_first_bigram FROM lines")
def anchor_births(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = domain.lines(spark, sf_dir).withColumn("birth_bigrams", F.array("line_id"))
    snap = held.where("line_id % 2 = 0").select("line_id", F.array(F.col("line_id") * 2).alias("bigrams"), "file_path_hash", F.lit(1).alias("line_number"))
    return store.anchored(held, domain.fates(spark, sf_dir), snap, "head").select("line_id", "birth_commit", F.element_at("birth_bigrams", 1).alias("birth_first_bigram"))


@query(f"WITH {STORE} SELECT line_id, CASE WHEN session_id IS NULL THEN 'human' WHEN line_id IN (SELECT line_id FROM fates WHERE state = 'edited') THEN 'agent_then_human_revised' ELSE 'agent' END AS origin FROM lines")
def revised_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = domain.lines(spark, sf_dir).withColumn("origin", F.when(F.col("session_id").isNull(), "human").otherwise("agent"))
    return store.revised(held, domain.fates(spark, sf_dir)).select("line_id", "origin")


@query("""WITH s AS (SELECT o_orderkey AS f, o_custkey % 7 AS c FROM orders), h AS (SELECT DISTINCT o_orderkey AS f, o_custkey % 7 + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS c FROM orders WHERE o_orderkey % 3 <> 0),
d AS (SELECT o_orderkey AS f FROM orders WHERE o_orderkey % 2 = 0), p AS (SELECT o_orderkey AS f FROM orders WHERE o_orderkey % 5 = 0)
SELECT CAST(s.f AS VARCHAR) AS file_path_hash, CASE WHEN h.f IS NOT NULL THEN CASE WHEN s.c = h.c THEN 'left_alone' ELSE 'compare' END WHEN s.f IN (SELECT f FROM d) THEN 'ahead' WHEN s.f IN (SELECT f FROM p) THEN 'compare' ELSE 'no_evidence' END AS class FROM s LEFT JOIN h ON s.f = h.f""")
def reconcile_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("file_path_hash"), (F.col("o_custkey") % 7).alias("content_id"))
    head = o.where("k % 3 <> 0").withColumn("content_id", F.col("content_id") + F.when(F.col("k") % 11 == 0, 1).otherwise(0))
    return store.reconcile_classes(o, head, o.where("k % 2 = 0"), o.where("k % 5 = 0"))


# history


@query(f"WITH {CHAIN}, q AS (SELECT conv_id, ord, content_id AS sha, lag(content_id) OVER (PARTITION BY conv_id ORDER BY ord) AS previous FROM c) SELECT conv_id, ord, previous, sha FROM q WHERE previous IS NOT NULL")
def commit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.commit_pairs(domain.chain(spark, sf_dir).withColumnRenamed("content_id", "sha"), "conv_id")


@query(f"WITH {CHAIN} SELECT a.ord, count(*) AS files, CAST(sum(CASE WHEN a.content_id IS DISTINCT FROM b.content_id THEN a.size ELSE 0 END) AS BIGINT) AS changed_bytes FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND a.ord = b.ord + 1 GROUP BY 1")
def changed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.changed_work(domain.chain(spark, sf_dir).withColumnRenamed("conv_id", "path"))


ORDERS = "o AS (SELECT o_custkey, o_orderkey, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS committed_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord FROM orders)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select("o_custkey", "o_orderkey", domain.seconds(F.col("o_orderdate")).alias("committed_at"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long").alias("ord"))


@query(f"""WITH {ORDERS}, f AS (SELECT o_custkey, min(CASE WHEN committed_at >= 883612800 THEN ord END) AS first FROM o GROUP BY 1)
SELECT o_custkey, CASE WHEN first <= 1 THEN 0 ELSE first - 1 END AS "start", first > 1 AS baseline FROM f""")
def since_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.since_window(_orders(spark, sf_dir), "o_custkey", day=text.parse_day(F.lit("1998-01-01")))


@query("""WITH t AS (SELECT conv_id, role AS path, turn AS ord, md5(coalesce(text, '')) AS content_id, length(coalesce(text, '')) % 3 <> 0 AS parsed FROM conversations),
i AS (SELECT *, ord - row_number() OVER (PARTITION BY conv_id, path ORDER BY ord) AS island FROM t)
SELECT conv_id, path, ord, last_value(CASE WHEN parsed THEN content_id END IGNORE NULLS) OVER (PARTITION BY conv_id, path, island ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS effective_content FROM i""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = domain.chain(spark, sf_dir).select("conv_id", F.col("role").alias("path"), "ord", "content_id", (F.col("size") % 3 != 0).alias("parsed"))
    return history.carry_forward(c, "conv_id").select("conv_id", "path", "ord", "effective_content")


@query()
def monotone_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.monotone_clock(_orders(spark, sf_dir), "o_custkey")


# survival


def _held(spark: SparkSession, sf_dir: str, threshold: float | None = None) -> DataFrame:
    return survival.histories(survival.with_entry(domain.lines(spark, sf_dir), domain.commits(spark, sf_dir)), domain.fates(spark, sf_dir), threshold)


def _observed(spark: SparkSession, sf_dir: str, threshold: float | None = None) -> DataFrame:
    return survival.lifetimes(survival.population(_held(spark, sf_dir, threshold)))


@query(f"WITH {STORE} SELECT line_id, entered_at FROM el")
def entry_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.with_entry(domain.lines(spark, sf_dir), domain.commits(spark, sf_dir)).select("line_id", "entered_at")


@query(f"WITH {history_sql()} SELECT count(*) FILTER (WHERE birth_commit IS NOT NULL AND birth_observed AND NOT bad) AS n_lines, count(*) FILTER (WHERE session_id IS NOT NULL) AS agent_written, count(*) FILTER (WHERE session_id IS NOT NULL AND birth_commit IS NULL AND dead) AS agent_deleted_uncommitted, count(*) FILTER (WHERE session_id IS NOT NULL AND birth_commit IS NULL AND NOT dead) AS agent_pending, count(*) FILTER (WHERE birth_commit IS NOT NULL AND NOT birth_observed) AS already_there, count(*) FILTER (WHERE birth_commit IS NOT NULL AND birth_observed AND bad) AS inconsistent FROM hb")
def left_out_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.left_out(_held(spark, sf_dir))


@query(f"WITH {history_sql()} SELECT line_id, entry_origin FROM pop")
def origin_at_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.population(_held(spark, sf_dir)).select("line_id", "entry_origin")


@query(f'WITH {history_sql()} SELECT line_id, round("left", 6) AS "left", CASE WHEN isinf("right") THEN -1.0 ELSE round("right", 6) END AS "right" FROM life')
def lifetimes_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observed(spark, sf_dir).select("line_id", F.round("left", 6).alias("left"), F.when(F.col("right") == float("inf"), -1.0).otherwise(F.round("right", 6)).alias("right"))


@query(f'WITH {history_sql(0.5)} SELECT line_id, round("left", 6) AS "left", CASE WHEN isinf("right") THEN -1.0 ELSE round("right", 6) END AS "right" FROM life')
def lifetimes_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observed(spark, sf_dir, 0.5).select("line_id", F.round("left", 6).alias("left"), F.when(F.col("right") == float("inf"), -1.0).otherwise(F.round("right", 6)).alias("right"))


@query(f'WITH {history_sql()} SELECT entry_origin, round("left", 6) AS "left", CASE WHEN isinf("right") THEN -1.0 ELSE round("right", 6) END AS "right", CAST(count(*) AS DOUBLE) AS weight FROM life GROUP BY entry_origin, life."left", life."right"')
def grouped_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = survival.grouped(_observed(spark, sf_dir), "entry_origin")
    return g.select("entry_origin", F.round("left", 6).alias("left"), F.when(F.col("right") == float("inf"), -1.0).otherwise(F.round("right", 6)).alias("right"), "weight")


@query(f"""WITH {history_sql()}, g AS (SELECT entry_origin, count(*) AS n, count(*) FILTER (WHERE NOT isinf("right")) AS deaths, greatest(max(CASE WHEN isinf("right") THEN "left" ELSE "right" END), 0.0) AS fu, greatest(max("left"), 0.0) AS ku FROM life GROUP BY 1),
t AS (SELECT entry_origin, "left", row_number() OVER (PARTITION BY entry_origin ORDER BY "left" DESC) AS k FROM life)
SELECT g.entry_origin, n, deaths, round(fu, 6) AS follow_up, round(ku, 6) AS known_until, round(coalesce(greatest(least(t."left", fu), 0.0), 0.0), 6) AS drawable FROM g LEFT JOIN t ON t.entry_origin = g.entry_origin AND t.k = 10""")
def follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = survival.follow_up(_observed(spark, sf_dir), "entry_origin")
    return out.select("entry_origin", "n", "deaths", *[F.round(c, 6).alias(c) for c in ("follow_up", "known_until", "drawable")])


@query(f'WITH {history_sql()} SELECT entry_origin, age, count(*) FILTER (WHERE "left" >= age) AS n FROM life, (VALUES (1.0::DOUBLE), (7.0), (30.0), (90.0)) AS a(age) GROUP BY 1, 2')
def known_alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.known_alive(_observed(spark, sf_dir), [1.0, 7.0, 30.0, 90.0], "entry_origin")


@query(f"""WITH {history_sql()}, s AS (SELECT file_path_hash AS key, count(*) AS n FROM pop GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, key) AS rank, count(*) OVER () AS total FROM s)
SELECT key, n, CASE WHEN total > 8 AND rank > 7 THEN 'other' ELSE key END AS "group" FROM r""")
def report_groups_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.top_groups(survival.population(_held(spark, sf_dir)), F.col("file_path_hash"))


@query(f"""WITH {history_sql()}, d AS (SELECT DISTINCT entry_origin, "left" AS v, 0 AS is_right FROM life UNION SELECT DISTINCT entry_origin, "right", 1 FROM life),
m AS (SELECT *, lag(v) OVER w AS before, lag(is_right) OVER w AS was FROM d WINDOW w AS (PARTITION BY entry_origin ORDER BY v, is_right DESC))
SELECT entry_origin, round(before, 6) AS "start", CASE WHEN isinf(v) THEN -1.0 ELSE round(v, 6) END AS "end" FROM m WHERE is_right = 1 AND was = 0""")
def innermost_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = survival.innermost_intervals(_observed(spark, sf_dir), "entry_origin")
    return out.select("entry_origin", F.round("start", 6).alias("start"), F.when(F.col("end") == float("inf"), -1.0).otherwise(F.round("end", 6)).alias("end"))


KM = history_sql() + """, tt AS (SELECT entry_origin, floor(CASE WHEN isinf("right") THEN "left" ELSE "right" END) AS t, NOT isinf("right") AS died FROM life),
tc AS (SELECT entry_origin, t, count(*) AS n, count(*) FILTER (WHERE died) AS deaths FROM tt GROUP BY 1, 2),
tr AS (SELECT *, CAST(sum(n) OVER (PARTITION BY entry_origin ORDER BY t DESC) AS BIGINT) AS at_risk FROM tc),
km AS (SELECT entry_origin, t, at_risk, deaths, CASE WHEN max(CASE WHEN deaths = at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN deaths < at_risk THEN ln(1 - deaths / at_risk) ELSE 0 END) OVER w) END AS survival
  FROM tr WHERE deaths > 0 WINDOW w AS (PARTITION BY entry_origin ORDER BY t))"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifetimes as whole days of exact deaths."""
    o = _observed(spark, sf_dir)
    return o.withColumn("left", F.when(F.col("right") == float("inf"), F.floor("left")).otherwise(F.floor("right")).cast("double")).withColumn("right", F.when(F.col("right") == float("inf"), F.col("right")).otherwise(F.col("left")))


@query(f"WITH {KM} SELECT entry_origin, t, at_risk, deaths, round(survival, 6) AS survival FROM km")
def kaplan_meier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.kaplan_meier(_daily(spark, sf_dir), "entry_origin").withColumn("survival", F.round("survival", 6))


@query(f"WITH {KM} SELECT entry_origin, min(CASE WHEN survival <= 0.5 THEN t END) AS median FROM km GROUP BY 1")
def km_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.km_median(survival.kaplan_meier(_daily(spark, sf_dir), "entry_origin"), "entry_origin")


@query(f"WITH {KM} SELECT entry_origin, t, round(survival, 4) AS survival FROM km")
def turnbull_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On exact deaths the interval estimator is the product-limit one."""
    o = _daily(spark, sf_dir)
    exact = o.withColumn("left", F.when(F.col("right") == float("inf"), F.col("left")).otherwise(F.col("right") - 1e-6))
    masses = turnbull.estimates(exact, "entry_origin")
    times = o.where(F.col("right") < float("inf")).select("entry_origin", F.col("right").alias("t")).distinct()
    held = masses.join(times, "entry_origin")
    beyond = F.when((F.col("end") == float("inf")) | (F.col("t") < F.col("end")), F.col("mass")).otherwise(0.0)
    return held.groupBy("entry_origin", "t").agg(F.round(F.sum(beyond), 4).alias("survival"))


@query()
def turnbull_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = turnbull.survival_at(turnbull.estimates(_observed(spark, sf_dir), "entry_origin"), [1.0, 7.0, 14.0, 21.0], "entry_origin")
    return out.withColumn("survival", F.round("survival", 6))


@query()
def bootstrap_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _observed(spark, sf_dir).withColumn("cluster", F.concat_ws("/", "birth_commit", "file_path_hash"))
    _, resamples, seed = report.checked()
    found = turnbull.replicates(o, "entry_origin", "cluster", "line_id", lambda e: [*[e.survival(a) for a in REPORT_AGES], e.median()], len(REPORT_AGES) + 1, resamples, seed)
    return turnbull.bands(found, "entry_origin", resamples)


@query()
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = survival.swept(survival.with_entry(domain.lines(spark, sf_dir), domain.commits(spark, sf_dir)), domain.fates(spark, sf_dir), SWEEP_THRESHOLDS)
    masses = turnbull.estimates(survival.lifetimes(survival.population(held)), "threshold", "entry_origin")
    return turnbull.survival_at(masses, [7.0], "threshold", "entry_origin").select("entry_origin", "age", "survival", "threshold")


@query(f"""WITH {STORE}, a AS (SELECT line_id, bool_or(state = 'edited') AS edited, bool_or(state = 'dead') AS deleted FROM fates GROUP BY 1)
SELECT session_id, count(*) AS written, count(*) FILTER (WHERE NOT coalesce(deleted, false)) AS alive, count(birth_commit) AS committed, count(*) FILTER (WHERE edited) AS edited, count(*) FILTER (WHERE deleted) AS deleted,
 count(*) FILTER (WHERE NOT coalesce(deleted, false)) / count(*) AS alive_share, count(*) FILTER (WHERE edited) / count(*) AS edited_share FROM lines LEFT JOIN a USING (line_id) WHERE session_id IS NOT NULL GROUP BY 1""")
def session_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, f = domain.lines(spark, sf_dir), domain.fates(spark, sf_dir)
    alive = held.select("line_id").join(f.where("state = 'dead'").select("line_id").distinct(), "line_id", "left_anti")
    return store.session_status(held, f, alive)


# grading: events as expected fates, the same with some changed as decisions

GRADE = STORE + """,
ex AS (SELECT seq, state, file_path_hash AS path, seq % 50 AS line, deciding_layer FROM fates JOIN lines USING (line_id)),
ac AS (SELECT seq, CASE WHEN seq % 17 = 0 THEN 'verbatim' ELSE state END AS state, path, CASE WHEN seq % 19 = 0 THEN line + 1 ELSE line END AS line, deciding_layer FROM ex WHERE seq % 23 <> 0),
gr AS (SELECT ex.seq, ex.state, ac.state AS actual, ac.deciding_layer, CASE WHEN ac.state IS NULL THEN 'missing' WHEN ex.state <> ac.state THEN 'wrong_state' WHEN ex.state <> 'dead' AND ex.line <> ac.line THEN 'misplaced' ELSE 'correct' END AS verdict FROM ex LEFT JOIN ac USING (seq))"""


def _graded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ex = domain.fates(spark, sf_dir).join(domain.lines(spark, sf_dir).select("line_id", F.col("file_path_hash").alias("path")), "line_id").select("seq", "state", "path", (F.col("seq") % 50).alias("line"), "deciding_layer")
    ac = ex.where("seq % 23 <> 0").withColumn("state", F.when(F.col("seq") % 17 == 0, "verbatim").otherwise(F.col("state"))).withColumn("line", F.when(F.col("seq") % 19 == 0, F.col("line") + 1).otherwise(F.col("line")))
    return grading.judged(ex.drop("deciding_layer"), ac, "seq"), ac


@query(f"WITH {GRADE} SELECT state AS expected, CASE WHEN verdict IN ('missing', 'misplaced') THEN verdict ELSE actual END AS actual, count(*) AS n FROM gr GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.confusion(_graded(spark, sf_dir)[0])


@query(f"""WITH {GRADE}, w AS (SELECT state, count(*) FILTER (WHERE verdict = 'correct') AS "right", count(*) AS expected FROM gr GROUP BY 1), s AS (SELECT actual AS state, count(*) AS predicted FROM gr WHERE actual IS NOT NULL GROUP BY 1)
SELECT state, coalesce("right", 0) AS "right", coalesce(expected, 0) AS expected, coalesce(predicted, 0) AS predicted, coalesce("right", 0) / nullif(predicted, 0) AS precision, "right" / nullif(expected, 0) AS recall FROM w FULL JOIN s USING (state)""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.precision_recall(_graded(spark, sf_dir)[0])


@query(f"WITH {GRADE} SELECT path, line, count(*) AS claimants FROM ac GROUP BY 1, 2 HAVING count(*) > 1")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.conflicts(_graded(spark, sf_dir)[1], "path", "line")


@query(f"WITH {GRADE} SELECT deciding_layer, count(*) AS n FROM gr WHERE verdict <> 'correct' GROUP BY 1")
def errors_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.errors_by_layer(_graded(spark, sf_dir)[0])


# lineage over versions


def _chain_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as repositories of one file each, turns as versions, as plain text."""
    c = domain.chain(spark, sf_dir)
    tree = c.select(F.col("conv_id").alias("repo"), "ord", F.lit("file").alias("path"), "content_id")
    return snapshots.plain_lines(tree, c.groupBy("content_id").agg(F.min("text").alias("content")))


@query()
def file_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions between consecutive versions of every conversation's file."""
    out = compare.decisions(_chain_tree(spark, sf_dir))
    return out.groupBy("state", "layer").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("similarity"), 6).alias("similarity"))


@query()
def traced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many versions each line lives through."""
    folder = lineage.work_folder(spark)
    tree = lineage._written(_chain_tree(spark, sf_dir), folder)
    decided = lineage._written(compare.decisions(tree), folder)
    ids = lineage.identities(tree, decided, folder=folder)
    lived = ids.groupBy("repo", "birth_ord", "birth_path", "birth_line").agg(F.count(F.lit(1)).alias("versions"))
    return lived.groupBy("versions").agg(F.count(F.lit(1)).alias("n_lines"))


@query()
def recorded_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as write events on one Python file for each conversation."""
    c = read(spark, sf_dir, "conversations")
    e = c.select(F.concat(F.lit("s"), F.col("conv_id") % 5).alias("session_id"), F.lit(None).cast("string").alias("model"), F.lit("Write").alias("tool_name"), F.concat(F.lit("src/f"), "conv_id", F.lit(".py")).alias("path"), F.coalesce("text", F.lit("")).alias("content"), F.lit(None).cast("string").alias("committed"), F.col("turn").alias("at"), F.col("turn").alias("seq"))
    return record.replay(e).groupBy("kind", "state", "layer", "origin").agg(F.count(F.lit(1)).alias("n"))


# cells and names


@query(r"""WITH u AS (SELECT page_id, url, url || ':' || (page_id % 4) AS spot, 'q=a+b%2&&a=%41' || page_id || '&x&a=%C3%A9%zz+' || page_id AS query FROM pages)
SELECT page_id, left(md5(url), 8) AS short, CASE WHEN page_id % 3 = 1 THEN 'page' ELSE 'pages' END AS noun, CASE WHEN length(url) <= 30 THEN url ELSE '…' || right(url, 29) END AS shown, regexp_replace(url, '[^A-Za-z0-9]', '_', 'g') AS note,
  CASE WHEN page_id % 4 > 0 THEN url END AS target_path, CASE WHEN page_id % 4 > 0 THEN CAST(page_id % 4 AS BIGINT) END AS target_line, 'a b%2' AS q, 'é%zz ' || page_id AS a, '' AS x, CAST(NULL AS VARCHAR) AS y FROM u""")
def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short ids, nouns, cut paths, note names, targets and parameters of every page's address."""
    n = F.col("page_id").cast("string")
    u = read(spark, sf_dir, "pages").select("page_id", "url", text.target(F.concat("url", F.lit(":"), F.col("page_id") % 4)).alias("t"), F.concat(F.lit("q=a+b%2&&a=%41"), n, F.lit("&x&a=%C3%A9%zz+"), n).alias("query"))
    return u.select(
        "page_id",
        text.short_id(F.md5(F.col("url").cast("binary"))).alias("short"),
        text.plural(F.col("page_id") % 3, "page", "pages").alias("noun"),
        text.truncate_left(F.col("url"), 30).alias("shown"),
        text.note_name(F.col("url")).alias("note"),
        F.col("t.path").alias("target_path"),
        F.col("t.line").alias("target_line"),
        *[text.query_value(F.col("query"), name).alias(name) for name in ("q", "a", "x", "y")],
    )


@query("""WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seen, (event_id * 97) % 400000 AS age, CASE WHEN event_id % 9 = 0 THEN '2023-02-30' WHEN event_id % 9 = 1 THEN '2023-2-3' ELSE strftime(ts, '%Y-%m-%d') END AS day,
  event_id % 4000 / 7.0::DOUBLE AS days, event_id % 1000 / 1000.0::DOUBLE AS point, CASE WHEN event_id % 5 > 0 THEN event_id % 1000 / 2000.0::DOUBLE END AS low, CASE WHEN event_id % 5 > 1 THEN event_id % 1000 / 1000.0::DOUBLE + 1 END AS high FROM events),
c AS (SELECT *, CASE WHEN event_id % 6 = 0 THEN 'not reached' ELSE printf(CASE WHEN days < 10 THEN '%.1f days' ELSE '%.0f days' END, days) END AS middle, printf('%.1f days', days / 100) AS early, printf(CASE WHEN days * 2 < 10 THEN '%.1f days' ELSE '%.0f days' END, days * 2) AS late FROM e)
SELECT event_id, strftime(make_timestamp(seen * 1000000), '%Y-%m-%d %H:%M UTC') AS clock, CASE WHEN event_id % 9 > 1 THEN seen - seen % 86400 END AS midnight,
  CASE WHEN age < 90 THEN 'moments ago' WHEN age < 5400 THEN (age // 60) || ' minutes ago' WHEN age < 129600 THEN (age // 3600) || ' hours ago' ELSE (age // 86400) || ' days ago' END AS ago,
  CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN printf('%.3f (%.3f-%.3f)', point, point, high) ELSE printf('%.3f', point) END AS survival,
  CASE WHEN low IS NULL THEN middle WHEN high IS NULL THEN middle || ' (at least ' || early || ')' ELSE middle || ' (' || early || '-' || late || ')' END AS median FROM c""")
def clock_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock texts, days, ages and the cells of a report for every event."""
    k, at = F.col("event_id"), domain.seconds(F.col("ts"))
    day = F.when(k % 9 == 0, "2023-02-30").when(k % 9 == 1, "2023-2-3").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    days, point = k % 4000 / F.lit(7.0), k % 1000 / F.lit(1000.0)
    low = lambda c: F.when(k % 5 > 0, c)
    high = lambda c: F.when(k % 5 > 1, c)
    return read(spark, sf_dir, "events").select(
        "event_id",
        text.clock_text(at).alias("clock"),
        text.parse_day(day).alias("midnight"),
        text.ago(k * 97 % 400_000).alias("ago"),
        text.survival_cell(point, low(point), high(point + 1)).alias("survival"),
        text.median_cell(F.when(k % 6 != 0, days), low(days / 100), high(days * 2)).alias("median"),
    )


_TRAILERS = ("Co-authored-by: Tool One <one@agents.example>", "  CO-AUTHORED-BY: A Person <p@people.example>", ">> Generated with a tool", "co-authored-by: Two <two@AGENTS.example>\nGenerated with a tool", "Generated by hand")


@query(f"""WITH {CHAIN}, m AS (SELECT conv_id, ord, ' ' || regexp_replace(left(text, 60), '[\r\n]', '.', 'g') || ' ' || chr(10) || chr(10) || list_extract([{', '.join("'" + x.replace(chr(10), "' || chr(10) || '") + "'" for x in _TRAILERS)}], CAST(ord % 5 AS INTEGER) + 1) AS message FROM c),
l AS (SELECT *, list_transform(string_split(message, chr(10)), lambda x: trim(x)) AS held FROM m),
v AS (SELECT *, list_filter(held, lambda x: starts_with(lower(x), 'co-authored-by:') AND ends_with(lower(x), '@agents.example>')) AS named, len(list_filter(held, lambda x: regexp_matches(lower(x), '^[^\\p{{L}}\\p{{N}}]*generated with'))) > 0 AS footed FROM l)
SELECT conv_id, ord, trim(string_split(message, chr(10))[1]) AS subject, CASE WHEN len(named) > 0 THEN trim(substr(named[1], 16)) WHEN footed THEN 'a tool' END AS trailer FROM v""")
def commit_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects and agents' trailers of messages made from every turn."""
    c = domain.chain(spark, sf_dir)
    ending = F.element_at(F.array(*[F.lit(x) for x in _TRAILERS]), (F.col("ord") % 5 + 1).cast("int"))
    message = F.concat(F.lit(" "), F.regexp_replace(F.left("text", F.lit(60)), r"[\r\n]", "."), F.lit(" \n\n"), ending)
    return c.select("conv_id", "ord", text.subject(message).alias("subject"), text.agent_trailer(message, "@agents.example>", ("generated with",), "a tool").alias("trailer"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 100 = 0 THEN repeat(coalesce(text, ''), 1000) ELSE coalesce(text, '') END AS content FROM documents)
SELECT doc_id, strlen(content) <= 1048576 AS tracked, CASE WHEN doc_id % 3 = 1 THEN md5(content) || 'abcdef01' END AS known FROM d""")
def tracked_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents small enough to be tracked, and their ids if those are known."""
    held = F.coalesce("text", F.lit(""))
    content = F.when(F.col("doc_id") % 100 == 0, F.repeat(held, 1000)).otherwise(held)
    asked = F.when(F.col("doc_id") % 3 == 0, "0" * 40).when(F.col("doc_id") % 3 == 1, F.concat(F.md5(content.cast("binary")), F.lit("abcdef01")))
    return read(spark, sf_dir, "documents").select("doc_id", text.tracked_source(content.cast("binary")).alias("tracked"), text.known_id(asked).alias("known"))


# what the store says of itself


@query(f"""WITH {STORE}{SESSIONS} SELECT true AS stamped, (SELECT count(*) FROM so) AS sessions, (SELECT count(*) FROM fates WHERE observed_commit IS NULL) AS write_fates, (SELECT count(*) FROM commits WHERE committed_at % 2 = 0) AS reconciled_commits, true AS has_commits""")
def capture_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What live capture has recorded."""
    meta = store.stamp_capture(store.stamp_capture(spark.createDataFrame([], "key string, value string"), 5), 9)
    c = domain.commits(spark, sf_dir).withColumn("observed_by", F.when(F.col("committed_at") % 2 == 0, "reconcile").otherwise("backfill"))
    return store.captured(meta, _sessions(spark, sf_dir)[0], domain.fates(spark, sf_dir), c)


@query("""WITH o AS (SELECT 'k' || c_custkey AS key, c_name AS value FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT 'k' || c_custkey AS key, CAST(c_nationkey AS VARCHAR) AS value FROM customer WHERE c_custkey % 3 = 0)
SELECT * FROM o WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT * FROM n WHERE key <> 'k12'""")
def meta_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys set over others, and one removed."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("k"), "c_custkey").alias("key"), "c_name", F.col("c_nationkey").cast("string").alias("value"))
    old, new = c.where("c_custkey % 2 = 0").select("key", F.col("c_name").alias("value")), c.where("c_custkey % 3 = 0")
    return store.forget(store.set_meta(old, new), spark.createDataFrame([("k12",)], "key string"), "key")


@query(f"""WITH {STORE}, s AS (SELECT DISTINCT session_id, CAST(substr(session_id, 2) AS INTEGER) % 3 AS started_at FROM lines WHERE session_id IS NOT NULL)
SELECT line_id, session_id FROM lines WHERE session_id = (SELECT session_id FROM s ORDER BY started_at DESC, CAST(substr(session_id, 2) AS INTEGER) DESC LIMIT 1)""")
def latest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the session that began last."""
    held = domain.lines(spark, sf_dir)
    number = F.substring("session_id", 2, 9).cast("int")
    sessions = held.where("session_id is not null").select("session_id", (number % 3).alias("started_at"), number.alias("seq")).distinct()
    return store.session_lines(sessions, held).select("line_id", "session_id")


@query(f"WITH {STORE} SELECT state, count(*) AS n FROM fates GROUP BY 1 UNION ALL SELECT 'born', count(*) FROM lines")
def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a reconciliation."""
    return store.delta_counts(domain.lines(spark, sf_dir), domain.fates(spark, sf_dir))


@query(f"""WITH {STORE}, n AS (SELECT md5(CAST(user_id AS VARCHAR)) AS h, min(CASE WHEN user_id % 3 = 0 THEN 'a/' ELSE 'b/' END || user_id) AS path FROM events WHERE user_id % 3 = 0 OR user_id % 4 = 0 GROUP BY 1)
SELECT line_id, coalesce(path, 'a file no longer present (path hash ' || file_path_hash || ')') AS name FROM lines LEFT JOIN n ON h = file_path_hash""")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of files from the tree, else from history, else none."""
    user = read(spark, sf_dir, "events").select("user_id", F.md5(F.col("user_id").cast("string").cast("binary")).alias("file_path_hash")).distinct()
    tree = user.where("user_id % 3 = 0").withColumn("path", F.concat(F.lit("a/"), "user_id"))
    past = user.where("user_id % 4 = 0").withColumn("path", F.concat(F.lit("b/"), "user_id"))
    return store.named(domain.lines(spark, sf_dir), tree, past).select("line_id", "name")


@query("""SELECT DISTINCT o_custkey AS k, 'missing' AS side FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 > 0) UNION ALL SELECT c_custkey, 'unknown' FROM customer WHERE c_custkey % 4 > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def unmatched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that only one of two lists has."""
    return store.unmatched(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), read(spark, sf_dir, "customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("k")), "k")


@query(f"WITH {STORE} SELECT line_id FROM lines WHERE line_id NOT IN (SELECT line_id FROM fates WHERE state = 'moved') AND line_id NOT IN (SELECT line_id FROM fates WHERE state = 'dead')")
def unaccounted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are neither carried forward nor dead."""
    f = domain.fates(spark, sf_dir)
    return store.unaccounted(domain.lines(spark, sf_dir), f.where("state = 'moved'"), f.where("state = 'dead'"), "line_id")


@query(f"WITH {STORE} SELECT line_id FROM lines WHERE birth_commit IS NOT NULL AND CAST(substr(birth_commit, 2) AS INTEGER) > 24")
def resumed_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the commits that a backfill still has to record."""
    held = domain.lines(spark, sf_dir).where("birth_commit is not null")
    commits = held.select(F.col("birth_commit").alias("sha"), F.substring("birth_commit", 2, 9).cast("int").alias("ord")).distinct()
    left = history.resumed(commits, commits.where("ord in (3, 24)"))
    return held.join(left, F.col("birth_commit") == F.col("sha"), "left_semi").select("line_id")


@query(f"WITH {history_sql()} SELECT bool_or(entry_origin = 'agent') AND bool_or(entry_origin = 'human') AS confounded FROM pop")
def confounded_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a report by origin compares agents with people."""
    return survival.confounded(survival.population(_held(spark, sf_dir)), "entry_origin")


@query("""SELECT 'customer' AS "table", count(*) AS n, count(DISTINCT c_custkey) AS keys FROM customer UNION ALL SELECT 'nation', count(*), count(DISTINCT n_nationkey) FROM nation""")
def table_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table as JSON, counted by what they say."""
    rows = store.audit({name: read(spark, sf_dir, name) for name in ("nation", "customer")})
    return rows.groupBy("table").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce(F.get_json_object("row", "$.c_custkey"), F.get_json_object("row", "$.n_nationkey"))).alias("keys"))


@query("""SELECT event_id % 50 / 4.0::DOUBLE AS "left", CASE WHEN event_id % 3 = 0 THEN -1.0 ELSE event_id % 50 / 4.0::DOUBLE + 1 END AS "right", count(*) AS n FROM events GROUP BY 1, 2""")
def lifetime_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifetimes read from lines of text, with blank ones between."""
    left = F.col("event_id") % 50 / F.lit(4.0)
    line = F.concat(F.lit(" "), left.cast("string"), F.lit("\t "), F.when(F.col("event_id") % 3 == 0, "inf").otherwise((left + 1).cast("string")))
    lines_ = read(spark, sf_dir, "events").select(F.explode(F.array(line, F.lit(" "))).alias("value"))
    found = lifetimes.parse(lines_)
    return found.groupBy("left", F.when(F.col("right") == float("inf"), -1.0).otherwise(F.col("right")).alias("right")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT l_orderkey % 7 AS ord, 'f' || (l_partkey % 11) AS path, l_orderkey, l_linenumber FROM lineitem)
SELECT l_orderkey, l_linenumber, 100 + row_number() OVER (ORDER BY ord, path, l_orderkey, l_linenumber) AS line_id FROM b""")
def birth_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of lines in the order of their birth."""
    b = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 7).alias("ord"), F.concat(F.lit("f"), F.col("l_partkey") % 11).alias("path"), "l_orderkey", "l_linenumber", F.struct("l_orderkey", "l_linenumber").alias("line"))
    return store.numbered(b, 100).select("l_orderkey", "l_linenumber", "line_id")
