"""Changes to store tables as DataFrames: a table and its delta give the table's next version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_absent(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows whose key the table has stay as they are; of new rows with one key, the least is taken."""
    fresh = new.join(old.select(*key), list(key), "left_anti").select(*old.columns)
    w = Window.partitionBy(*key).orderBy(*[c for c in old.columns if c not in key])
    return old.unionByName(fresh.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k"))


def upsert_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """A known session keeps all but its model, which a new one that isn't null replaces."""
    n = new.select("session_id", *[F.col(c).alias(f"__{c}") for c in ("tool", "model", "started_at")], F.lit(True).alias("__new"))
    o = old.withColumn("__old", F.lit(True))
    joined = o.join(n, "session_id", "full_outer")
    keep = lambda c: F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c)
    return joined.select("session_id", keep("tool"), F.coalesce("__model", "model").alias("model"), keep("started_at"))


def replace_groups(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """All rows of the keys that ``new`` has are replaced by its rows."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def forget(old: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    return old.join(keys.select(*key).distinct(), list(key), "left_anti")


def park(parked: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines set aside replace what was parked under their ids."""
    return replace_groups(parked, lines.select(*parked.columns), "line_id")


def unpark_present(parked: DataFrame, snapshot_lines: DataFrame) -> DataFrame:
    return forget(parked, snapshot_lines, "line_id")


def returning(parked: DataFrame, born: DataFrame) -> DataFrame:
    """(line_id, line_number): born lines that a parked one of the same file and fingerprint takes, in line order.

    Only lines with more than two content tokens are taken to be the same.
    """
    by = ["file_path_hash", "fingerprint"]
    p = parked.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("line_number", "line_id")))
    b = born.where("content_tokens > 2").withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("line_number")))
    return p.select(*by, "k", "line_id").join(b.select(*by, "k", "line_number"), [*by, "k"]).select("line_id", "line_number")


def numbered(born: DataFrame, first_id: int) -> DataFrame:
    """line_id in birth order: commit, path, line.

    Lines are ranked inside their file and files inside their commit; only one number for each commit is summed over all.
    """
    per_file = born.groupBy("ord", "path").agg(F.count(F.lit(1)).alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = per_file.select("ord", "path", earlier(Window.partitionBy("ord").orderBy("path")).alias("__files"))
    commits = per_file.groupBy("ord").agg(F.sum("n").alias("n")).select("ord", earlier(Window.orderBy("ord")).alias("__commits"))
    inside = F.row_number().over(Window.partitionBy("ord", "path").orderBy("line"))
    held = born.join(files, ["ord", "path"]).join(commits, "ord")
    return held.withColumn("line_id", F.lit(first_id) + F.col("__commits") + F.col("__files") + inside).drop("__files", "__commits")


def checkpoints(lines: DataFrame, seen: DataFrame) -> DataFrame:
    """``lines`` with last_seen moved forward by (line_id, at, commit).

    Time never runs back; at a tie the new commit wins; a sighting without a commit keeps the old commit.
    """
    # of several sightings of a line, the latest; one with a commit before one without
    best = seen.groupBy("line_id").agg(F.max(F.struct("at", "commit")).alias("s"))
    joined = lines.join(best, "line_id", "left")
    newer = F.coalesce(F.col("s.at") >= F.col("last_seen_at"), F.lit(False))
    return joined.withColumn("last_seen_commit", F.when(newer, F.coalesce("s.commit", "last_seen_commit")).otherwise(F.col("last_seen_commit"))).withColumn("last_seen_at", F.greatest("last_seen_at", F.coalesce("s.at", "last_seen_at"))).drop("s")


def anchored(lines: DataFrame, fates: DataFrame, snapshot_lines: DataFrame, commit: str) -> DataFrame:
    """Lines not yet in a commit get this one as their birth commit, and their present bigrams as those of birth."""
    now = snapshot_lines.groupBy("line_id").agg(F.max_by("bigrams", F.struct("file_path_hash", "line_number")).alias("__now"))
    joined = lines.join(now, "line_id", "left")
    fresh = F.col("birth_commit").isNull() & F.col("__now").isNotNull()
    return joined.withColumn("birth_bigrams", F.when(fresh, F.col("__now")).otherwise(F.col("birth_bigrams"))).withColumn("birth_commit", F.when(fresh, F.lit(commit)).otherwise(F.col("birth_commit"))).drop("__now")


def revised(lines: DataFrame, fates: DataFrame) -> DataFrame:
    """Agent lines that an edit outside a session changed become agent_then_human_revised; a move revises nothing."""
    hit = fates.where("state = 'edited'").select("line_id").distinct().withColumn("__hit", F.lit(True))
    joined = lines.join(hit, "line_id", "left")
    return joined.withColumn("origin", F.when((F.col("origin") == "agent") & F.col("__hit"), "agent_then_human_revised").otherwise(F.col("origin"))).drop("__hit")


def reconcile_classes(stored: DataFrame, head: DataFrame, disk: DataFrame, parents: DataFrame) -> DataFrame:
    """(file_path_hash, class) of each stored file, from what HEAD, the disk and HEAD's parents hold.

    ahead: on disk, not in HEAD; no_evidence: in neither, nor in a parent; compare; left_alone: HEAD's content is the stored.
    """
    h = head.select("file_path_hash", F.col("content_id").alias("__head"), F.lit(True).alias("__in_head"))
    d = disk.select("file_path_hash", F.lit(True).alias("__on_disk")).distinct()
    p = parents.select("file_path_hash", F.lit(True).alias("__had")).distinct()
    joined = stored.join(h, "file_path_hash", "left").join(d, "file_path_hash", "left").join(p, "file_path_hash", "left")
    kind = F.when(F.col("__in_head"), F.when(F.col("content_id") == F.col("__head"), "left_alone").otherwise("compare")).when(F.col("__on_disk"), "ahead").when(F.col("__had"), "compare").otherwise("no_evidence")
    return joined.select("file_path_hash", kind.alias("class"))


def session_status(lines: DataFrame, fates: DataFrame, alive: DataFrame) -> DataFrame:
    """One row for each session: written, alive, committed, edited and deleted lines, shares, and, where lines tell their
    origin, those that a person revised."""
    found = fates.groupBy("line_id").agg(F.bool_or(F.col("state") == "edited").alias("edited"), F.bool_or(F.col("state") == "dead").alias("deleted"))
    held = lines.where("session_id is not null").join(found, "line_id", "left").join(alive.select("line_id", F.lit(True).alias("alive")), "line_id", "left")
    out = held.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("written"),
        F.count_if("alive").alias("alive"),
        F.count_if(F.col("birth_commit").isNotNull()).alias("committed"),
        F.count_if("edited").alias("edited"),
        F.count_if("deleted").alias("deleted"),
        *([F.count_if(F.col("origin") == "agent_then_human_revised").alias("revised")] if "origin" in lines.columns else []),
    )
    return out.withColumn("alive_share", F.col("alive") / F.col("written")).withColumn("edited_share", F.col("edited") / F.col("written"))


def ancestors(parents: DataFrame, start: str) -> DataFrame:
    """(sha) of a commit and all that it descends from, over every parent: (sha, parent) joined until nothing is new."""
    spark = parents.sparkSession
    seen = frontier = spark.createDataFrame([(start,)], "sha string")
    while True:
        new = frontier.join(parents, "sha").select(F.col("parent").alias("sha")).where("sha is not null").distinct().join(seen, "sha", "left_anti").checkpoint()
        if new.isEmpty():
            return seen
        seen, frontier = seen.unionByName(new), new


# fixed values: keys of ``meta`` and the state of a backfill that hasn't finished
CAPTURE_STARTED = "capture.started"
BACKFILL_STATE = "backfill.state"
BACKFILL_RUNNING = "running"


def set_meta(meta: DataFrame, new: DataFrame) -> DataFrame:
    """(key, value) with the values of ``new`` over those that were there."""
    return replace_groups(meta, new.select("key", "value"), "key")


def stamp_capture(meta: DataFrame, at: int) -> DataFrame:
    """``meta`` with the time at which live capture began; the first stamp stays."""
    return insert_absent(meta, meta.sparkSession.createDataFrame([(CAPTURE_STARTED, str(at))], "key string, value string"), "key")


def captured(meta: DataFrame, sessions: DataFrame, fates: DataFrame, commits: DataFrame) -> DataFrame:
    """One row of what live capture has recorded: stamped, sessions, write_fates, reconciled_commits, has_commits.

    Each table is brought down to its one row of counts first, so only four rows meet.
    """
    one = lambda df, *counts: df.agg(*counts).withColumn("__one", F.lit(1))
    parts = [
        one(meta, (F.count_if(F.col("key") == CAPTURE_STARTED) > 0).alias("stamped")),
        one(sessions, F.count(F.lit(1)).alias("sessions")),
        one(fates, F.count_if(F.col("observed_commit").isNull()).alias("write_fates")),
        one(commits, F.count_if(F.col("observed_by") == "reconcile").alias("reconciled_commits"), (F.count(F.lit(1)) > 0).alias("has_commits")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "__one")
    return out.drop("__one")


def unfinished(meta: DataFrame) -> DataFrame:
    """The row of ``meta`` that says that a backfill was begun and not finished; captures wait for it."""
    return meta.where((F.col("key") == BACKFILL_STATE) & (F.col("value") == BACKFILL_RUNNING))


def session_lines(sessions: DataFrame, lines: DataFrame, session: str | None = None) -> DataFrame:
    """Lines that a session wrote: the one named, or the one that began last (of a tie, the greatest ``seq``)."""
    if session is not None:
        return lines.where(F.col("session_id") == session)
    # one row at most, so the join is a broadcast of one id
    latest = sessions.orderBy(F.desc("started_at"), F.desc("seq")).limit(1).select("session_id")
    return lines.join(F.broadcast(latest), "session_id", "left_semi")


def delta_counts(born: DataFrame, fates: DataFrame) -> DataFrame:
    """(state, n) of what one reconciliation changes; ``born`` counts its new lines."""
    return fates.groupBy("state").agg(F.count(F.lit(1)).alias("n")).unionByName(born.agg(F.lit("born").alias("state"), F.count(F.lit(1)).alias("n")))


def named(df: DataFrame, *sources: DataFrame, column: str = "file_path_hash") -> DataFrame:
    """``df`` with the name of each path hash: (file_path_hash, path) of the first source that has it, else a note that it's gone."""
    every = None
    for rank, source in enumerate(sources):
        one = source.select(F.col("file_path_hash").alias("__hash"), F.struct(F.lit(rank).alias("rank"), F.col("path").alias("path")).alias("__at"))
        every = one if every is None else every.unionByName(one)
    names = every.groupBy("__hash").agg(F.min("__at").alias("__at"))
    gone = F.concat(F.lit("a file no longer present (path hash "), F.col(column), F.lit(")"))
    return df.join(names, F.col(column) == F.col("__hash"), "left").withColumn("name", F.coalesce("__at.path", gone)).drop("__hash", "__at")


def unmatched(wanted: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has, ``missing`` from ``held`` or ``unknown`` to ``wanted``."""
    w, h = wanted.select(key).distinct(), held.select(key).distinct()
    return w.join(h, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(h.join(w, key, "left_anti").withColumn("side", F.lit("unknown")))


def unaccounted(live: DataFrame, present: DataFrame, dead: DataFrame, *key: str) -> DataFrame:
    """Keys that were alive and are now neither present nor declared dead."""
    return live.select(*key).distinct().join(present.select(*key).distinct(), list(key), "left_anti").join(dead.select(*key).distinct(), list(key), "left_anti")


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, columns, row): every row of every table as JSON, nulls kept, with the table's column names and types."""
    out = None
    for name in sorted(tables):
        df = tables[name]
        row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
        one = df.select(F.lit(name).alias("table"), F.lit(df.schema.simpleString()).alias("columns"), row.alias("row"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables")
    return out
