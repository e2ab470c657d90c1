"""The store on disk and the report's tables."""

import pytest
from linefate.operators import history, report, store, survival
from linefate.sources import lifetimes
from linefate.sources.store_files import Store, StoreError
from pyspark.sql import functions as F


def test_commits_are_whole(spark, tmp_path):
    held = Store(spark, f"file://{tmp_path}/store")
    assert held.stored_version() is None
    held.open()
    assert held.stored_version() == 5 and held.read("lines").count() == 0
    meta = spark.createDataFrame([("backfill.state", "running")], "key string, value string")
    assert held.commit(meta=meta) == 1 and held.meta("backfill.state") == "running"
    other = Store(spark, f"file://{tmp_path}/store").open()
    with pytest.raises(StoreError):
        held.commit(meta=_racing(meta, other))
    assert held.meta("backfill.state") == "running"
    held._point({"schema_version": 3, "commit": 0, "tables": {}})
    with pytest.raises(StoreError):
        held.open()
    held._point({"schema_version": 4, "commit": 2, "tables": {}})
    assert held.open().stored_version() == 5


def _racing(df, other):
    """A table whose writing lets another writer commit first."""

    class Racing:
        def select(self, *columns):
            other.commit(meta=df)
            return df.select(*columns)

    return Racing()


def test_report(spark):
    rows = [(i, i // 5, "agent" if i % 2 else "human", float(i % 4), float(i % 4 + 1) if i % 3 else float("inf")) for i in range(60)]
    df = spark.createDataFrame(rows, "line_id long, cluster long, origin string, left double, right double")
    out = report.report(lambda _: df, "origin", resamples=8).collect()
    assert {r.death for r in out} == {"deleted", "rewritten"} and len(out) == 2 * 2 * (5 + 4 + 1)
    assert all(r.low <= r.high for r in out if r.stat == "survival")
    with pytest.raises(ValueError):
        report.checked(threshold=1.5)


def test_store_status(spark):
    meta = spark.createDataFrame([("backfill.state", "running")], "key string, value string")
    assert store.unfinished(meta).count() == 1
    done = store.set_meta(meta, spark.createDataFrame([("backfill.state", "complete")], "key string, value string"))
    assert store.unfinished(done).isEmpty()
    stamped = store.stamp_capture(store.stamp_capture(done, 3), 8)
    assert {tuple(r) for r in stamped.collect()} == {("backfill.state", "complete"), ("capture.started", "3")}
    sessions = spark.createDataFrame([], "session_id string, started_at long, seq long")
    held = spark.createDataFrame([(1, "a", "agent"), (2, "b", "agent_then_human_revised")], "line_id long, session_id string, origin string")
    assert store.session_lines(sessions, held).isEmpty()
    tie = spark.createDataFrame([("a", 5, 1), ("b", 5, 2)], "session_id string, started_at long, seq long")
    assert [r.line_id for r in store.session_lines(tie, held).collect()] == [2]
    assert [r.line_id for r in store.session_lines(tie, held, "a").collect()] == [1]
    fates = spark.createDataFrame([], "line_id long, state string")
    status = store.session_status(held.withColumn("birth_commit", F.lit(None).cast("string")), fates, held.select("line_id"))
    assert {r.session_id: r.revised for r in status.collect()} == {"a": 0, "b": 1}
    told = store.audit({"m": stamped, "h": held}).collect()
    assert len(told) == 4 and {r.table for r in told} == {"m", "h"}


def test_resume(spark):
    commits = spark.createDataFrame([(i, f"c{i}") for i in range(6)], "ord int, sha string")
    none = commits.where("ord < 0")
    assert history.resumed(commits, none).count() == 6
    assert sorted(r.ord for r in history.resumed(commits, commits.where("ord in (1, 3)")).collect()) == [4, 5]


def test_lifetime_lines(spark):
    df = spark.createDataFrame([("1 2.5",), ("",), (" 3\tinf ",)], "value string")
    assert sorted(tuple(r) for r in lifetimes.parse(df).collect()) == [(1.0, 2.5), (3.0, float("inf"))]
    with pytest.raises(Exception, match="no lifetime"):
        lifetimes.parse(spark.createDataFrame([("1 x",)], "value string")).collect()


def test_numbered_against_one_sort(spark):
    rows = [(o, f"p{p}", n) for o in range(5) for p in range(o + 1) for n in range(1, 4) if (o + p + n) % 3]
    got = {(r.ord, r.path, r.line): r.line_id for r in store.numbered(spark.createDataFrame(rows, "ord int, path string, line int"), 10).collect()}
    assert got == {row: 11 + k for k, row in enumerate(sorted(rows))}


def test_top_groups_with_null_key(spark):
    df = spark.createDataFrame([(k,) for k, n in ((None, 5), ("a", 4), ("b", 3), ("c", 3)) for _ in range(n)], "key string")
    assert {r.key: r.group for r in survival.top_groups(df, F.col("key"), 3).collect()} == {None: None, "a": "a", "b": "other", "c": "other"}
    assert "other" not in {r.group for r in survival.top_groups(df, F.col("key"), 4).collect()}
