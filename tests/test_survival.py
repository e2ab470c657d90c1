"""Estimators against published values and each other; store changes; every query against its SQL."""

import duckdb
import numpy as np
import pytest
from linefate.operators import store, survival, turnbull
from linefate.plans import catalogue
from pyspark.sql import functions as F

INF = float("inf")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def fit(rows):
    left, right = (np.array(x, dtype=float) for x in zip(*rows, strict=True))
    return turnbull.fit(left, right, np.ones(len(left)))


def test_published_remission_times():
    died, alive = [6, 6, 6, 7, 10, 13, 16, 22, 23], [6, 9, 10, 11, 17, 19, 20, 25, 32, 32, 34, 35]
    e = fit([(t - 1e-6, t) for t in died] + [(t, INF) for t in alive])
    want = {6: 0.857, 7: 0.807, 10: 0.753, 13: 0.690, 16: 0.627, 22: 0.538, 23: 0.448}
    assert {t: round(e.survival(t), 3) for t in want} == want and round(e.median(), 3) == 23 and e.converged


def test_interval_deaths():
    e = fit([(0, 2), (1, 3)])
    assert [e.survival(t) for t in (1, 1.5, 2)] == [1, 0.5, 0] and e.median() == 1.5
    e = fit([(0, 1), (2, 3), (0, 3)])
    assert np.allclose(e.mass, [0.5, 0.5])
    assert fit([(1, INF)]).median() is None and turnbull.fit(np.empty(0), np.empty(0), np.empty(0)).converged


def test_weights_are_repetitions():
    rows = [(0, 2), (0, 2), (1, 4), (3, INF)]
    a, b = fit(rows), turnbull.fit(np.array([0.0, 1, 3]), np.array([2.0, 4, INF]), np.array([2.0, 1, 1]))
    assert np.allclose(a.mass, b.mass)


def test_reproducible_draws():
    numbers = turnbull.stream(1)
    assert [next(numbers) for _ in range(2)] == [10451216379200822465, 13757245211066428519]
    assert turnbull.draws(7, 3, 50).sum() == 50 and (turnbull.draws(7, 3, 50) == turnbull.draws(7, 3, 50)).all()


def test_long_fits_reach_the_maximum():
    rng = np.random.default_rng(4)
    left = rng.exponential(3, 4000).round(2)
    right = np.where(rng.random(4000) < 0.3, INF, left + rng.exponential(2, 4000).round(2) + 0.01)
    weight = rng.integers(0, 3, 4000).astype(float)
    e = turnbull.fit(left, right, weight)
    assert e.converged and e.iterations < 1000 and np.isclose(e.mass.sum(), 1)
    left, right, weight = (x[weight > 0] for x in (left, right, weight))
    inside = (e.start >= left[:, None]) & (e.end <= right[:, None])
    slope = (inside * (weight / (inside @ e.mass))[:, None]).sum(axis=0) / weight.sum()
    assert slope.max() < 1 + 1e-8 and np.allclose(slope[e.mass > 0], 1, atol=1e-8), "no mass can be moved to raise the likelihood"


def test_long_fits_agree_with_plain_iterations(monkeypatch):
    rng = np.random.default_rng(6)
    left = rng.integers(0, 60, 300).astype(float)
    right = np.where(rng.random(300) < 0.3, INF, left + rng.integers(1, 40, 300))
    fast = turnbull.fit(left, right, np.ones(300))
    monkeypatch.setattr(turnbull, "maximum", lambda lives, mass: None)
    slow = turnbull.fit(left, right, np.ones(300))
    assert fast.iterations < slow.iterations and np.allclose([fast.survival(t) for t in range(60)], [slow.survival(t) for t in range(60)], atol=1e-4)


@pytest.mark.parametrize("seed, replicate, n", [(1, 0, 1), (7, 3, 50), (2**64 + 5, 199, 1000)])
def test_draws_follow_the_stream(monkeypatch, seed, replicate, n):
    monkeypatch.setattr(turnbull, "DRAWN_AT_ONCE", 64)
    numbers = turnbull.stream(seed ^ (replicate * 0xD1B54A32D192ED03 & turnbull.MASK))
    want = [0] * n
    for _ in range(n):
        want[next(numbers) * n >> 64] += 1
    assert turnbull.draws(seed, replicate, n).tolist() == want


def test_replicates_are_spread_over_tasks(spark):
    rows = [(k, k // 3, "ab"[k % 2], float(k % 5), float(k % 5 + 1)) for k in range(60)]
    df = spark.createDataFrame(rows, "line_id long, cluster long, g string, left double, right double")
    found = turnbull.replicates(df, "g", "cluster", "line_id", lambda e: [e.survival(2.5), e.median()], 2, 64, 1, chunk=8)
    tasks = found.select("g", "replicate", "k", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.g, r.replicate, r.k) for r in tasks) == [(g, r, k) for g in "ab" for r in range(64) for k in range(2)]
    assert len({r.task for r in tasks}) > 4


def test_clusters_widen_bands(spark):
    rows = [(c * 20 + k, c, "g", float(c % 5), float(c % 5 + 1)) for c in range(10) for k in range(20)]
    df = spark.createDataFrame(rows, "line_id long, cluster long, g string, left double, right double")
    width = {}
    for cluster in ("cluster", "line_id"):
        found = turnbull.replicates(df, "g", cluster, "line_id" if cluster == "cluster" else "cluster", lambda e: [e.survival(2.5)], 1, 64, 1)
        band = turnbull.bands(found, "g", 64).first()
        width[cluster] = band.high - band.low
    assert width["cluster"] > 2 * width["line_id"]


def test_store_changes(spark):
    make = spark.createDataFrame
    old = make([("a", "t", "m", 1), ("b", "t", None, 2)], "session_id string, tool string, model string, started_at long")
    new = make([("a", "u", None, 9), ("b", "u", "n", 9), ("c", "u", None, 9)], old.schema)
    assert sorted(map(tuple, store.upsert_sessions(old, new).collect())) == [("a", "t", "m", 1), ("b", "t", "n", 2), ("c", "u", None, 9)]
    once = store.insert_absent(old, new, "session_id")
    assert sorted(map(tuple, store.insert_absent(once, new, "session_id").collect())) == sorted(map(tuple, once.collect()))
    parked = make([(1, "f", 3, 77), (2, "f", 9, 77)], "line_id long, file_path_hash string, line_number int, fingerprint long")
    born = make([("f", 5, 77, 4), ("f", 6, 77, 4), ("f", 7, 78, 4), ("f", 1, 77, 2)], "file_path_hash string, line_number int, fingerprint long, content_tokens int")
    assert sorted(map(tuple, store.returning(parked, born).collect())) == [(1, 5), (2, 6)]
    lines = make([(1, 10, "x"), (2, 10, "x")], "line_id long, last_seen_at long, last_seen_commit string")
    seen = make([(1, 10, "y"), (2, 5, "y"), (1, 12, None)], "line_id long, at long, commit string")
    assert sorted(map(tuple, store.checkpoints(lines, seen).select("line_id", "last_seen_at", "last_seen_commit").collect())) == [(1, 12, "x"), (2, 10, "x")]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = oracle.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    near = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted(repr([near(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    at = [want.columns.index(c) for c in sorted(df.columns)]
    assert got == sorted(repr([near(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", ["rename_assignment", "turnbull_interval", "monotone_clock", "file_fates", "recorded_writes", "traced_lines"])
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").agg(F.count("*")).first()[0] >= 0


def test_bootstrap_bands_query_is_whole(spark, monkeypatch):
    drawn = []
    bands = turnbull.bands
    monkeypatch.setattr(turnbull, "bands", lambda found, by, n, *a: drawn.append(n) or bands(found, by, n, *a))
    rows = catalogue.bootstrap_bands(spark, "/root/testdata/sf0.001").collect()
    assert drawn == [200] and {r.k for r in rows} == {0, 1, 2, 3, 4}, "200 resamples, four ages and the median"


def test_threshold_sweep_reads_the_history_once(spark):
    sf = "/root/testdata/sf0.001"
    sweep = catalogue.threshold_sweep(spark, sf)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans(sweep) == scans(catalogue.turnbull_interval(spark, sf)) > 0
    got = {(r.threshold, r.entry_origin): r.survival for r in sweep.collect()}
    want = {}
    for threshold in catalogue.SWEEP_THRESHOLDS:
        one = turnbull.survival_at(turnbull.estimates(catalogue._observed(spark, sf, threshold), "entry_origin"), [7.0], "entry_origin")
        want |= {(threshold, r.entry_origin): r.survival for r in one.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_swept_histories_equal_those_of_each_threshold(spark):
    lines = spark.createDataFrame([(1, "a", 100), (2, "a", 100), (3, None, 100)], "line_id long, birth_commit string, entered_at long")
    fates = [(1, 1, "edited", 0.2, 110, None), (2, 1, "edited", 0.6, 120, 110), (3, 1, "dead", None, 130, 120), (4, 2, "edited", 0.45, 140, 100), (5, 2, "edited", None, 150, 140)]
    fates = spark.createDataFrame([(*f, "b", False) for f in fates], "seq long, line_id long, state string, birth_similarity double, observed_at long, previous_seen_at long, observed_commit string, before_first_commit boolean")
    levels = [0.1, 0.3, 0.5, 0.7]
    got = survival.swept(lines, fates, levels)
    for level in levels:
        one = survival.histories(lines, fates, level)
        assert sorted(got.where(F.col("threshold") == level).select(*one.columns).collect(), key=repr) == sorted(one.collect(), key=repr)
    assert got.where("line_id = 1").orderBy("threshold").select("death.observed_at").toPandas()["observed_at"].tolist() == [130, 110, 110, 110]
    assert got.count() == 12 and got.where("line_id = 3 AND death IS NULL").count() == 4


def test_deleted_added_pairs_every_version(spark):
    sf = "/root/testdata/sf0.001"
    turns = {(r.conv_id, r.turn) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    last = max(t for _, t in turns)
    got = {(r.conv_id, r.ord): r.change for r in catalogue.deleted_added_all(spark, sf).collect()}
    assert set(got) == {(c, t) for c, t in turns if t > 0} | {(c, t + 1) for c, t in turns if t < last} and any(t > 1 for _, t in got)
    assert {c: x for (c, t), x in got.items() if t == 1} == {r.conv_id: r.change for r in catalogue.deleted_added(spark, sf).collect()}
    assert all((x == "added") == ((c, t - 1) not in turns) and (x == "deleted") == ((c, t) not in turns) for (c, t), x in got.items())
