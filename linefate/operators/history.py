"""Commit order, windows over history, and clocks."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def commit_pairs(commits: DataFrame, *by: str) -> DataFrame:
    """(by, ord, previous, sha) of consecutive commits."""
    w = Window.partitionBy(*by).orderBy("ord")
    return commits.withColumn("previous", F.lag("sha").over(w)).where(F.col("previous").isNotNull()).select(*by, "ord", "previous", "sha")


def changed_work(tree: DataFrame, *by: str) -> DataFrame:
    """(by, ord, files, changed_bytes): tracked files of each commit and the bytes of those that it adds or changes.

    ``tree`` is (by, ord, path, content_id, size); a file counts as changed unless the commit before has the same content.
    """
    before = tree.select(*by, (F.col("ord") + 1).alias("ord"), "path", F.col("content_id").alias("was"))
    joined = tree.join(before, [*by, "ord", "path"], "left")
    changed = ~F.col("content_id").eqNullSafe(F.col("was")) | F.col("content_id").isNull()
    return joined.groupBy(*by, "ord").agg(F.count(F.lit(1)).alias("files"), F.sum(F.when(changed, F.col("size")).otherwise(0)).alias("changed_bytes"))


def since_window(commits: DataFrame, *by: str, last: int | None = None, day: Column | None = None, shallow: Column | None = None) -> DataFrame:
    """(by, start, baseline): where a backfill of the last commits, or of those since a day, begins.

    Full history starts at 0 without a baseline. A window that begins at index 0 or 1 of a whole clone starts at 0 without
    one; others start one commit earlier, whose lines are the baseline. The first commit of a shallow clone always is one.
    A window without commits has a null start.
    """
    shallow = F.lit(False) if shallow is None else shallow
    n = F.max("ord") + 1
    first = F.greatest(n - last, F.lit(0)) if last is not None else F.min(F.when(F.col("committed_at") >= day, F.col("ord"))) if day is not None else F.lit(0)
    got = commits.groupBy(*by).agg(first.alias("first"), F.bool_or(shallow).alias("shallow"))
    whole = (F.col("first") <= 1) & ~F.col("shallow")
    start = F.when(F.col("first").isNull(), None).when(whole | (F.col("first") == 0), 0).otherwise(F.col("first") - 1)
    return got.select(*by, start.cast("long").alias("start"), F.when(F.col("first").isNull(), None).otherwise(~whole).alias("baseline"))


def carry_forward(tree: DataFrame, *by: str) -> DataFrame:
    """``tree`` (by, path, ord, content_id, parsed) and effective_content: the last version that could be parsed.

    A path that goes and comes back starts anew. A version that no parsed one precedes has none (null).
    """
    w = Window.partitionBy(*by, "path").orderBy("ord")
    island = F.sum(F.when(F.col("ord") - F.lag("ord").over(w) == 1, 0).otherwise(1)).over(w)
    marked = tree.withColumn("__island", island)
    inside = Window.partitionBy(*by, "path", "__island").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("effective_content", F.last(F.when(F.col("parsed"), F.col("content_id")), ignorenulls=True).over(inside)).drop("__island")


def repaired(times: list[int]) -> list[int]:
    """The nearest clock that never runs back: times of a longest non-decreasing subsequence stay, others are moved.

    Another time becomes the smallest kept one after it if it is greater, and at least the greatest before it. Of the
    longest subsequences the one whose values are least at each length is kept.
    """
    tails: list[int] = []
    length = []
    for t in times:
        length.append(bisect.bisect_right(tails, t))
        tails[length[-1] : length[-1] + 1] = [t]
    stays = np.zeros(len(times), dtype=bool)
    wanted = len(tails) - 1
    for i in range(len(times) - 1, -1, -1):
        if length[i] == wanted:
            stays[i], wanted = True, wanted - 1
    own = np.array(times, dtype=np.int64)
    after = np.where(stays, own, np.iinfo(np.int64).max)
    return np.maximum.accumulate(np.minimum(own, np.minimum.accumulate(after[::-1])[::-1])).tolist() if times else []


def monotone_clock(commits: DataFrame, by: str) -> DataFrame:
    """(by, ord, committed_at, clock) of each repository's history, which is one sequence and one task."""
    schema = commits.select(by, "ord", "committed_at").schema.add("clock", "long")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")[[by, "ord", "committed_at"]]
        return pdf.assign(clock=repaired([int(x) for x in pdf["committed_at"]]))

    return commits.select(by, "ord", "committed_at").groupBy(by).applyInPandas(run, schema)


def resumed(commits: DataFrame, recorded: DataFrame, *by: str) -> DataFrame:
    """Commits (by, ord, sha) that come after the last one recorded (by, sha); where none is recorded, all of them.

    One row for each history is joined, so nothing but the commits themselves is shuffled.
    """
    last = commits.join(recorded.select(*by, "sha").distinct(), [*by, "sha"], "left_semi").groupBy(*by).agg(F.max("ord").alias("__last"))
    joined = commits.join(last, list(by), "left") if by else commits.join(last.withColumn("__one", F.lit(1)), F.col("__one") == 1, "left").drop("__one")
    return joined.where(F.col("__last").isNull() | (F.col("ord") > F.col("__last"))).drop("__last")
