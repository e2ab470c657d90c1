"""What the survival report and the story of one line hold, as long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BAND_POINTS, LEVEL, REPORT_AGES, SWEEP_THRESHOLDS
from . import survival, turnbull

MOST_RESAMPLES = 2000


def checked(threshold: float = 0.5, resamples: int = 200, seed: int = 1) -> tuple[float, int, int]:
    """Options of a report, or ValueError."""
    if not 0 < threshold < 1:
        raise ValueError("the rewrite threshold lies between 0 and 1")
    if not 0 <= resamples <= MOST_RESAMPLES:
        raise ValueError(f"at most {MOST_RESAMPLES} resamples")
    if seed < 0:
        raise ValueError("the seed is 0 or more")
    return threshold, resamples, seed


def curves(observed: DataFrame, by: str, drawable: DataFrame | None = None, ages: tuple[float, ...] = REPORT_AGES) -> DataFrame:
    """(by, age, survival) at the report's ages, and at evenly spaced ages up to each group's drawn horizon."""
    masses = turnbull.estimates(observed, by)
    asked = masses.select(by).distinct().select(by, F.explode(F.array(*[F.lit(a) for a in ages])).alias("age"))
    if drawable is not None:
        points = F.transform(F.sequence(F.lit(0), F.lit(BAND_POINTS - 1)), lambda k: F.col("drawable") * k / (BAND_POINTS - 1))
        asked = asked.unionByName(drawable.where("drawable > 0").select(by, F.explode(points).alias("age"))).distinct()
    held = masses.join(asked, by)
    beyond = F.when((F.col("end") == float("inf")) | (F.col("age") <= F.col("start")), 1.0).when(F.col("age") >= F.col("end"), 0.0).otherwise((F.col("end") - F.col("age")) / (F.col("end") - F.col("start")))
    return held.groupBy(by, "age").agg(F.least(F.greatest(F.sum(F.col("mass") * beyond), F.lit(0.0)), F.lit(1.0)).alias("survival"))


def report(histories_of, by: str, *, cluster: str = "cluster", order: str = "line_id", threshold: float = 0.5, resamples: int = 200, seed: int = 1) -> DataFrame:
    """(death, by, stat, age, value, low, high) of both definitions of death.

    ``histories_of(threshold or None)`` gives lifetimes (by, cluster, order, left, right) under one definition. Statistics
    are lines, deaths, follow_up, known_until, drawable, median and survival at the report's ages, the last two with bands.
    """
    threshold, resamples, seed = checked(threshold, resamples, seed)
    out = None
    for number, (death, level) in enumerate((("deleted", None), ("rewritten", threshold))):
        observed = histories_of(level)
        base = survival.follow_up(observed, by)
        plain = base.select(by, F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.lit(None).cast("double").alias("age"), F.col(c).cast("double").alias("value")) for s, c in (("lines", "n"), ("deaths", "deaths"), ("follow_up", "follow_up"), ("known_until", "known_until"), ("drawable", "drawable"))])).alias("x")).select(by, "x.*", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
        at = curves(observed, by).select(by, F.lit("survival").alias("stat"), "age", F.col("survival").alias("value"))
        middle = turnbull.medians(observed, by).select(by, F.lit("median").alias("stat"), F.lit(None).cast("double").alias("age"), F.col("median").alias("value"))
        fitted = at.unionByName(middle)
        if resamples:
            found = turnbull.replicates(observed, by, cluster, order, lambda e: [*[e.survival(a) for a in REPORT_AGES], e.median()], len(REPORT_AGES) + 1, resamples, seed + number * 64 * 0x9E3779B9)
            ages = F.element_at(F.array(*[F.lit(a) for a in REPORT_AGES], F.lit(None).cast("double")), F.col("k") + 1)
            bands = turnbull.bands(found, by, resamples, LEVEL).select(F.col(by).alias("__by"), ages.alias("__age"), "low", "high")
            fitted = fitted.join(bands, F.col(by).eqNullSafe(F.col("__by")) & F.col("age").eqNullSafe(F.col("__age")), "left").drop("__by", "__age")
        else:
            fitted = fitted.withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double"))
        one = plain.unionByName(fitted).select(F.lit(death).alias("death"), by, "stat", "age", "value", "low", "high")
        out = one if out is None else out.unionByName(one)
    return out


def sweep(histories_of, by: str) -> DataFrame:
    """(by, threshold, age, survival) for each rewrite threshold, at the largest report age that every group was followed to."""
    known = survival.follow_up(histories_of(None), by).agg(F.min("known_until")).first()[0] or 0.0
    age = max((a for a in REPORT_AGES if a <= known), default=REPORT_AGES[0])
    out = None
    for threshold in SWEEP_THRESHOLDS:
        one = turnbull.survival_at(turnbull.estimates(histories_of(threshold), by), [age], by).withColumn("threshold", F.lit(threshold))
        out = one if out is None else out.unionByName(one)
    return out


def story(line_id: int, lines: DataFrame, fates: DataFrame, commits: DataFrame, snapshot_lines: DataFrame) -> DataFrame:
    """(seq, what, at, commit, file_path_hash, line_number, similarity, layer, candidate_alive) of one line, birth first, then
    its fates in order, then where it stands now."""
    none = lambda kind: F.lit(None).cast(kind)
    line = lines.where(F.col("line_id") == line_id)
    born = line.select(F.lit(-1).cast("long").alias("seq"), F.lit("born").alias("what"), F.col("birth_ts").alias("at"), F.col("birth_commit").alias("commit"), "file_path_hash", F.col("birth_line_number").alias("line_number"), none("double").alias("similarity"), none("string").alias("layer"), none("boolean").alias("candidate_alive"))
    here = snapshot_lines.select(F.col("line_id").alias("__candidate"), F.lit(True).alias("__alive"))
    told = fates.where(F.col("line_id") == line_id).join(here, F.col("matched_candidate_id") == F.col("__candidate"), "left")
    told = told.select("seq", F.col("state").alias("what"), F.col("observed_at").alias("at"), F.col("observed_commit").alias("commit"), "file_path_hash", "line_number", F.col("similarity_score").alias("similarity"), F.col("deciding_layer").alias("layer"), F.when(F.col("matched_candidate_id").isNotNull(), F.coalesce("__alive", F.lit(False))).alias("candidate_alive"))
    now = snapshot_lines.where(F.col("line_id") == line_id).join(line.select("line_id", "last_seen_at", "last_seen_commit"), "line_id").select(F.lit(2**62).cast("long").alias("seq"), F.lit("now").alias("what"), F.col("last_seen_at").alias("at"), F.col("last_seen_commit").alias("commit"), "file_path_hash", "line_number", none("double").alias("similarity"), none("string").alias("layer"), none("boolean").alias("candidate_alive"))
    return born.unionByName(told).unionByName(now).orderBy("seq")
