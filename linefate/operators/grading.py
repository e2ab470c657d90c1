"""Grading decisions against expected fates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERDICTS = ("missing", "wrong_state", "misplaced", "correct")


def judged(expected: DataFrame, actual: DataFrame, *key: str) -> DataFrame:
    """``expected`` (key, state, path, line), what was decided, and a verdict: missing, wrong_state, misplaced or correct."""
    a = actual.select(*key, F.col("state").alias("actual"), F.col("path").alias("actual_path"), F.col("line").alias("actual_line"), *(["deciding_layer"] if "deciding_layer" in actual.columns else []))
    joined = expected.join(a, list(key), "left")
    same_place = F.col("path").eqNullSafe(F.col("actual_path")) & F.col("line").eqNullSafe(F.col("actual_line"))
    verdict = F.when(F.col("actual").isNull(), "missing").when(F.col("state") != F.col("actual"), "wrong_state").when((F.col("state") != "dead") & ~same_place, "misplaced").otherwise("correct")
    return joined.withColumn("verdict", verdict)


def confusion(graded: DataFrame) -> DataFrame:
    """(expected, actual, n), missing answers as ``missing`` and misplaced ones as ``misplaced``."""
    seen = F.when(F.col("verdict") == "missing", "missing").when(F.col("verdict") == "misplaced", "misplaced").otherwise(F.col("actual"))
    return graded.groupBy(F.col("state").alias("expected"), seen.alias("actual")).agg(F.count(F.lit(1)).alias("n"))


def precision_recall(graded: DataFrame) -> DataFrame:
    """(state, right, expected, predicted, precision, recall); a misplaced answer counts as predicted, not as right."""
    want = graded.groupBy("state").agg(F.count_if(F.col("verdict") == "correct").alias("right"), F.count(F.lit(1)).alias("expected"))
    said = graded.where("actual is not null").groupBy(F.col("actual").alias("state")).agg(F.count(F.lit(1)).alias("predicted"))
    joined = want.join(said, "state", "full_outer").fillna(0, ["right", "expected", "predicted"])
    return joined.withColumn("precision", F.col("right") / F.nullif(F.col("predicted"), F.lit(0))).withColumn("recall", F.col("right") / F.nullif(F.col("expected"), F.lit(0)))


def conflicts(actual: DataFrame, *position: str) -> DataFrame:
    """Positions that more than one line claims; each is one error."""
    return actual.groupBy(*position).agg(F.count(F.lit(1)).alias("claimants")).where("claimants > 1")


def errors_by_layer(graded: DataFrame) -> DataFrame:
    return graded.where("verdict <> 'correct'").groupBy("deciding_layer").agg(F.count(F.lit(1)).alias("n"))
