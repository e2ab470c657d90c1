"""Lifetimes from text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """(left, right) of lines ``left right``; ``inf`` is a line still alive. Blank lines are skipped, others must parse."""
    return parse(spark.read.text(path))


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """As ``read``, from a column of text; an end that isn't a number fails the query when it is read."""
    parts = F.split(F.trim(F.regexp_replace(F.col(column), r"\s+", " ")), " ")
    number = lambda k: F.coalesce(F.try_element_at(parts, F.lit(k)).try_cast("double"), F.raise_error(F.concat(F.lit("no lifetime: "), F.col(column))).cast("double"))
    return lines.where(F.col(column).rlike(r"\S")).select(number(1).alias("left"), number(2).alias("right"))
