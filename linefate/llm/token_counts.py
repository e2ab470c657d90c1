"""Token counts from an exact length histogram.

Documents are aggregated by encoded length; there are as many rows as distinct lengths. Sums over all greater lengths then
answer, for every context limit, how many documents reach it, how many tokens stay when each document is cut at it, and
which length stands at any quantile, without another look at the documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(lengths: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """(length, n_docs): how many documents have each encoded length. A null length counts as 0."""
    return lengths.groupBy(F.coalesce(F.col(n_tokens), F.lit(0)).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """One row for each length L of the histogram, taken as a context limit.

    n_docs, n_docs_longer (length > L), n_docs_upto (length <= L), tokens_upto, tokens_total, truncated_total (tokens
    left when every document is cut at L), quantile (share of documents of length <= L). Between two rows the truncated
    total grows by n_docs_longer for each token of limit. An empty table has no rows. The windows run over the
    histogram, whose rows are bounded by the number of distinct lengths, not by the documents.
    """
    up = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("length") * F.col("n_docs")
    return (
        hist.withColumn("n_docs_upto", F.sum("n_docs").over(up))
        .withColumn("n_all", F.sum("n_docs").over(every))
        .withColumn("tokens_upto", F.sum(tokens).over(up))
        .withColumn("tokens_total", F.sum(tokens).over(every))
        .select(
            "length",
            "n_docs",
            (F.col("n_all") - F.col("n_docs_upto")).alias("n_docs_longer"),
            "n_docs_upto",
            "tokens_upto",
            "tokens_total",
            (F.col("tokens_upto") + F.col("length") * (F.col("n_all") - F.col("n_docs_upto"))).alias("truncated_total"),
            (F.col("n_docs_upto") / F.col("n_all")).alias("quantile"),
        )
    )


def truncated_totals(table: DataFrame, context_limits: Sequence[int]) -> DataFrame:
    """(context_limit, truncated_total, n_docs_longer) for any limits, from the rows of limits().

    A limit below the shortest document keeps that many tokens of each; one of an empty table keeps none.
    """
    spark = table.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in context_limits], "context_limit long")
    at = F.max_by(F.struct("length", "truncated_total", "n_docs_longer"), F.when(F.col("length") <= F.col("context_limit"), F.col("length")))
    n_all = F.max(F.col("n_docs_longer") + F.col("n_docs_upto"))
    # the asked limits are a short list of the caller's, so the join is a broadcast of a few rows
    joined = table.join(F.broadcast(asked), F.lit(True), "right").groupBy("context_limit").agg(at.alias("at"), n_all.alias("n_all"), F.min("length").alias("least"))
    longer = F.when(F.col("least") <= F.col("context_limit"), F.col("at.n_docs_longer")).otherwise(F.coalesce("n_all", F.lit(0)))
    total = F.when(F.col("least") <= F.col("context_limit"), F.col("at.truncated_total") + F.col("at.n_docs_longer") * (F.col("context_limit") - F.col("at.length"))).otherwise(F.coalesce(F.col("n_all") * F.col("context_limit"), F.lit(0)))
    return joined.select("context_limit", total.alias("truncated_total"), longer.alias("n_docs_longer"))


def quantiles(table: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, length): the least length that at least this share of the documents does not exceed; none of an empty table."""
    spark = table.sparkSession
    asked = spark.createDataFrame([(float(x),) for x in shares], "share double")
    joined = table.join(F.broadcast(asked), F.col("quantile") >= F.col("share"), "right")
    return joined.groupBy("share").agg(F.min("length").alias("length"))
