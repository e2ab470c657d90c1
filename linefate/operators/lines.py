"""Line features of plain-text versions and line-level matches between two sides, without Python on the path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MIN_MOVE_BLOCK_CONTENT_TOKENS, MIN_MOVE_BLOCK_LINES, MOVE_SEED_MAX_CANDIDATES, SINGLE_LINE_MOVE_MIN_CONTENT_TOKENS
from ..functions import text


def tracked_lines(versions: DataFrame, *keep: str) -> DataFrame:
    """(keep, number, tokens, fingerprint, content_tokens) of each line that has a token."""
    held = versions.select(*keep, F.posexplode(text.lines_of(F.col("content"))).alias("pos", "line"))
    split = held.select(*keep, (F.col("pos") + 1).alias("number"), text.words(F.col("line")).alias("tokens")).where(F.size("tokens") > 0)
    return split.select(*keep, "number", "tokens", text.fingerprint(F.col("tokens")).alias("fingerprint"), text.content_tokens(F.col("tokens")).alias("content_tokens"))


def unchanged(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Matches of files whose content is the same: an equi-join on the line number, by far most rows of a history."""
    o = old.select(*keys, F.col("path").alias("old_path"), "number", "fingerprint")
    n = new.select(*keys, F.col("path").alias("new_path"), "number", F.col("fingerprint").alias("new_fingerprint"))
    return o.join(n, [*keys, "number"]).where("fingerprint = new_fingerprint").drop("new_fingerprint")


def unique_moves(old: DataFrame, new: DataFrame, pair: str) -> DataFrame:
    """(pair, fingerprint, old_number, new_number): lines that stand once on either side of a pair and hold enough."""

    def once(side: DataFrame, name: str) -> DataFrame:
        counted = side.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(pair, "fingerprint")))
        return counted.where((F.col("k") == 1) & (F.col("content_tokens") >= SINGLE_LINE_MOVE_MIN_CONTENT_TOKENS)).select(pair, "fingerprint", F.col("number").alias(name))

    return once(old, "old_number").join(once(new, "new_number"), [pair, "fingerprint"])


def move_blocks(old: DataFrame, new: DataFrame, pair: str, most: int = MOVE_SEED_MAX_CANDIDATES) -> DataFrame:
    """(pair, old_start, new_start, n_lines, tokens) of maximal runs of equal lines on one diagonal of a pair.

    ``idx`` numbers a file's tracked lines. A line with more than ``most`` partners doesn't start a block, but blocks run
    through it: all equal pairs on a diagonal that has a start are joined.
    """
    o = old.select(pair, F.col("idx").alias("o"), "fingerprint", "content_tokens")
    n = new.select(pair, F.col("idx").alias("n"), "fingerprint")
    partners = n.groupBy(pair, "fingerprint").agg(F.count(F.lit(1)).alias("partners"))
    diagonals = o.join(partners.where(F.col("partners") <= most), [pair, "fingerprint"]).join(n, [pair, "fingerprint"]).select(pair, (F.col("o") - F.col("n")).alias("diagonal")).distinct()
    # every other pair of equal lines is looked for along those diagonals only
    seeded = o.join(diagonals, pair).withColumn("n", F.col("o") - F.col("diagonal")).join(n, [pair, "n", "fingerprint"]).join(partners, [pair, "fingerprint"])
    w = Window.partitionBy(pair, "diagonal").orderBy("o")
    islands = seeded.withColumn("island", F.col("o") - F.row_number().over(w))
    found = islands.groupBy(pair, "diagonal", "island").agg(F.min("o").alias("old_start"), F.min("n").alias("new_start"), F.count(F.lit(1)).alias("n_lines"), F.sum("content_tokens").alias("tokens"), F.min("partners").alias("least"))
    return found.where((F.col("least") <= most) & (F.col("n_lines") >= MIN_MOVE_BLOCK_LINES) & (F.col("tokens") >= MIN_MOVE_BLOCK_CONTENT_TOKENS)).select(pair, F.col("old_start").cast("long").alias("old_start"), F.col("new_start").cast("long").alias("new_start"), "n_lines", "tokens")
