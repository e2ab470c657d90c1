"""Which file of one version became which file of the next: same path, exact rename, similar rename."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FILE_RENAME_MIN_JACCARD
from ..functions import text


def by_path(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Full outer pairing on (keys, path): (keys, path, old_content, new_content, change)."""
    joined = old.select(*keys, "path", F.col("content_id").alias("old_content"), F.lit(1).alias("in_old")).join(new.select(*keys, "path", F.col("content_id").alias("new_content"), F.lit(1).alias("in_new")), [*keys, "path"], "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(F.col("old_content") == F.col("new_content"), "same").otherwise("changed")
    return joined.select(*keys, "path", "old_content", "new_content", change.alias("change"))


def exact_renames(deleted: DataFrame, added: DataFrame, *keys: str) -> DataFrame:
    """(keys, old_path, new_path) of equal content; an unknown content is null and equals nothing."""
    return deleted.select(*keys, F.col("path").alias("old_path"), "content_id").join(added.select(*keys, F.col("path").alias("new_path"), "content_id"), [*keys, "content_id"]).select(*keys, "old_path", "new_path")


def similar_renames(old_lines: DataFrame, new_lines: DataFrame, *keys: str, threshold: float = FILE_RENAME_MIN_JACCARD) -> DataFrame:
    """(keys, old_path, new_path, shared, similarity) of file pairs whose sets of line fingerprints are similar.

    Inputs are (keys, path, fingerprint). A fingerprint's files are counted first and each file's rarest fingerprints,
    as many as any partner must share one of, make the candidates; only their sets are compared. So a line that stands
    in every file never pairs all files.
    """
    old, new = old_lines.select(*keys, "path", "fingerprint").distinct(), new_lines.select(*keys, "path", "fingerprint").distinct()
    seen = old.unionByName(new).groupBy(*keys, "fingerprint").agg(F.count(F.lit(1)).alias("files"))

    def prefix(side: DataFrame) -> DataFrame:
        ranked = side.join(seen, [*keys, "fingerprint"])
        own = Window.partitionBy(*keys, "path")
        return ranked.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("files", "fingerprint"))).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)

    a = prefix(old).select(*keys, F.col("path").alias("old_path"), "fingerprint", F.col("n").alias("n_old"))
    b = prefix(new).select(*keys, F.col("path").alias("new_path"), "fingerprint", F.col("n").alias("n_new"))
    sizes = (F.least("n_old", "n_new") >= F.greatest("n_old", "n_new") * threshold)
    candidates = a.join(b, [*keys, "fingerprint"]).where(sizes).select(*keys, "old_path", "new_path", "n_old", "n_new").distinct()
    shared = candidates.join(old.withColumnRenamed("path", "old_path"), [*keys, "old_path"]).join(new.withColumnRenamed("path", "new_path"), [*keys, "new_path", "fingerprint"]).groupBy(*keys, "old_path", "new_path", "n_old", "n_new").agg(F.count(F.lit(1)).alias("shared"))
    similarity = F.col("shared") / (F.col("n_old") + F.col("n_new") - F.col("shared"))
    return shared.select(*keys, "old_path", "new_path", "shared", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def ranked(candidates: DataFrame) -> list:
    """Order in which candidates are taken."""
    same_name = text.file_name(F.col("old_path")) == text.file_name(F.col("new_path"))
    same_parent = text.parent(F.col("old_path")) == text.parent(F.col("new_path"))
    return [F.desc("similarity"), same_name.desc(), same_parent.desc(), F.col("old_path"), F.col("new_path")]


def assign(candidates: DataFrame, key: str) -> DataFrame:
    """One-to-one renames of each group of (key, old_path, new_path, similarity), best first.

    Taking is sequential within a group; a group is one pair of versions and holds candidates only.
    """
    placed = candidates.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*ranked(candidates))))
    schema = placed.select(key, "old_path", "new_path", "similarity").schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        olds, news, keep = set(), set(), []
        for o, n in zip(pdf["old_path"], pdf["new_path"], strict=True):
            keep.append(o not in olds and n not in news)
            if keep[-1]:
                olds.add(o)
                news.add(n)
        return pdf.loc[keep, [key, "old_path", "new_path", "similarity"]]

    return placed.select(key, "old_path", "new_path", "similarity", "rank").groupBy(key).applyInPandas(run, schema)
