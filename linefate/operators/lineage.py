"""Identities of lines over a whole history: births, one fate for each version, and the stored lines and fates."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POSITION = ("path", "line")


def _written(df: DataFrame, folder: str) -> DataFrame:
    path = posixpath.join(folder, uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_folder(spark: SparkSession) -> str:
    """A fresh folder below the one that the session's machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints"
    return posixpath.join(base, f"lineage-{uuid.uuid4().hex}")


def positions(tree: DataFrame, key: str = "repo") -> DataFrame:
    """(key, ord, path, line) of every tracked line of every version."""
    return tree.select(key, "ord", "path", F.explode("lines").alias("l")).select(key, "ord", "path", F.col("l.number").alias("line"))


def births(tree: DataFrame, decided: DataFrame, key: str = "repo") -> DataFrame:
    """Positions that no line of the version before came to."""
    kept = decided.where("state <> 'dead'").select(key, "ord", F.col("new_path").alias("path"), F.col("new_line").alias("line"))
    return positions(tree, key).join(kept, [key, "ord", "path", "line"], "left_anti")


def identities(tree: DataFrame, decided: DataFrame, key: str = "repo", folder: str | None = None) -> DataFrame:
    """(key, ord, path, line, birth_ord, birth_path, birth_line) of every position.

    Matches form disjoint paths through the versions. Each position points to where its line stood before; pointers are
    doubled until all reach a birth, in as many rounds as the history's length has binary digits.
    """
    folder = folder or work_folder(tree.sparkSession)
    links = decided.where("state <> 'dead'").select(key, "ord", F.col("new_path").alias("path"), F.col("new_line").alias("line"), (F.col("ord") - 1).alias("b_ord"), F.col("old_path").alias("b_path"), F.col("old_line").alias("b_line"))
    own = births(tree, decided, key).select(key, "ord", "path", "line", F.col("ord").alias("b_ord"), F.col("path").alias("b_path"), F.col("line").alias("b_line"))
    held = _written(links.unionByName(own), folder)
    length = tree.agg(F.max("ord")).first()[0] or 0
    for _ in range(int(length).bit_length()):
        up = held.select(F.col(key).alias("k"), F.col("ord").alias("b_ord"), F.col("path").alias("b_path"), F.col("line").alias("b_line"), F.col("b_ord").alias("o2"), F.col("b_path").alias("p2"), F.col("b_line").alias("l2"))
        joined = held.join(up.withColumnRenamed("k", key), [key, "b_ord", "b_path", "b_line"], "left")
        held = _written(joined.select(key, "ord", "path", "line", F.coalesce("o2", "b_ord").alias("b_ord"), F.coalesce("p2", "b_path").alias("b_path"), F.coalesce("l2", "b_line").alias("b_line")), folder)
    return held.select(key, "ord", "path", "line", F.col("b_ord").alias("birth_ord"), F.col("b_path").alias("birth_path"), F.col("b_line").alias("birth_line"))


def fates(decided: DataFrame, ids: DataFrame, key: str = "repo") -> DataFrame:
    """One row for each line and version after its birth: birth position, ord, state, path, line, similarity, layer."""
    before = ids.select(key, (F.col("ord") + 1).alias("ord"), F.col("path").alias("old_path"), F.col("line").alias("old_line"), "birth_ord", "birth_path", "birth_line")
    return decided.join(before, [key, "ord", "old_path", "old_line"]).select(key, "birth_ord", "birth_path", "birth_line", "ord", "state", F.col("new_path").alias("path"), F.col("new_line").alias("line"), "similarity", "layer", "candidate_path", "candidate_line")


def broken(tree: DataFrame, decided: DataFrame, key: str = "repo") -> DataFrame:
    """Violations of what must hold: each old position decided once, each new one claimed once. Empty if all is well."""
    old = positions(tree, key).join(tree.groupBy(key).agg(F.max("ord").alias("last")), key).where("ord < last").drop("last").withColumn("ord", F.col("ord") + 1)
    said = decided.groupBy(key, "ord", F.col("old_path").alias("path"), F.col("old_line").alias("line")).agg(F.count(F.lit(1)).alias("n"))
    undecided = old.join(said, [key, "ord", "path", "line"], "full_outer").where("n is null or n > 1").select(key, "ord", "path", "line", F.lit("decided").alias("rule"))
    claimed = decided.where("state <> 'dead'").groupBy(key, "ord", F.col("new_path").alias("path"), F.col("new_line").alias("line")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return undecided.unionByName(claimed.select(key, "ord", "path", "line", F.lit("claimed").alias("rule")))


def trace_json(commits: DataFrame, all_births: DataFrame, traced: DataFrame, version: str, key: str = "repo") -> DataFrame:
    """(key, trace): one JSON document for each history, contract version 1. ``commits`` is (key, ord, sha)."""
    named = commits.select(key, "ord", "sha")
    fate = F.struct("ord", F.struct(F.col("sha").alias("commit"), "state", "path", "line", F.col("similarity").alias("similarity_score"), F.col("layer").alias("deciding_layer")).alias("fate"))
    by_line = traced.join(named, [key, "ord"]).groupBy(key, "birth_ord", "birth_path", "birth_line").agg(F.sort_array(F.collect_list(fate)).alias("fates"))
    born = all_births.select(key, F.col("ord").alias("birth_ord"), F.col("path").alias("birth_path"), F.col("line").alias("birth_line"))
    first = named.select(key, F.col("ord").alias("birth_ord"), "sha")
    held = born.join(by_line, [key, "birth_ord", "birth_path", "birth_line"], "left").join(first, [key, "birth_ord"])
    line = F.struct("birth_ord", "birth_path", "birth_line", F.struct(F.struct(F.col("sha").alias("commit"), F.col("birth_path").alias("path"), F.col("birth_line").alias("line")).alias("birth"), F.coalesce(F.transform("fates", lambda x: x["fate"]), F.array()).alias("fates")).alias("line"))
    lines = held.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]).alias("lines"))
    order = commits.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "sha"))), lambda x: x["sha"]).alias("commits"))
    doc = F.struct(F.lit(1).alias("contract_version"), F.struct(F.lit("linefate").alias("name"), F.lit(version).alias("version")).alias("engine"), "commits", F.coalesce("lines", F.array()).alias("lines"))
    return order.join(lines, key, "left").select(key, F.to_json(doc).alias("trace"))


def stored(commits: DataFrame, tree: DataFrame, traced: DataFrame, ids: DataFrame, key: str = "repo") -> tuple[DataFrame, DataFrame]:
    """(lines, fates) as a backfill stores them: everything is human, verbatim fates are left out, survivors are seen last.

    ``commits`` is (key, ord, sha, clock). Ids are given in the order of births: version, path, line.
    """
    from .store import numbered

    at = commits.select(key, "ord", "sha", "clock")
    alive = ids.groupBy(key, "birth_ord", "birth_path", "birth_line").agg(F.max("ord").alias("last_ord"))
    born = alive.select(key, F.col("birth_ord").alias("ord"), F.col("birth_path").alias("path"), F.col("birth_line").alias("line"), "last_ord")
    lines = numbered(born, 0).join(at, [key, "ord"]).withColumnRenamed("sha", "birth_commit").withColumnRenamed("clock", "birth_ts")
    last = at.select(key, F.col("ord").alias("last_ord"), F.col("sha").alias("last_seen_commit"), F.col("clock").alias("last_seen_at"))
    lines = lines.join(last, [key, "last_ord"]).withColumn("origin", F.lit("human"))
    names = lines.select(key, F.col("ord").alias("birth_ord"), F.col("path").alias("birth_path"), F.col("line").alias("birth_line"), "line_id")
    before = at.select(key, (F.col("ord") + 1).alias("ord"), F.col("clock").alias("previous_seen_at"))
    told = traced.where("state <> 'verbatim'").join(names, [key, "birth_ord", "birth_path", "birth_line"]).join(at, [key, "ord"]).join(before, [key, "ord"])
    seq = F.row_number().over(Window.partitionBy("line_id").orderBy("ord"))
    out = told.select("line_id", seq.alias("seq"), F.col("clock").alias("observed_at"), F.col("sha").alias("observed_commit"), "previous_seen_at", "state", F.col("similarity").alias("similarity_score"), F.col("layer").alias("deciding_layer"), "path", F.col("line").alias("line_number"))
    return lines.select(key, "line_id", "path", "birth_commit", "birth_ts", F.col("line").alias("birth_line_number"), "origin", "last_seen_at", "last_seen_commit"), out
