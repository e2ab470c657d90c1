"""Line dedup by distinct-site spread, with DataFrame functions only.

A line is boilerplate when it stands on at least ``sites`` distinct sources and in documents that otherwise differ: the
documents that hold it have, for at least half of them, a context of their own, the least digest of their other lines. So
the lines of copied documents, which come with the same other lines, stay for the document joins to judge. One document
keeps the line: the one of the least id.

Both counts are HyperLogLog sketches for each line's digest, merged by aggregation. Only lines whose estimates lie near a
threshold are counted exactly, so every decision is that of the exact counts but for estimates that err by more than
``margin``.

That rule is ``report``'s and its SQL's. ``dedup`` decides by ``widespread``, where copies hide no boilerplate and shared
lines never stand for a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialized

SITES = 5
#: Bits of a sketch's size: 2**10 registers, about 3 % standard error beyond a few hundred, exact-like below.
SKETCH = 10
MARGIN = 0.15
#: One part in OWN of a document's characters stands in lines below the threshold, or it is a copy and no evidence.
OWN = 4


def _digests(text: Column) -> Column:
    """md5 of each line without white space at its ends; null for a blank line."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x) != "", F.unhex(F.md5(F.trim(x).cast("binary")))))


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with the digests of their lines; rows of equal id, source and text are told apart by nothing and treated alike."""
    return docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"), F.coalesce(F.col("source"), F.lit("")).alias("__site"))


def spread(docs: DataFrame) -> DataFrame:
    """(line binary, site, context binary, id) of every distinct line of every document."""
    lines = F.array_sort(F.array_distinct(F.filter(_digests(F.col("__text")), lambda x: x.isNotNull())))
    held = _keyed(docs).select("__id", "__site", lines.alias("lines"))
    return held.select("__id", "__site", F.try_element_at("lines", F.lit(1)).alias("one"), F.try_element_at("lines", F.lit(2)).alias("two"), F.explode("lines").alias("line")).select(
        "line", F.col("__site").alias("site"), F.coalesce(F.when(F.col("line") == F.col("one"), F.col("two")).otherwise(F.col("one")), F.lit(b"")).alias("context"), F.col("__id").alias("id")
    )


def boilerplate(docs: DataFrame, *, sites: int = SITES, margin: float = MARGIN) -> DataFrame:
    """(line binary, keeper): digests of the lines to remove, and the document that keeps each.

    A null source is a site of its own, the text ``''``. Documents with null ids count but keep nothing if another can.
    """
    rows = spread(docs)
    counted = rows.groupBy("line").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("id").alias("keeper"),
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH))).alias("site_guess"),
        F.hll_sketch_estimate(F.hll_sketch_agg("context", F.lit(SKETCH))).alias("context_guess"),
    )
    # a line on n distinct documents has n sites at most; nothing below the lower margin can be boilerplate
    low = counted.where((F.col("n") >= sites) & (F.col("site_guess") >= sites * (1 - margin)) & (2 * F.col("context_guess") >= F.col("n") * (1 - margin)))
    near = (F.col("site_guess") <= sites * (1 + margin)) | (2 * F.col("context_guess") <= F.col("n") * (1 + margin))
    candidates = materialized(low.select("line", "keeper", "n", near.alias("near")), "lines")
    # exact counts for those near a threshold: distinct pairs are aggregated before they meet by line
    again = rows.join(candidates.where("near").select("line"), "line", "left_semi")
    exact_sites = again.groupBy("line", "site").agg(F.lit(1).alias("x")).groupBy("line").agg(F.count(F.lit(1)).alias("sites"))
    exact_contexts = again.groupBy("line", "context").agg(F.lit(1).alias("x")).groupBy("line").agg(F.count(F.lit(1)).alias("contexts"))
    sure = candidates.where("not near").select("line", "keeper")
    counted_again = candidates.where("near").join(exact_sites, "line").join(exact_contexts, "line").where((F.col("sites") >= sites) & (2 * F.col("contexts") >= F.col("n"))).select("line", "keeper")
    return materialized(sure.unionByName(counted_again), "boilerplate")


def widespread(docs: DataFrame, *, sites: int = SITES, margin: float = MARGIN) -> DataFrame:
    """(line binary, keeper) as boilerplate() gives them, counted over documents that differ in lines of their own.

    A document's own lines are those on less than ``sites`` sources, its context the longest of them; the document of least
    id stands for its context. A line goes if these stand on ``sites`` sources. Documents of which less than one
    part in OWN is their own, such as copies over many sources, neither count nor hide what others show.
    """
    digest = lambda x: F.struct(F.length(F.trim(x)).alias("size"), F.unhex(F.md5(F.trim(x).cast("binary"))).alias("line"))
    held = F.array_distinct(F.transform(F.filter(F.split("__text", "\n"), lambda x: F.trim(x) != ""), digest))
    rows = _keyed(docs).select(F.struct(F.col("__id").alias("id"), F.xxhash64(F.coalesce("__text", F.lit(""))).alias("hash")).alias("row"), F.col("__site").alias("site"), F.explode(held).alias("x"))
    rows = rows.select("row", "site", F.col("x.size").alias("size"), F.col("x.line").alias("line"))
    guess = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH)))
    counted = rows.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("row.id").alias("keeper"), guess.alias("guess"))
    low = materialized(counted.where((F.col("n") >= sites) & (F.col("guess") >= sites * (1 - margin))).select("line", "keeper", (F.col("guess") <= sites * (1 + margin)).alias("near")), "lines")
    again = rows.join(low.where("near").select("line"), "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("x"))
    exact = again.groupBy("line").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= sites).select("line")
    candidates = materialized(low.where("not near").unionByName(low.join(exact, "line", "left_semi")).select("line", "keeper", F.lit(True).alias("wide")), "candidates")
    own = F.col("wide").isNull()
    by_doc = rows.join(candidates.select("line", "wide"), "line", "left").groupBy("row", "site").agg(
        F.sum("size").alias("chars"),
        F.sum(F.when(own, F.col("size"))).alias("own"),
        F.max(F.when(own, F.struct("size", "line")))["line"].alias("context"),
        F.collect_list(F.when(F.col("wide"), F.col("line"))).alias("held"),
    )
    shown = by_doc.where(OWN * F.col("own") >= F.col("chars")).select(F.struct(F.col("row.id").alias("id"), "site").alias("one"), "context", F.explode("held").alias("line"))
    stands = shown.groupBy("line", "context").agg(F.min("one")["site"].alias("site")).groupBy("line", "site").agg(F.lit(1).alias("x")).groupBy("line").agg(F.count(F.lit(1)).alias("sites"))
    return materialized(candidates.join(stands.where(F.col("sites") >= sites).select("line"), "line", "left_semi").select("line", "keeper"), "boilerplate")


def cleaned(docs: DataFrame, *, sites: int = SITES, margin: float = MARGIN, rule: Callable[..., DataFrame] = boilerplate) -> DataFrame:
    """``docs`` and, beside their columns, __n_lines, __n_removed and __clean: the text without boilerplate lines.

    Blank lines stay. A null text has no lines and stays null; an empty text has one blank line. A document may lose all
    its lines; its text is then empty.
    """
    own = docs.withColumn("__row", F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")))
    bad = rule(docs, sites=sites, margin=margin)
    digests = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")).alias("row"), F.explode(F.array_distinct(F.filter(_digests(F.col("text")), lambda x: x.isNotNull()))).alias("line"))
    hit = digests.join(bad, "line").where(~F.col("row.id").eqNullSafe(F.col("keeper"))).groupBy("row").agg(F.collect_set("line").alias("__bad"))
    joined = own.join(hit.select(F.col("row.id").alias("__hit_id"), F.col("row.hash").alias("__hit_hash"), "__bad"), F.col("__row.id").eqNullSafe(F.col("__hit_id")) & (F.col("__row.hash") == F.col("__hit_hash")), "left")
    lines = F.split("text", "\n")
    # lines are digested again only where something is to be removed
    kept = F.when(F.col("__bad").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__bad"), F.unhex(F.md5(F.trim(x).cast("binary"))))))
    columns = [F.col(c) for c in docs.columns]
    out = joined.select(*columns, F.coalesce(F.size(lines), F.lit(0)).alias("__n_lines"), kept.alias("__kept"))
    return out.select(*columns, F.when(F.col("text").isNull(), 0).otherwise(F.col("__n_lines")).cast("long").alias("__n_lines"), F.when(F.col("text").isNull(), 0).otherwise(F.col("__n_lines") - F.size("__kept")).cast("long").alias("__n_removed"), F.array_join("__kept", "\n").alias("__clean"))


def dedup(docs: DataFrame, *, sites: int = SITES, margin: float = MARGIN) -> DataFrame:
    """``docs`` without boilerplate lines; the columns stay as they are. A document that loses every line that isn't blank goes."""
    out = cleaned(docs, sites=sites, margin=margin, rule=widespread).where((F.col("__n_removed") == 0) | (F.trim(F.translate("__clean", "\n", "")) != ""))
    return out.select(*[F.col("__clean").alias(c) if c == "text" else F.col(c) for c in docs.columns])


def report(docs: DataFrame, *, sites: int = SITES, margin: float = MARGIN) -> DataFrame:
    """(doc_id, n_lines, n_removed, clean_md5) of every document; the digest of a null text is that of the empty one."""
    out = cleaned(docs, sites=sites, margin=margin)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.md5(F.coalesce("__clean", F.lit("")).cast("binary")).alias("clean_md5"))


#: The same decisions by exact counts.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(source, '') AS site FROM documents),
l AS (SELECT r, doc_id, site, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
m AS (SELECT r, doc_id, site, raw, pos, CASE WHEN trim(raw, ' ') <> '' THEN md5(trim(raw, ' ')) END AS line FROM l),
u AS (SELECT DISTINCT r, doc_id, site, line FROM m WHERE line IS NOT NULL),
o AS (SELECT *, first_value(line) OVER w AS one, nth_value(line, 2) OVER w AS two FROM u WINDOW w AS (PARTITION BY r ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
c AS (SELECT line, min(doc_id) AS keeper FROM o GROUP BY line HAVING count(DISTINCT site) >= {SITES} AND 2 * count(DISTINCT coalesce(CASE WHEN line = one THEN two ELSE one END, '')) >= count(*)),
k AS (SELECT m.r, m.raw, m.pos, c.line IS NOT NULL AND m.doc_id IS DISTINCT FROM c.keeper AS gone FROM m LEFT JOIN c ON m.line = c.line),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS clean FROM k GROUP BY r)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, md5(coalesce(clean, '')) AS clean_md5
FROM d LEFT JOIN g USING (r)
"""
