"""Decisions between two versions of a tree, and the DataFrame operator that takes all pairs of versions at once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FILE_RENAME_MIN_JACCARD
from . import hunks, moves
from .hunks import Line

#: A decision about one old line; a dead line has no new place but perhaps a candidate.
DECISION = "old_path string, old_line int, state string, similarity double, layer string, new_path string, new_line int, candidate_path string, candidate_line int"
Version = dict[str, tuple[str | None, list[Line]]]


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _folder(path: str) -> str:
    return path.rpartition("/")[0]


def correspond(old: Version, new: Version) -> list[tuple[str, str]]:
    """Pairs of paths: the same path, else equal content, else similar content, each time best first and one to one."""
    pairs = [(p, p) for p in old if p in new]
    gone, come = [p for p in old if p not in new], [p for p in new if p not in old]
    prints = {(side, p): frozenset(x.print for x in version[p][1] if x.content) for side, version, paths in ((0, old, gone), (1, new, come)) for p in paths}

    def take(found: Iterable[tuple[float, str, str]]) -> None:
        for _, o, n in sorted(found, key=lambda x: (-x[0], _name(x[1]) != _name(x[2]), _folder(x[1]) != _folder(x[2]), x[1], x[2])):
            if o in gone and n in come:
                pairs.append((o, n))
                gone.remove(o)
                come.remove(n)

    by_content: dict = defaultdict(list)
    for n in come:
        if new[n][0] is not None:
            by_content[new[n][0]].append(n)
    take([(1.0, o, n) for o in gone if old[o][0] is not None for n in by_content.get(old[o][0], ())])
    holders: dict = defaultdict(list)
    for n in come:
        for key in prints[1, n]:
            holders[key].append(n)
    similar = []
    for o in gone:
        shared: dict = defaultdict(int)
        for key in prints[0, o]:
            for n in holders.get(key, ()):
                shared[n] += 1
        for n, k in shared.items():
            likeness = k / (len(prints[0, o]) + len(prints[1, n]) - k)
            if likeness >= FILE_RENAME_MIN_JACCARD:
                similar.append((likeness, o, n))
    take(similar)
    return pairs


def decide(old: Version, new: Version, same: bool | None = None) -> list[tuple]:
    """DECISION rows of every old line, by path and line. ``same`` overrides whether the one pair counts as unchanged."""
    old_paths, new_paths = sorted(old), sorted(new)
    olds, news = [moves.Side(old[p][1]) for p in old_paths], [moves.Side(new[p][1]) for p in new_paths]
    where_old, where_new = {p: k for k, p in enumerate(old_paths)}, {p: k for k, p in enumerate(new_paths)}
    aligned: dict[int, tuple[str, hunks.Alignment]] = {}
    for pair, (o, n) in enumerate(correspond(old, new)):
        equal = same if same is not None else old[o][0] is not None and old[o][0] == new[n][0]
        found = (hunks.unchanged if equal else hunks.align)(old[o][1], new[n][1])
        a, b = olds[where_old[o]], news[where_new[n]]
        a.pair = b.pair = pair
        a.free, a.rewritten = [x.what == "residue" for x in found.old], [x.rewrite is not None for x in found.old]
        b.free, b.rewritten = [x == "residue" for x, _ in found.new], [k is not None for _, k in found.new]
        aligned[where_old[o]] = (n, found)
    moved = {(f, i): (new_paths[g], news[g].lines[j].number, layer) for f, i, g, j, layer in moves.detect(olds, news)}
    out = []
    for f, path in enumerate(old_paths):
        target, found = aligned.get(f, (None, None))
        for i, line in enumerate(olds[f].lines):
            head = (path, line.number)
            if (f, i) in moved:
                place, number, layer = moved[f, i]
                out.append((*head, "moved", 1.0, layer, place, number, None, None))
                continue
            if found is None:
                out.append((*head, "dead", 0.0, "no_match", None, None, None, None))
                continue
            x = found.old[i]
            number = None if x.new is None else new[target][1][x.new].number
            if x.what == "match":
                out.append((*head, x.state, x.score, x.layer, target, number, None, None))
            else:
                layer = "reflow" if x.what == "reflow" else {None: "no_match", "hunk": "hunk_rewrite", "file": "file_rewrite"}[x.rewrite]
                out.append((*head, "dead", x.score, layer, None, None, None if number is None else target, number))
    return out


def compare_file(old: list[Line], new: list[Line]) -> list[tuple]:
    """DECISION rows of one file without content ids; lines of equal numbers and prints throughout count as unchanged."""
    equal = [(x.number, x.print) for x in old] == [(x.number, x.print) for x in new]
    return decide({"": (None, old)}, {"": (None, new)}, same=equal)


LINES = "array<struct<number:int,kind:string,role:string,content:int,tokens:array<string>,matched:array<string>>>"


def to_lines(rows: Iterable) -> list[Line]:
    return [Line(int(r["number"]), r["kind"], int(r["content"]), tuple(r["tokens"]), tuple(r["matched"]), r["role"]) for r in (() if rows is None else rows)]


def decisions(tree: DataFrame, *, key: str = "repo") -> DataFrame:
    """(key, ord, DECISION) for every version and the one before, from (key, ord, path, content_id, lines).

    Paths whose content stays are matched by a join on the line number; only files that changed reach Python, those of
    one version together, as moves and renames run between them. All versions are decided side by side: none needs the
    identities that another finds.
    """
    old = tree.select(key, (F.col("ord") + 1).alias("ord"), "path", F.col("content_id").alias("was"), F.col("lines").alias("old_lines"))
    last = tree.groupBy(key).agg(F.max("ord").alias("last"))
    both = old.join(tree.select(key, "ord", "path", "content_id", "lines"), [key, "ord", "path"], "full_outer").join(last, key)
    both = both.where((F.col("ord") <= F.col("last")) & (F.col("ord") > 0))
    stays = F.coalesce(F.col("was") == F.col("content_id"), F.lit(False))
    kept = both.where(stays).select(key, "ord", "path", F.explode("old_lines").alias("o"), "lines")
    kept = kept.where(F.exists("lines", lambda n: n["number"] == F.col("o.number"))).select(
        key, "ord", F.col("path").alias("old_path"), F.col("o.number").alias("old_line"), F.lit("verbatim").alias("state"), F.lit(1.0).alias("similarity"), F.lit("unchanged_file").alias("layer"),
        F.col("path").alias("new_path"), F.col("o.number").alias("new_line"), F.lit(None).cast("string").alias("candidate_path"), F.lit(None).cast("int").alias("candidate_line"),
    )
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in tree.select(key, "ord").schema.fields] + [DECISION])
    names = [key, "ord", *[x.split()[0] for x in DECISION.split(", ")]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        before = {r.path: (r.was, to_lines(r.old_lines)) for r in pdf.itertuples() if r.old_lines is not None}
        after = {r.path: (r.content_id, to_lines(r.lines)) for r in pdf.itertuples() if r.lines is not None}
        head = (pdf[key].iloc[0], pdf["ord"].iloc[0])
        return pd.DataFrame([(*head, *row) for row in decide(before, after)], columns=names).astype({"old_line": "Int32", "new_line": "Int32", "candidate_line": "Int32"})

    changed = both.where(~stays).select(key, "ord", "path", "was", "content_id", "old_lines", "lines")
    return changed.groupBy(key, "ord").applyInPandas(run, schema).unionByName(kept)
