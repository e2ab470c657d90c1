"""Write events as a stream: each file's last snapshot is keyed state, each event gives births, fates and a new snapshot.

The same step serves a stream (applyInPandasWithState) and a batch replay, so both give the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text
from ..functions.lexers import normalize
from ..operators.compare import compare_file
from ..operators.hunks import Line, dice

EVENTS = "session_id string, model string, tool_name string, path string, content string, committed string, at long, seq long"
OUT = "file_path_hash string, at long, seq long, kind string, line_id long, line_number int, state string, similarity double, layer string, candidate_id long, birth_similarity double, previous_seen_at long, origin string, session_id string, birth_observed boolean"
STATE = "snapshot string"
NAMES = [x.split()[0] for x in OUT.split(", ")]


def _pack(line: Line) -> list:
    return [line.number, line.kind, line.content, list(line.tokens), list(line.matched)]


def _unpack(x: list) -> Line:
    return Line(x[0], x[1], x[2], tuple(x[3]), tuple(x[4]))


def step(state: dict | None, event: dict) -> tuple[dict, list[tuple]]:
    """The next state and OUT rows of one write.

    A file seen before: births are the agent's; what changed gives fates, verbatim lines don't. A file first seen: lines
    that its committed version had, or all if an edit touched a file that no commit has, were there already.
    """
    lines = normalize(event["content"] or "", event["language"])
    key, now = event["file_path_hash"], event["at"]
    made = state["made"] if state else 0
    ids: list[int | None] = [None] * len(lines)
    rows: list[tuple] = []
    births: list[list] = []
    there = [False] * len(lines)
    old = [_unpack(x) for x in state["lines"]] if state else []
    number = {line.number: j for j, line in enumerate(lines)}
    found = compare_file(old, lines) if state else []
    if not state and event["committed"] is not None:
        for d in compare_file(normalize(event["committed"], event["language"]), lines):
            if d[2] != "dead":
                there[number[d[6]]] = True
    elif not state and event["tool_name"] not in (None, "Write"):
        there = [True] * len(lines)
    for k, d in enumerate(found):
        if d[2] != "dead":
            ids[number[d[6]]] = state["ids"][k]
    for j, line in enumerate(lines):
        if ids[j] is None:
            ids[j] = xxhash.xxh3_64_intdigest(f"{key}/{made}") >> 1
            made += 1
            agent = not there[j]
            births.append([ids[j], _pack(line)])
            rows.append((key, now, event["seq"], "birth", ids[j], line.number, None, None, None, None, None, None, "agent" if agent else "human", event["session_id"] if agent else None, agent))
    first = {k: _unpack(x) for k, x in (state["births"] if state else [])}
    seen = min(state["at"], now) if state else None
    for k, d in enumerate(found):
        line_id = state["ids"][k]
        if d[2] == "verbatim":
            continue
        j = number.get(d[6]) if d[2] != "dead" else None
        candidate = ids[number[d[8]]] if d[2] == "dead" and d[8] is not None else None
        rows.append((key, now, event["seq"], "fate", line_id, None if j is None else lines[j].number, d[2], d[3], d[4], candidate, None if j is None else dice(first[line_id], lines[j]), seen, None, None, None))
    held = set(ids)
    kept = [[k, x] for k, x in (state["births"] if state else []) if k in held] + births
    return {"at": now, "made": made, "ids": ids, "lines": [_pack(x) for x in lines], "births": kept}, rows


def prepared(events: DataFrame) -> DataFrame:
    """Events on tracked paths, with language and file_path_hash; a payload that names no path or content is left out."""
    return events.withColumn("language", text.tracked_language(F.col("path"))).withColumn("file_path_hash", text.path_hash(F.col("path"))).where("language is not null and content is not null")


def replay(events: DataFrame) -> DataFrame:
    """OUT rows of all events, each file's in order of (at, seq)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, rows = None, []
        for event in pdf.sort_values(["at", "seq"]).to_dict("records"):
            state, more = step(state, _clean(event))
            rows += more
        return _frame(rows)

    return prepared(events).groupBy("file_path_hash").applyInPandas(run, OUT)


def record(events: DataFrame) -> DataFrame:
    """The streaming twin of replay: append mode, state kept for each file. Late events follow the state that they find."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else None
        rows: list[tuple] = []
        for event in pd.concat(list(batches)).sort_values(["at", "seq"]).to_dict("records"):
            state, more = step(state, _clean(event))
            rows += more
        if state is not None:
            held.update((json.dumps(state),))
        yield _frame(rows)

    return prepared(events).groupBy("file_path_hash").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def _clean(event: dict) -> dict:
    return {k: None if v is None or v is pd.NaT or isinstance(v, float) and v != v else v for k, v in event.items()}


def _frame(rows: list[tuple]) -> pd.DataFrame:
    ints = {"at": "Int64", "seq": "Int64", "line_id": "Int64", "line_number": "Int32", "candidate_id": "Int64", "previous_seen_at": "Int64"}
    return pd.DataFrame(rows, columns=NAMES).astype(ints | {"birth_observed": "boolean"})


def paired_commands(events: DataFrame, window: str = "24 hours") -> DataFrame:
    """Files that changed between a shell command's start and its end, paired by tool_use_id.

    ``events`` is (tool_use_id, event, at timestamp, head, command, stamps array<struct<path, size, mtime>>). Pairs more than
    ``window`` apart, with a moved head, or whose command restores files from git, give nothing.
    """
    ends = lambda name: events.where(F.col("event") == name).withWatermark("at", window)
    pre = ends("PreToolUse").select("tool_use_id", F.col("at").alias("started"), F.col("head").alias("head_before"), F.col("stamps").alias("before"))
    post = ends("PostToolUse").select(F.col("tool_use_id").alias("id"), F.col("at").alias("ended"), "head", "command", F.col("stamps").alias("after"))
    joined = pre.join(post, (F.col("tool_use_id") == F.col("id")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"interval {window}")))
    ok = joined.where(F.col("head").eqNullSafe(F.col("head_before")) & ~text.restores_from_git(F.coalesce("command", F.lit(""))))
    changed = F.filter("after", lambda x: ~F.exists("before", lambda y: (y["path"] == x["path"]) & (y["size"] == x["size"]) & (y["mtime"] == x["mtime"])))
    return ok.select("tool_use_id", "ended", F.explode(changed).alias("x")).select("tool_use_id", F.col("ended").alias("at"), F.col("x.path").alias("path"))
