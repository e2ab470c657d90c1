"""Exact top-k inner-product search over a pivot-distance index.

Every vector is keyed by its nearest pivot and the distance to it; a cell's vectors are kept in order of that distance and
cut into annuli. A query takes annuli outward from its own distance to each pivot and leaves those that the triangle
inequality rules out: a member of an annulus [r0, r1] is at least max(0, d - r1, r0 - d) from a query at distance d.

Inner products become distances by one more component, sqrt(M^2 - |x|^2), that gives all vectors the length M of the
longest: then ip(q, x) = (|q|^2 + M^2 - dist(q, x)^2) / 2. Bounds carry a margin for rounding; scores are whole numbers.

Vectors are stored with their norm's class: a third of all vectors may be equal, so cells are cut into blocks of bounded
size, and a block is the unit that tasks hold in memory.
"""

from __future__ import annotations

import io
import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialized, scratch, state

#: Vectors that pivots are picked from, and pivots, at most.
SAMPLE = 4096
PIVOTS = 64
#: Vectors of one annulus.
ANNULUS = 256
#: Vectors of a block of the index, and queries of a block: what a task holds at once.
BLOCK = 16_384
QUERIES = 2_048
SCALE = 256
#: Stands for no score.
LEAST = -(2**62)


def whole(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<double> of whole numbers): floor(scale * component). Vectors that are null, empty or hold null or
    non-finite components, and rows without an id, are left out."""
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    kept = vectors.where(F.col(key).isNotNull() & (F.size(embedding) > 0) & finite)
    return kept.select(F.col(key).cast("long").alias("vec_id"), F.transform(embedding, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _scores(rows: np.ndarray, queries: np.ndarray, exact: bool) -> np.ndarray:
    """Whole-number inner products (rows x queries)."""
    if exact:
        return np.rint(rows @ queries.T).astype(np.int64)
    return rows.astype(np.int64) @ queries.astype(np.int64).T


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate((x, np.sqrt(np.maximum(most * most - (x * x).sum(axis=1), 0.0))[:, None]), axis=1)


def _pivots(sample: np.ndarray, most: float, n: int) -> np.ndarray:
    """Rows of the sample far from one another: each next one is the farthest from those taken."""
    lifted = _lifted(sample, most)
    taken = [0]
    gap = np.linalg.norm(lifted - lifted[0], axis=1)
    while len(taken) < min(n, len(sample)) and gap.max() > 0:
        taken.append(int(np.argmax(gap)))
        gap = np.minimum(gap, np.linalg.norm(lifted - lifted[taken[-1]], axis=1))
    return lifted[taken]


def build(vectors: DataFrame, folder: str, width: int, *, sample: int = SAMPLE, pivots: int = PIVOTS) -> tuple[DataFrame, str]:
    """(index, path of the pivots): index rows (cell int, vec_id, r double, x), written to the shared folder.

    Pivots are taken from the ``sample`` vectors of least hash; every vector is indexed.
    """
    some = vectors.select("vec_id", "x").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().combine_chunks()
    rows = _matrix(some.column("x").chunk(0), width) if len(some) else np.zeros((0, width))
    most = vectors.agg(F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).first()[0]
    most = float(np.sqrt(most or 0.0))
    own = _pivots(rows, most, pivots) if len(rows) else np.zeros((0, width + 1))
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    out = io.BytesIO()
    np.savez(out, pivots=own, most=np.array([most]), sample=rows, ids=some.column("vec_id").to_numpy())
    with fs.open_output_stream(posixpath.join(base, "pivots.npz")) as f:
        f.write(out.getvalue())
    path = posixpath.join(folder, "pivots.npz")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _load(path)
        for batch in batches:
            if batch.num_rows:
                lifted = _lifted(_matrix(batch.column(1), width), float(held["most"][0]))
                apart = np.maximum((lifted**2).sum(axis=1)[:, None] - 2 * lifted @ held["pivots"].T + (held["pivots"] ** 2).sum(axis=1), 0.0)
                cell = apart.argmin(axis=1)
                r = np.linalg.norm(lifted - held["pivots"][cell], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), pa.array(r), batch.column(1)], names=["cell", "vec_id", "r", "x"])

    index = vectors.select("vec_id", "x").mapInArrow(run, "cell int, vec_id long, r double, x array<double>")
    return materialized(index, "index"), path


def _load(path: str) -> dict[str, np.ndarray]:
    own = state("topk_search")
    if path not in own:
        while len(own) > 3:
            own.pop(next(iter(own)))
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        with fs.open_input_file(at) as f:
            held = np.load(io.BytesIO(f.read()))
            own[path] = {name: held[name] for name in held.files}
    return own[path]


class Best:
    """The k best (score, smaller id first) of each query."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.scores = np.full((n, k), LEAST)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: (queries, rows); rows not taken have the least number."""
        if scores.shape[1] > 4 * self.k:
            # candidates: everything not below the k-th score of the block, so that ties stay
            floor = np.partition(scores, -self.k, axis=1)[:, -self.k]
            keep = (scores >= np.maximum(floor, self.scores[queries, -1])[:, None]).any(axis=0)
            scores, ids = scores[:, keep], ids[keep]
        if not scores.shape[1]:
            return
        both = np.concatenate((self.scores[queries], scores), axis=1)
        names = np.concatenate((self.ids[queries], np.broadcast_to(ids, scores.shape)), axis=1)
        order = np.lexsort((names, -both), axis=1)[:, : self.k]
        self.scores[queries] = np.take_along_axis(both, order, axis=1)
        self.ids[queries] = np.take_along_axis(names, order, axis=1)


def _search_block(best: Best, own_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, cell: np.ndarray, r: np.ndarray, rows: np.ndarray, pivots: np.ndarray, most: float, exact: bool) -> int:
    """Take the annuli of one block outward for all queries; return how many (query, vector) pairs were scored."""
    least = LEAST
    order = np.lexsort((r, cell))
    ids, cell, r, rows = ids[order], cell[order], r[order], rows[order]
    edge = np.flatnonzero(np.diff(cell)) + 1
    bounds = [(lo + k, min(lo + k + ANNULUS, hi)) for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(cell)], strict=True) for k in range(0, hi - lo, ANNULUS)]
    lifted = np.concatenate((queries, np.zeros((len(queries), 1))), axis=1)
    square = (queries**2).sum(axis=1)
    apart = np.sqrt(np.maximum(square[:, None] - 2 * lifted @ pivots.T + (pivots**2).sum(axis=1), 0.0))
    lows = np.array([[cell[a], r[a], r[b - 1]] for a, b in bounds])
    at = apart[:, lows[:, 0].astype(int)]
    gap = np.maximum(0.0, np.maximum(lows[:, 1] - at, at - lows[:, 2]))
    slack = 1e-6 * (1.0 + most + np.sqrt(square))[:, None]
    ceiling = (square[:, None] + most * most - np.maximum(gap - slack, 0.0) ** 2) / 2 + 1.0
    scored = 0
    for k in np.argsort(gap.min(axis=0), kind="stable").tolist():
        live = np.flatnonzero(ceiling[:, k] >= best.scores[:, -1])
        if not len(live):
            continue
        a, b = bounds[k]
        found = _scores(rows[a:b], queries[live], exact).T
        found[own_ids[live][:, None] == ids[a:b]] = least
        scored += found.size
        best.add(live, found, ids[a:b])
    return scored


def search(index: DataFrame, queries: DataFrame, path: str, width: int, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of the index for each query (vec_id, x), ties to the smaller vec_id.

    A query's own vec_id is no candidate; fewer candidates than k give fewer rows. Queries are taken in blocks of bounded
    size from the shared folder, one file a block; each task of the index reads them one after the other, so neither
    queries nor index must fit anywhere, and no pair of a query and a vector is ever a row.
    """
    folder = scratch(index.sparkSession, "queries")
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    names: list[str] = []
    held: list[tuple[int, list[float]]] = []

    def flush() -> None:
        out = io.BytesIO()
        np.savez(out, ids=np.array([x for x, _ in held], dtype=np.int64), x=np.array([x for _, x in held]).reshape(-1, width))
        with fs.open_output_stream(posixpath.join(base, f"{len(names)}.npz")) as f:
            f.write(out.getvalue())
        names.append(posixpath.join(folder, f"{len(names)}.npz"))
        held.clear()

    for row in queries.select("vec_id", "x").toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == QUERIES:
            flush()
    if held:
        flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _load(path)
        pivots, most = own["pivots"], float(own["most"][0])
        rows: list[pa.RecordBatch] = []

        def block() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rows).combine_chunks()
            ids, cell, r = (table.column(c).to_numpy() for c in ("vec_id", "cell", "r"))
            x = _matrix(table.column("x").chunk(0), width)
            exact = most * most < 2**50
            for number, name in enumerate(names):
                q = _load(name)
                best = Best(len(q["ids"]), k)
                if len(own["sample"]):
                    # a floor for each query: its k-th best among the sample of distinct ids; what is below it can't count
                    fresh = np.unique(own["ids"], return_index=True)[1]
                    seen = _scores(own["sample"][fresh][:512], q["x"], exact).T
                    seen[q["ids"][:, None] == own["ids"][fresh][:512]] = LEAST
                    floor = np.partition(seen, -k, axis=1)[:, -k] if seen.shape[1] >= k else np.full(len(seen), LEAST)
                    best.scores[:] = np.where(floor > LEAST, floor - 1, floor)[:, None]
                _search_block(best, q["ids"], q["x"], ids, cell, r, x, pivots, most, exact)
                at, place = np.nonzero((best.ids < np.iinfo(np.int64).max) & (best.scores > LEAST))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(q["ids"][at]), pa.array(best.ids[at, place]), pa.array(best.scores[at, place])], names=["block", "place", "query_id", "vec_id", "score"])

        size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                rows.append(part)
                size += part.num_rows
                if size >= BLOCK:
                    yield from block()
                    rows, size = [], 0
        if rows:
            yield from block()

    found = index.select("cell", "vec_id", "r", "x").mapInArrow(run, "block int, place int, query_id long, vec_id long, score long")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k)
    # k rows for each query and task; groups of tasks are merged first, so no list grows with the index
    query = ("block", "place", "query_id")
    part = found.withColumn("part", F.spark_partition_id() % 64).groupBy(*query, "part").agg(best.alias("best"))
    part = part.select(*query, F.explode("best").alias("hit")).select(*query, F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))
    merged = part.groupBy(*query).agg(best.alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))


def top_k(vectors: DataFrame, *, every: int = 50, k: int = 5, key: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``; candidates are all rows. Repeated rows are candidates, and
    queries, as often as they occur. All vectors must have one length."""
    x = whole(vectors, key, embedding, scale)
    first = x.select(F.size("x").alias("n")).first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index, path = build(x, scratch(vectors.sparkSession, "pivots"), first["n"])
    return search(index, index.where(F.col("vec_id") % every == 0), path, first["n"], k)
