"""N-gram Jaccard join: prefix-tree join over globally ordered n-gram sets.

Two documents link when their sets of n-word shingles have a Jaccard similarity of at least ``percent`` / 100. Sets that
are equal are one node. The global order puts shingles seen once in their block of text before all others, and goes by hash
within both: any order gives the same links, this one keeps shared passages out of the prefixes. Of a pair that links, both
sets hold a common shingle among their first ``n - ceil(n * percent / 100) + 1``, so those postings alone are brought together.

1. Postings of one shingle form a star round their least node. Stars whose centres recur are verified: this joins large
   groups of near copies by one check a member instead of one a pair.
2. Of each shingle whose postings still lie in different components, what its nodes hold behind it (shingles that others
   share too, in the global order) stands in a prefix tree. Nodes that are neighbours there are verified first, one pair for
   a posting; what links is joined, so near copies that differ from their star's centre need no check of each with each.
3. Where components still meet, each node walks the tree: a common beginning's overlap is counted once for all below it,
   and a subtree is left as soon as the remaining lengths can't reach the overlap that is needed. A pair becomes a row where
   its walk comes to its end, at the first shingle that both hold, as far as some shingles before show it.

A pair found is looked at through sketches first (counts of shingles in buckets bound the overlap from above); what they
leave is verified on the whole sets. The sets to be compared with one node stand in a prefix tree again: their sorted order
with the lengths of common beginnings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bits, Folder, Words, flat, mix, pieces, release, word_table
from .components import components

NGRAM = 5
PERCENT = 80
#: Bytes of text in which shingles are counted before others see them, and bytes taken apart at once.
BLOCK_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
#: A shingle that so many sets of one block of text hold has its postings dealt over several groups; those beyond the most
#: frequent MOST_HOT are not. Which ones only affects speed.
HOT = 64
MOST_HOT = 100_000
#: Postings of one shingle in a group; further ones make further groups.
GROUP = 4096
#: Shingles behind a shared one that its tree holds; what stands behind those counts as common until verified.
DEPTH = 12
#: Shingles before a shared one that tell whether a pair was met already.
BEFORE = 6
#: Postings of each node that give neighbours, and neighbours on one side.
NEAR = 8
SIDE = 12
#: Pairs of a node and a part of a tree that are walked at once.
WALK = 200_000
#: Nodes verified against one node in one group.
CHUNK = 64
IS_WORD = np.array([not (x == 32 or 9 <= x <= 13) for x in range(256)])
TABLE = word_table(IS_WORD)


def _factors(n: int) -> list[np.uint64]:
    return [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1) for k in range(n)]


def sets_of(column: pa.Array, ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, first): the distinct shingles of each text in ascending order; text d has those from first[d] on.

    Fewer words than ``ngram`` are one shingle, the whole sequence; without words there is none.
    """
    raw, offsets = flat(column)
    words = Words(raw, offsets, TABLE)
    h, first, n = words.hashes, words.first, len(words.first) - 1
    counts = np.diff(first)
    factors = _factors(ngram)
    own = np.maximum(counts - ngram + 1, 0)
    doc = np.repeat(np.arange(n), own)
    at = np.arange(len(doc)) + np.repeat(first[:-1] - (np.cumsum(own) - own), own)
    grams = np.zeros(len(at), dtype=np.uint64)
    for k in range(ngram):
        grams += h[at + k] * factors[k]
    few = np.flatnonzero((counts > 0) & (counts < ngram))
    short = np.array([int(sum(int(x) * int(f) for x, f in zip(h[first[d] : first[d + 1]], factors, strict=False)) + int(counts[d])) & (2**64 - 1) for d in few], dtype=np.uint64)
    grams, doc = mix(np.concatenate((grams, short))), np.concatenate((doc, few))
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    keep = np.ones(len(grams), dtype=bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[keep], doc[keep]
    return grams, np.searchsorted(doc, np.arange(n + 1))


def nodes_of(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number for each set; equal sets have the same."""
    one = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(grams))))
    two = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(grams * np.uint64(0xD6E8FEB86659FD93)))))
    size = np.diff(first).astype(np.uint64)
    return mix((one[first[1:]] - one[first[:-1]]) * np.uint64(0x9E3779B97F4A7C15) ^ mix(two[first[1:]] - two[first[:-1]] + size)).view(np.int64)


def sketches_of(grams: np.ndarray, first: np.ndarray) -> pa.Array:
    """For each set the number of its shingles in each of some buckets, a byte each; 255 stands for that many or more."""
    n = np.diff(first)
    buckets = np.where(n > 0, 1 << np.clip(np.ceil(np.log2(np.maximum(n, 1) / 2)), 4, 12).astype(np.int64), 0)
    base = np.concatenate(([0], np.cumsum(buckets)))
    at = np.repeat(base[:-1], n) + (grams & np.repeat(buckets - 1, n).astype(np.uint64)).astype(np.int64)
    counts = np.minimum(np.bincount(at, minlength=int(base[-1])), 255).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(base.astype(np.int32).tobytes()), pa.py_buffer(counts.tobytes())])


def overlap_bound(x: bytes, y: bytes) -> int:
    """No fewer than the shingles that two sets of these sketches have in common."""
    a, b = (np.frombuffer(s, dtype=np.uint8) for s in sorted((x, y), key=len))
    if not len(a):
        return 0
    if a.max() == 255 or b.max() == 255:
        return 1 << 62
    return int(np.minimum(a, b.reshape(-1, len(a)).sum(axis=0)).sum())


def needed(na, nb, percent: int):
    """Least overlap of two sets of these sizes that link: overlap >= (na + nb) * p / (100 + p), in whole numbers."""
    return -(-(na + nb) * percent // (100 + percent))


def _survey(docs: DataFrame, ngram: int) -> DataFrame:
    """Rows of two kinds: (doc_id, node, n, sketch) of every document, and (gram, seen) of shingles in several sets of a block."""
    schema = docs.select("doc_id").schema
    for name, kind in (("node", "long"), ("n", "long"), ("sketch", "binary"), ("gram", "long"), ("seen", "long")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BLOCK_BYTES):
            held, seen = [], set()
            for part in pieces(iter([batch]), "text", PIECE_BYTES):
                grams, first = sets_of(part.column(1), ngram)
                nodes, n = nodes_of(grams, first), np.diff(first)
                k = len(nodes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes), pa.array(n, pa.int64()), sketches_of(grams, first), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=schema.names)
                fresh = np.array([x not in seen and not seen.add(x) for x in nodes.tolist()], dtype=bool)
                held.append(grams[np.repeat(fresh, n)])
            found, times = np.unique(np.concatenate(held), return_counts=True)
            found, times = found[times > 1], times[times > 1]
            del held
            for i in range(0, len(found), 100_000):
                part, count = found[i : i + 100_000], times[i : i + 100_000]
                k = len(part)
                yield pa.RecordBatch.from_arrays([pa.nulls(k, batch.schema.field(0).type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(part.view(np.int64)), pa.array(count, pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


def _postings(docs: DataFrame, shared: str, hot: dict[int, int], ngram: int, percent: int) -> DataFrame:
    """(gram, salt, node, n, pos, split): the prefix of each set in the global order; a set once for each run of text."""
    hot_grams = np.array(sorted(hot), dtype=np.int64)
    hot_parts = np.array([hot[x] for x in sorted(hot)], dtype=np.int64)
    many = docs.sparkSession.sparkContext.broadcast((hot_grams, hot_parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, parts = many.value
        seen: set[int] = set()
        for batch in pieces(batches, "text", PIECE_BYTES):
            grams, first = sets_of(batch.column(0), ngram)
            nodes, n = nodes_of(grams, first), np.diff(first)
            if len(seen) > 200_000:
                seen.clear()
            fresh = np.array([x not in seen and not seen.add(x) for x in nodes.tolist()], dtype=bool) & (n > 0)
            doc = np.repeat(np.arange(len(n)), n)
            # from here on a shingle is a number whose first bit is its class, so numbers go by the global order
            code = grams >> np.uint64(1) | Bits.has(shared, grams).astype(np.uint64) << np.uint64(63)
            order = np.lexsort((code, doc))
            pos = np.arange(len(grams)) - np.repeat(first[:-1], n)
            keep = (pos < np.repeat(prefix_length(n, percent), n)) & np.repeat(fresh, n)
            take, own, pos = grams[order[keep]].view(np.int64), nodes[doc[keep]], pos[keep]
            groups = np.ones(len(take), dtype=np.int64)
            if len(top):
                at = np.minimum(np.searchsorted(top, take), len(top) - 1)
                groups = np.where(top[at] == take, parts[at], 1)
            take = code[order[keep]].view(np.int64)
            salt = np.where(groups > 1, (mix(own.view(np.uint64)) % groups.astype(np.uint64)).astype(np.int64), 0)
            yield pa.RecordBatch.from_arrays([pa.array(take), pa.array(salt.astype(np.int32)), pa.array(own), pa.array(n[doc[keep]].astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(groups > 1)], names=["gram", "salt", "node", "n", "pos", "split"])

    return docs.select("text").mapInArrow(run, "gram long, salt int, node long, n int, pos int, split boolean")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int = 100_000) -> Iterator[pa.Table]:
    """Sorted rows, cut only between groups."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= rows:
            # the last group of what is held may go on: cut before it, or where the new batch begins another
            change = np.zeros(held[-1].num_rows + 1, dtype=bool)
            for key in keys:
                own = np.concatenate((held[-1].column(key).to_numpy(), batch.column(key)[:1].to_numpy()))
                change[1:] |= own[1:] != own[:-1]
            cut = np.flatnonzero(change)
            if len(cut):
                end = int(cut[-1])
                yield pa.Table.from_batches([*held[:-1], held[-1].slice(0, end)])
                held = [held[-1].slice(end)] if end < held[-1].num_rows else []
                size = sum(x.num_rows for x in held)
        held.append(batch)
        size += batch.num_rows
    if size:
        yield pa.Table.from_batches(held)


def _columns(table: pa.Table, *names: str) -> dict[str, np.ndarray]:
    return {name: table.column(name).to_numpy() for name in names or table.schema.names}


def _stars(postings: DataFrame) -> DataFrame:
    """Rows of three kinds from each group of postings with two nodes or more.

    kind 0: (node, other = least node of the group, count of such groups in this task); kind 1: the posting itself;
    kind 2: the group's least node, where a shingle has several groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ("gram", "salt")):
            g = _columns(table)
            # sorted by gram, salt and node: drop repeats of a node
            fresh = np.ones(len(g["gram"]), dtype=bool)
            fresh[1:] = (g["gram"][1:] != g["gram"][:-1]) | (g["salt"][1:] != g["salt"][:-1]) | (g["node"][1:] != g["node"][:-1])
            g = {k: v[fresh] for k, v in g.items()}
            begins = np.ones(len(g["gram"]), dtype=bool)
            begins[1:] = (g["gram"][1:] != g["gram"][:-1]) | (g["salt"][1:] != g["salt"][:-1])
            start = np.flatnonzero(begins)
            size = np.diff(np.append(start, len(begins)))
            centre = np.repeat(g["node"][start], size)
            n_centre = np.repeat(g["n"][start], size)
            shared = (np.repeat(size, size) > 1) | g["split"].astype(bool)
            star = shared & (g["node"] != centre) & (10 * np.minimum(g["n"], n_centre) >= 7 * np.maximum(g["n"], n_centre))
            pairs, times = np.unique(np.stack((g["node"][star], centre[star], np.minimum(g["n"], n_centre)[star])), axis=1, return_counts=True)
            head = begins & g["split"].astype(bool)
            parts = (
                (0, pairs[0], pairs[1], pairs[2], times, np.zeros(len(times)), np.zeros(len(times))),
                (1, g["node"][shared], g["node"][shared], g["n"][shared], g["pos"][shared], g["gram"][shared], g["salt"][shared]),
                (2, g["node"][head], g["node"][head], g["n"][head], g["pos"][head], g["gram"][head], g["salt"][head]),
            )
            for kind, *values in parts:
                if len(values[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values[0]), kind, dtype=np.int32)), *[pa.array(np.asarray(v).astype(np.int64)) for v in values]], names=["kind", "node", "other", "n", "count", "gram", "salt"])

    # most postings stand alone, so their bytes are what the join shuffles: what is mostly zero stands together
    place = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("place")
    packed = postings.select("salt", "split", "gram", "node", place).repartition("gram", "salt").sortWithinPartitions("gram", "salt", "node")
    dealt = packed.select("gram", "salt", "node", F.shiftright("place", 32).cast("int").alias("n"), F.col("place").bitwiseAND(0x7FFFFFFF).cast("int").alias("pos"), "split")
    return dealt.mapInArrow(run, "kind int, node long, other long, n long, count long, gram long, salt long")


def tree_overlaps(probe: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Overlap of each set with ``probe`` where they link, else -1. All sets are in ascending order without repeats.

    The sets stand in a prefix tree: in sorted order, with what each begins in common with the one before. The overlap of
    a common beginning is found once; a beginning from which no set can link any more ends the walk of all sets below it.
    """
    out = [-1] * len(sets)
    order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
    before = np.empty(0, dtype=np.uint64)
    within = np.zeros(1, dtype=np.int64)  # overlap of the first d members of the set before, for each d
    dead = -1  # depth of the beginning of the set before at which the walk ended, or -1
    need_before = remaining = 0
    for k in order:
        own = sets[k]
        need = needed(len(own), len(probe), percent)
        m = min(len(own), len(before))
        differ = np.flatnonzero(own[:m] != before[:m])
        common = int(differ[0]) if len(differ) else m
        if dead >= 0 and common >= dead and need >= need_before and len(own) - dead <= remaining:
            continue
        if min(len(own), len(probe)) < need:
            continue
        depth = min(common, len(within) - 1)
        tail = own[depth:]
        at = np.minimum(np.searchsorted(probe, tail), max(len(probe) - 1, 0))
        hit = probe[at] == tail if len(probe) else np.zeros(len(tail), dtype=bool)
        within = np.concatenate((within[: depth + 1], within[depth] + np.cumsum(hit)))
        left = np.minimum(len(own) - np.arange(len(own) + 1), len(probe) - np.concatenate(([0], np.searchsorted(probe, own, side="right"))))
        short = np.flatnonzero(within + left < need)
        before, need_before = own, need
        if len(short):
            dead = int(short[0])
            remaining = len(own) - dead
        else:
            dead = -1
            out[k] = int(within[-1])
    return out


def trie_neighbours(gram: np.ndarray, tokens: np.ndarray, n: np.ndarray, rest: np.ndarray, pos: np.ndarray, label: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different labels that stand near each other in their gram's prefix tree and may link."""
    order = np.lexsort((n, *tokens.T[::-1], gram))
    steps = range(1, min(SIDE, len(order) - 1) + 1)
    p = np.concatenate([order[k:] for k in steps] or [order[:0]])
    q = np.concatenate([order[:-k] for k in steps] or [order[:0]])
    keep = (gram[p] == gram[q]) & (label[p] != label[q]) & (100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q]))
    p, q = p[keep], q[keep]
    count = 1 + ((tokens[p][:, :, None] == tokens[q][:, None, :]) & (tokens[p] != 0)[:, :, None]).any(axis=2).sum(axis=1)
    keep = _may_link(n, rest, pos, p, q, count + np.maximum(np.maximum(rest[p], rest[q]) - tokens.shape[1], 0), percent)
    return p[keep], q[keep]


def _may_link(n: np.ndarray, rest: np.ndarray, pos: np.ndarray, p: np.ndarray, q: np.ndarray, upper: np.ndarray, percent: int) -> np.ndarray:
    """Whether ``upper`` common shingles of the prefixes, and all that can be common behind them, are enough."""
    beyond = lambda x: -(-x * percent // 100) - 1
    # one of the two prefixes ends first; beyond its end, and beyond the other's shingle, all may be common
    left = np.maximum(np.minimum(beyond(n[p]), n[q] - pos[q] - 1), np.minimum(n[p] - pos[p] - 1, beyond(n[q])))
    return np.minimum(upper, 1 + np.minimum(rest[p], rest[q])) + left >= needed(n[p], n[q], percent)


def trie_pairs(gram: np.ndarray, tokens: np.ndarray, before: np.ndarray, n: np.ndarray, rest: np.ndarray, pos: np.ndarray, label: np.ndarray, node: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one gram and different labels that may link, by a walk of every row down its gram's prefix tree.

    tokens: what each row holds behind the gram, in the global order (of unsigned numbers), 0 beyond its end; rest: how many such there are, also
    those not in ``tokens``; before: the last that it holds before the gram, 0 where there is none; pos: the gram's place in
    the whole set, of n. A pair that links is found at the first gram that both hold; at later ones it may be left out.
    """
    none = np.empty(0, dtype=np.int64)
    if not len(gram):
        return none, none
    depth = tokens.shape[1]
    size = np.floor(np.log(n) / np.log(1.08)).astype(np.int64)
    order = np.lexsort((*tokens.T[::-1], size, gram))
    gram, tokens, before, n, rest, pos, label, node, size = (x[order] for x in (gram, tokens, before, n, rest, pos, label, node, size))
    k = len(gram)
    change = np.ones(k, dtype=bool)
    change[1:] = gram[1:] != gram[:-1]
    group = np.cumsum(change) - 1
    change[1:] |= size[1:] != size[:-1]
    # the tree's parts of each depth are runs of rows
    starts = [np.flatnonzero(change)]
    for d in range(depth):
        change[1:] |= tokens[1:, d] != tokens[:-1, d]
        starts.append(np.flatnonzero(change))
    low = [np.minimum.reduceat(n, s) for s in starts]
    high = [np.maximum.reduceat(n, s) for s in starts]
    more = [np.maximum.reduceat(np.maximum(rest - d, 0), s) for d, s in enumerate(starts)]
    below = [np.append(np.searchsorted(starts[d + 1], starts[d]), len(starts[d + 1])) for d in range(depth)]
    beyond = lambda x: -(-x * percent // 100) - 1  # noqa: E731  what stands behind a prefix

    def reach(p: np.ndarray, lo: np.ndarray, hi: np.ndarray, upper: np.ndarray) -> np.ndarray:
        # one of the two prefixes ends first; beyond its end, and beyond the other's shingle, all may be common
        left = np.maximum(np.minimum(beyond(n[p]), hi - 1), np.minimum(n[p] - pos[p] - 1, beyond(hi)))
        return (upper + left >= needed(n[p], lo, percent)) & (100 * hi >= percent * n[p]) & (lo <= n[p])

    def spread(p: np.ndarray, first: np.ndarray, last: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
        times = last - first
        at = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(p, times), at, *(np.repeat(x, times) for x in more)

    seen_to = np.where(rest > depth, tokens[:, -1].view(np.uint64), np.uint64(2**64 - 1))
    first_class = np.searchsorted(group[starts[0]], group)
    last_class = np.searchsorted(group[starts[0]], group, side="right")
    size_of_group = np.bincount(group)[group]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    budget = np.cumsum(size_of_group) // WALK
    for lo_row, hi_row in zip(c := np.append(np.flatnonzero(np.diff(budget, prepend=-1)), k).tolist(), c[1:], strict=False):
        p, v, count = spread(np.arange(lo_row, hi_row), first_class[lo_row:hi_row], last_class[lo_row:hi_row], np.ones(hi_row - lo_row, dtype=np.int64))
        for d in range(depth + 1):
            keep = reach(p, low[d][v], high[d][v], np.minimum(1 + rest[p], count + more[d][v]))
            p, v, count = p[keep], v[keep], count[keep]
            if d == depth or not len(p):
                break
            p, v, count = spread(p, below[d][v], below[d][v + 1], count)
            t = tokens[starts[d + 1][v], d]
            # what comes behind all that is held of a row may be in the rest of it
            count += ((tokens[p] == t[:, None]).any(axis=1) | (t.view(np.uint64) > seen_to[p])) & (t != 0)
        if not len(p):
            continue
        ends = np.append(starts[depth][1:], k)
        p, q, count = spread(p, starts[depth][v], ends[v], count)
        keep = (label[p] != label[q]) & (100 * n[q] >= percent * n[p]) & _may_link(n, rest, pos, p, q, count + np.maximum(rest[q] - depth, 0), percent)
        keep &= (n[q] < n[p]) | (n[q] == n[p]) & (node[q] < node[p])
        p, q = p[keep], q[keep]
        keep = ~((before[p][:, :, None] == before[q][:, None, :]) & (before[p] != 0)[:, :, None]).any(axis=(1, 2))
        found.append((p[keep], q[keep]))
    if not found:
        return none, none
    return order[np.concatenate([x for x, _ in found])], order[np.concatenate([x for _, x in found])]


def _behind(mixed: DataFrame) -> DataFrame:
    """Of each posting (gram, node, n, pos, label, size): what its node holds behind and before it, and the group's parts."""
    seq = F.sort_array(F.collect_list(F.struct("pos", "gram", "size")))
    by_node = mixed.groupBy("node").agg(F.first("n").alias("n"), F.first("label").alias("label"), seq.alias("seq"))
    rows = by_node.select("node", "n", "label", F.transform("seq", lambda x: x["gram"]).alias("grams"), F.posexplode("seq").alias("k", "x"))
    before = F.slice("grams", F.greatest(F.lit(1), F.col("k") - BEFORE + 1), F.least(F.col("k"), F.lit(BEFORE)))
    return rows.select("node", "n", "label", "k", F.col("x.gram").alias("gram"), F.col("x.pos").alias("pos"), (F.size("grams") - F.col("k") - 1).alias("rest"), F.slice("grams", F.col("k") + 2, DEPTH).alias("tokens"), before.alias("before"), F.ceil(F.col("x.size") / GROUP).cast("int").alias("parts"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    held = column.combine_chunks()
    out = np.zeros((len(held), width), dtype=np.int64)
    out[np.arange(width) < held.value_lengths().to_numpy().astype(np.int64)[:, None]] = held.flatten().to_numpy()
    return out


def _pair_batch(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    pairs = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b))), axis=1)
    if pairs.shape[1]:
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _neighbours(mixed: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that stand side by side in a tree, from (gram, node, n, pos, label, size).

    A group of many postings is cut into parts: which neighbours are tried is a matter of speed.
    """
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    rows = _behind(mixed).where(F.col("k") < NEAR).select("node", "n", "label", "gram", "pos", "rest", "tokens", part.alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ("gram", "part"), 20_000):
            g = _columns(table, "gram", "node", "n", "label", "pos", "rest")
            a, b = trie_neighbours(g["gram"], _matrix(table.column("tokens"), DEPTH), *(g[x].astype(np.int64) for x in ("n", "rest", "pos", "label")), percent)
            yield from _pair_batch(g["node"][a], g["node"][b])

    return rows.repartition("gram", "part").sortWithinPartitions("gram", "part").mapInArrow(run, "a long, b long").distinct()


def _crossing(mixed: DataFrame, percent: int) -> DataFrame:
    """(a, b) whose nodes lie in different components and that the trees leave, from (gram, node, n, pos, label, size)."""
    # a shingle with too many postings has its groups in twos: any two nodes meet in one
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    blocks = F.when(F.col("parts") <= 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.least(own, q) * F.col("parts") + F.greatest(own, q)))
    rows = _behind(mixed).withColumn("part", F.explode(blocks)).drop("parts", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ("gram", "part"), 20_000):
            g = _columns(table, "gram", "part", "node", "n", "label", "pos", "rest")
            begins = np.ones(len(g["gram"]), dtype=np.int64)
            begins[1:] = (g["gram"][1:] != g["gram"][:-1]) | (g["part"][1:] != g["part"][:-1])
            a, b = trie_pairs(np.cumsum(begins), _matrix(table.column("tokens"), DEPTH), _matrix(table.column("before"), BEFORE), *(g[x].astype(np.int64) for x in ("n", "rest", "pos", "label", "node")), percent)
            yield from _pair_batch(g["node"][a], g["node"][b])

    return rows.repartition("gram", "part").sortWithinPartitions("gram", "part").mapInArrow(run, "a long, b long").distinct()


def _verified(folder: Folder, name: str, pairs: DataFrame, docs: DataFrame, own: DataFrame, classes: DataFrame, ngram: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link. Any number of pairs may have the same b: they are verified in several groups."""
    nodes = lambda held: held.select(F.col("a").alias("node")).unionByName(held.select(F.col("b").alias("node"))).distinct()
    pairs = folder.write(f"{name}-pairs", pairs)
    sketch = own.join(nodes(pairs), "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("n").alias("n"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, x, y = (batch.column(c).to_pylist() for c in ("na", "nb", "x", "y"))
            keep = [min(p, q) >= (need := needed(p, q, percent)) and overlap_bound(s, t) >= need for p, q, s, t in zip(na, nb, x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sketch.select(F.col("node").alias("a"), F.col("sketch").alias("x"), F.col("n").alias("na"))
    two = sketch.select(F.col("node").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("nb"))
    left = folder.write(f"{name}-left", pairs.join(one, "a").join(two, "b").mapInArrow(bound, "a long, b long"))
    # only the texts of the nodes that are left move: the others stop where they are read
    wanted = folder.write(f"{name}-wanted", classes.join(nodes(left), "node", "left_semi").select("node", F.xxhash64("doc_id").alias("hash")))
    bits = Bits.write(wanted.select("hash"), folder, f"{name}-wanted")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(Bits.has(bits, batch.column(0).to_numpy())))
            for part in pieces(iter([batch]), "text", PIECE_BYTES):
                grams, first = sets_of(part.column(1), ngram)
                raw = grams.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(nodes_of(grams, first)), pa.array([raw[8 * i : 8 * j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())], names=["node", "grams"])

    sets = docs.select(F.xxhash64("doc_id").alias("hash"), "text").mapInArrow(read, "node long, grams binary")
    sets = folder.write(f"{name}-sets", sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    # few enough sets of a group to fit: a group is (b, chunk), and a chunk of a large b is cut by its number of pairs
    size = left.groupBy("b").agg(F.count(F.lit(1)).alias("size"))
    dealt = folder.write(f"{name}-dealt", left.join(size, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("size") / CHUNK)).alias("chunk")))
    members = dealt.join(sets.select(F.col("node").alias("a"), "grams"), "a").select("b", "chunk", F.lit(1).alias("kind"), "a", "grams")
    probes = dealt.select("b", "chunk").distinct().join(sets.select(F.col("node").alias("b"), "grams"), "b").select("b", "chunk", F.lit(0).alias("kind"), F.col("b").alias("a"), "grams")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ("b", "chunk"), 2_000):
            b, chunk, kind, a, raw = (table.column(c).to_pylist() for c in ("b", "chunk", "kind", "a", "grams"))
            begins = [i for i in range(len(b)) if not i or (b[i], chunk[i]) != (b[i - 1], chunk[i - 1])]
            found = []
            for i, j in zip(begins, [*begins[1:], len(b)], strict=True):
                held = [np.frombuffer(x, dtype=np.uint64) for x in raw[i:j]]
                found += [(a[k], b[i]) for k, o in zip(range(i + 1, j), tree_overlaps(held[0], held[1:], percent), strict=True) if o >= 0]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    met = members.unionByName(probes).repartition("b", "chunk").sortWithinPartitions("b", "chunk", "kind", "a")
    links = folder.write(f"{name}-links", met.mapInArrow(check, "a long, b long"))
    folder.drop(*(f"{name}-{x}" for x in ("pairs", "left", "wanted", "sets", "dealt")))
    return links


def join(docs: DataFrame, *, ngram: int = NGRAM, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id): the size of each document's set and the least doc_id that it reaches by links.

    A document without words or with a null text has an empty set and links with nothing. Equal sets link. Repeated rows
    give repeated rows. A document with a null id takes part; its component_id is the least id of its component, or null
    if there is none.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    folder = Folder(spark, "jaccard")
    survey = folder.write("survey", _survey(docs, ngram))
    several = survey.where("gram is not null").select("gram", "seen")
    shared = Bits.write(several.select("gram"), folder, "shared")
    counted = several.where(F.col("seen") >= HOT).groupBy("gram").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "gram").limit(MOST_HOT)
    hot = {r["gram"]: -(-r["seen"] // GROUP) for r in counted.where(F.col("seen") > GROUP).collect()}
    own = survey.where("node is not null").select("doc_id", "node", "n", "sketch")
    classes = own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    stars = folder.write("stars", _stars(_postings(docs, shared, hot, ngram, percent)))
    release(spark)
    # stars: centres of the groups of one shingle have a star of their own
    centres = stars.where("kind = 2").select("gram", "node", "n").distinct()
    top = centres.groupBy("gram").agg(F.min(F.struct("node", "n")).alias("top"))
    higher = centres.join(top, "gram").where("node != top.node").select("node", F.col("top.node").alias("other"), F.least("n", "top.n").alias("n"), F.lit(1).cast("long").alias("count"))
    stars_0 = stars.where("kind = 0").select("node", "other", "n", "count").unionByName(higher)
    # which star pairs are tried is a matter of speed: those that share a quarter of a prefix
    tried = stars_0.groupBy("node", "other").agg(F.sum("count").alias("count"), F.max("n").alias("n")).where(F.col("count") * 100 >= F.col("n") * (100 - percent) / 4)
    links = _verified(folder, "near", tried.select(F.col("node").alias("a"), F.col("other").alias("b")), docs, own, classes, ngram, percent)
    release(spark)
    postings = stars.where("kind = 1").select("gram", "node", "n", F.col("count").alias("pos"))

    def meeting(held: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """The postings of shingles that nodes of several components hold. Others stop where they are read, but for a few."""
        placed = held.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
        placed = folder.write(f"{name}-placed", placed.select("gram", "node", "n", "pos", "label"))
        several = placed.groupBy("gram").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("size")).where("x != y").select("gram", "size")
        several = folder.write(f"{name}-several", several)
        bits = Bits.write(several.select("gram"), folder, f"{name}-several")

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(Bits.has(bits, batch.column(0).to_numpy())))

        mixed = folder.write(f"{name}-mixed", placed.mapInArrow(some, placed.schema).join(several, "gram"))
        folder.drop(f"{name}-placed", f"{name}-several")
        return mixed

    mixed = meeting(postings, links, "beside")
    links = links.unionByName(_verified(folder, "beside", _neighbours(mixed, percent), docs, own, classes, ngram, percent))
    release(spark)
    # further links only join components: what met in one before meets in one still
    more = _verified(folder, "far", _crossing(meeting(mixed.select("gram", "node", "n", "pos"), links, "far"), percent), docs, own, classes, ngram, percent)
    folder.drop("beside-mixed", "far-mixed", "stars")
    release(spark)
    final = components(links.unionByName(more))
    rooted = classes.join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = rooted.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = rooted.join(least, "label").select("node", "component_id")
    joined = own.drop("sketch").join(found, "node", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
