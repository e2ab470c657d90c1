"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Training words are streamed through the automaton, which tracks the longest match that ends at each word. Where that
reaches the length of a window, the window's words are hit. Words between two that no item holds are streamed side by
side: a run of known words is cut into segments, each led by the words of one window less one, so that match lengths up to
a window are exact in every segment.

Normalisation: A-Z lower-cased; words are runs of digits, letters a-z and all characters beyond ASCII.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PairMap, Words, flat, pieces, scratch, state, word_table

WINDOW = 13
#: A document is contaminated when hits are at least one of so many of its words.
COVERAGE = 20
#: Words of items in one automaton; more items make several, each read from the shared folder when it is needed.
AUTOMATON_WORDS = 200_000
SEGMENT = 256
IS_WORD = np.array([x >= 128 or chr(x).isalnum() for x in range(256)])
TABLE = word_table(IS_WORD)


class Automaton:
    """Generalised suffix automaton over word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW) -> None:
        """items: (id, word hashes); an item without words has no window."""
        self.window = window
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.empty(0, dtype=np.uint64)
        self.names = [name for name, _ in items]
        steps: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        words = [np.searchsorted(self.vocabulary, h).tolist() for _, h in items]
        for sequence in words:
            last = 0
            for x in sequence:
                last = self._extend(steps, link, length, last, x)
        self.link, self.length = np.array(link), np.array(length)
        a, b, c = zip(*[(s, x, t) for s, out in enumerate(steps) for x, t in out.items()], strict=True) if len(steps) > 1 else ((), (), ())
        self.steps = PairMap(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), np.array(c, dtype=np.int64))
        # of each state, the state of its matches' last `window` words, or -1
        order = np.argsort(self.length, kind="stable").tolist()
        at_window, shorter = [-1] * len(link), [()] * len(link)
        ends: dict[int, int] = {}  # state of a whole short item -> its words
        for sequence in words:
            if 0 < len(sequence) < window:
                s = 0
                for x in sequence:
                    s = steps[s][x]
                ends[s] = len(sequence)
        for s in order[1:]:
            p = link[s]
            at_window[s] = at_window[p] if length[p] >= window else s if length[s] >= window else -1
            shorter[s] = shorter[p] + (((s, ends[s]),) if s in ends else ())
        self.at_window = np.array(at_window)
        #: of states on whose chain whole short items end: (state, words) of each
        self.shorter = {s: x for s, x in enumerate(shorter) if x}
        self.has_shorter = np.array([bool(x) for x in shorter])
        items_of: dict[int, set[int]] = {}
        for k, sequence in enumerate(words):
            s = 0
            run = 0
            for i, x in enumerate(sequence):
                # walk the item itself; every step is a match
                while s and x not in steps[s]:
                    s, run = link[s], min(run, length[link[s]])
                s, run = steps[s][x], run + 1
                run = i + 1
                if run >= window:
                    while length[link[s]] >= window:
                        s = link[s]
                    items_of.setdefault(s, set()).add(k)
                elif run == len(sequence):
                    items_of.setdefault(s, set()).add(k)
        self.items_of = {s: tuple(sorted(x)) for s, x in items_of.items()}
        self.least = min([window, *ends.values()])

    @staticmethod
    def _extend(steps: list[dict[int, int]], link: list[int], length: list[int], last: int, x: int) -> int:
        if x in steps[last]:
            q = steps[last][x]
            if length[q] == length[last] + 1:
                return q
            return Automaton._split(steps, link, length, last, q, x)
        new = len(link)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and x not in steps[p]:
            steps[p][x] = new
            p = link[p]
        if p != -1:
            q = steps[p][x]
            link[new] = q if length[q] == length[p] + 1 else Automaton._split(steps, link, length, p, q, x)
        return new

    @staticmethod
    def _split(steps: list[dict[int, int]], link: list[int], length: list[int], p: int, q: int, x: int) -> int:
        twin = len(link)
        steps.append(dict(steps[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = twin
        while p != -1 and steps[p].get(x) == q:
            steps[p][x] = twin
            p = link[p]
        return twin

    def stream(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, match length up to at least the window) at every word of many texts; first: as in Words."""
        n = len(hashes)
        state, matched = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        if not n or not len(self.vocabulary):
            return state, matched
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        word = np.where(self.vocabulary[at] == hashes, at, -1)
        known = np.zeros(n + 2, dtype=np.int8)
        known[1:-1] = word >= 0
        step = np.diff(known)
        begins, ends = step == 1, step == -1
        cut = first[(first > 0) & (first < n)]
        cut = cut[(word[cut - 1] >= 0) & (word[cut] >= 0)]
        begins[cut] = ends[cut] = True
        runs, stops = np.flatnonzero(begins), np.flatnonzero(ends)
        keep = stops - runs >= self.least
        runs, stops = runs[keep], stops[keep]
        if not len(runs):
            return state, matched
        # segments: (read from, count from, to)
        pieces_of = -(-(stops - runs) // SEGMENT)
        k = np.arange(pieces_of.sum()) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)
        count_from = np.repeat(runs, pieces_of) + k * SEGMENT
        to = np.minimum(count_from + SEGMENT, np.repeat(stops, pieces_of))
        read_from = np.maximum(np.repeat(runs, pieces_of), count_from - (self.window - 1))
        order = np.argsort(read_from - to, kind="stable")
        count_from, to, read_from = count_from[order], to[order], read_from[order]
        s, m = np.zeros(len(to), dtype=np.int64), np.zeros(len(to), dtype=np.int64)
        sizes = to - read_from
        for t in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -t, side="left"))
            pos = read_from[:live] + t
            x = word[pos]
            at = np.arange(live)
            while len(at):
                nxt = self.steps.get(s[at], x[at])
                hit = nxt >= 0
                done = at[hit]
                s[done] = nxt[hit]
                m[done] += 1
                at = at[~hit]
                root = at[s[at] == 0]
                m[root] = 0
                at = at[s[at] != 0]
                s[at] = self.link[s[at]]
                m[at] = self.length[s[at]]
            own = pos >= count_from[:live]
            state[pos[own]], matched[pos[own]] = s[:live][own], m[:live][own]
        return state, matched

    def hits(self, words: Words) -> tuple[np.ndarray, list[set[str]]]:
        """(hit flag of every word, ids of the items with occurring windows for every text)."""
        n, texts_n = len(words.hashes), len(words.first) - 1
        state, matched = self.stream(words.hashes, words.first)
        mark = np.zeros(n + 1, dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        ends = np.flatnonzero(matched >= self.window)
        np.add.at(mark, ends + 1 - self.window, 1)
        np.add.at(mark, ends + 1, -1)
        found.append((ends, self.at_window[state[ends]]))
        if self.shorter:
            near = np.flatnonzero((matched > 0) & self.has_shorter[state])
            for i, s, m in zip(near.tolist(), state[near].tolist(), matched[near].tolist(), strict=True):
                for short, size in self.shorter[s]:
                    if size <= m:
                        mark[i + 1 - size] += 1
                        mark[i + 1] -= 1
                        found.append((np.array([i]), np.array([short])))
        items: list[set[str]] = [set() for _ in range(texts_n)]
        at, states = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        doc = np.searchsorted(words.first, at, side="right") - 1
        for d, s in np.unique(np.stack([doc, states]), axis=1).T.tolist():
            items[d].update(self.names[k] for k in self.items_of.get(s, ()))
        return np.cumsum(mark[:-1]) > 0, items


def build(items: DataFrame, folder: str, *, window: int = WINDOW, text: str = "text", key: str = "item_id", limit: int = AUTOMATON_WORDS) -> list[str]:
    """Write automata of ``limit`` words or a single item each into the shared folder; return their paths.

    Items are streamed to the driver, one automaton's words at a time. Null texts and texts without words have no windows; a null
    id counts as the empty string.
    """
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    made: list[str] = []
    held: list[tuple[str, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        out = io.BytesIO()
        names, hashes = [n for n, _ in held], [h for _, h in held]
        np.savez(out, names=np.array(names, dtype=str), sizes=np.array([len(h) for h in hashes]), hashes=np.concatenate(hashes))
        with fs.open_output_stream(posixpath.join(base, f"items-{len(made)}.npz")) as f:
            f.write(out.getvalue())
        made.append(posixpath.join(folder, f"items-{len(made)}.npz"))
        held, size = [], 0

    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text)).where(F.col(text).isNotNull()).dropDuplicates()
    for name, content in rows.toLocalIterator():
        raw = np.frombuffer(content.encode(), dtype=np.uint8)
        hashes = Words(raw, np.array([0, len(raw)]), TABLE).hashes
        if not len(hashes):
            continue
        if held and size + len(hashes) > limit:
            flush()
        held.append((name, hashes))
        size += len(hashes)
    if held:
        flush()
    return made


def _load(path: str, window: int) -> Automaton:
    """The automaton of one file; a worker keeps the last two."""
    own = state("decontaminate")
    if path not in own:
        while len(own) > 1:
            own.pop(next(iter(own)))
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        with fs.open_input_file(at) as f:
            held = np.load(io.BytesIO(f.read()))
        cuts = np.cumsum(held["sizes"])[:-1]
        own[path] = Automaton(list(zip(held["names"].tolist(), np.split(held["hashes"], cuts), strict=True)), window)
    return own[path]


def _scan(batches: Iterator[pa.RecordBatch], paths: list[str], window: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Words, np.ndarray, list[set[str]]]]:
    """(batch, bytes, words, hit flags, items of each text)."""
    for batch in pieces(batches, "text", 4 << 20):
        raw, offsets = flat(batch.column(batch.schema.get_field_index("text")))
        words = Words(raw, offsets, TABLE)
        hit, items = np.zeros(len(words.hashes), dtype=bool), [set() for _ in range(batch.num_rows)]
        for path in paths:
            more, named = _load(path, window).hits(words)
            hit |= more
            for own, new in zip(items, named, strict=True):
                own |= new
        yield batch, raw, words, hit, items


def _per_text(words: Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.concatenate(([0], np.cumsum(hit)))
    return np.diff(words.first), total[words.first[1:]] - total[words.first[:-1]]


def measure(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, coverage: int = COVERAGE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of every whole text.

    A null or empty text has no words and is not contaminated. With no items nothing is hit. Repeated rows give repeated rows.
    """
    paths = build(items, scratch(docs.sparkSession, "items"), window=window)
    schema = docs.select(key).schema
    for name, kind in (("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, words, hit, named in _scan(batches, paths, window):
            n_words, n_hit = _per_text(words, hit)
            digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in named]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in named], pa.int64()), pa.array(digests), pa.array((n_hit > 0) & (coverage * n_hit >= n_words))],
                names=schema.names,
            )

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, schema)


def clean(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, coverage: int = COVERAGE, span_words: int | None = None, drop: bool = False) -> DataFrame:
    """``docs`` (column text, and any others) without what the benchmark holds; the columns stay as they are.

    A document over the coverage limit is contaminated. With ``drop`` it goes; else its hit spans are cut out of its text.
    With ``span_words``, hit spans of at least so many words are cut out of the other documents too. All else is left
    alone, to the byte; a null text stays null.
    """
    paths = build(items, scratch(docs.sparkSession, "items"), window=window)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, words, hit, _ in _scan(batches, paths, window):
            n_words, n_hit = _per_text(words, hit)
            over = (n_hit > 0) & (coverage * n_hit >= n_words)
            at = batch.schema.get_field_index("text")
            content = batch.column(at).to_pylist()
            for d in np.flatnonzero(n_hit > 0).tolist():
                if over[d] and drop or not over[d] and span_words is None:
                    continue
                lo, hi = int(words.first[d]), int(words.first[d + 1])
                flags = np.diff(np.concatenate(([0], hit[lo:hi].astype(np.int8), [0])))
                begin = int(words.starts[lo])
                # bytes of this text: from its own encoding, as word offsets count from the batch's first text
                whole = content[d].encode()
                lead = begin - _first_word(whole)
                kept, done = [], 0
                for a, b in zip((lo + np.flatnonzero(flags == 1)).tolist(), (lo + np.flatnonzero(flags == -1)).tolist(), strict=True):
                    if over[d] or b - a >= span_words:
                        kept.append(whole[done : int(words.starts[a]) - lead])
                        done = int(words.ends[b - 1]) - lead
                kept.append(whole[done:])
                content[d] = b"".join(kept).decode()
            out = batch.set_column(at, batch.schema.field(at), pa.array(content, batch.schema.field(at).type))
            yield out.filter(pa.array(~over)) if drop else out

    return docs.mapInArrow(run, schema)


def _first_word(raw: bytes) -> int:
    """Offset of the first word's first byte."""
    return int(np.flatnonzero(TABLE[np.frombuffer(raw, dtype=np.uint8)])[0])
