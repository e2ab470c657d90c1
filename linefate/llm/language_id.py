"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text gives the longest match of what follows. A text is parsed into
phrases, each the longest match from where the last one ended (one character where nothing matches); the language whose
automaton needs fewest phrases for a character wins. Text is normalised first: lower case, runs of letters, each between
two spaces, and parsed run by run, so the phrases of a run are found once and kept in a table of bounded size. Runs that are not
in it step through the automata side by side, letter by letter; very long ones by themselves.

Labelled documents are not pure: they quote other languages. The automata are therefore built again without the lines of
the sample that another language's automaton parses in fewer phrases; lines that documents of several languages hold are
left out from the start, and so are substrings that occur less than MIN_COUNT times.
"""

from __future__ import annotations

import io
import posixpath
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PairMap, held_out, pieces, scratch, state, texts

#: Labelled documents of each language that are learned from at most, and characters of each (bounds of the sample).
LEARN_DOCS = 192
LEARN_DOC_CHARS = 4000
#: Characters of each language's automaton at most.
LEARN_CHARS = 120_000
MIN_COUNT = 2
#: Times that lines of another language are left out and the automata built again.
PURIFY = 2
KEPT_RUNS = 200_000
KEPT_LENGTH = 48
#: Pieces that are taken apart at once, runs that step side by side, and letters of a run beyond which it steps alone.
PARSED = 20_000
WALK = 20_000
LONG_RUN = 64
#: Bytes of text that are looked at together.
BATCH_BYTES = 1 << 20
#: Letters alone; signs that count as numbers, such as a half or a Roman eight, are none.
LETTERS = regex.compile(r"\p{L}+")


def automaton(text: str, min_count: int = MIN_COUNT) -> dict[int, int]:
    """Steps of the suffix automaton of ``text``, keyed state << 21 | character, without substrings of fewer occurrences."""
    steps: list[dict[str, int]] = [{}]
    link, length, count = [-1], [0], [0]
    last = 0
    for c in text:
        new = len(link)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        count.append(1)
        p = last
        while p != -1 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p != -1:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(link)
                steps.append(dict(steps[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                count.append(0)
                while p != -1 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    for s in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
        count[link[s]] += count[s]
    return {s << 21 | ord(c): t for s, out in enumerate(steps) if not s or count[s] >= min_count for c, t in out.items() if count[t] >= min_count}


def phrases(run: str, steps: dict[int, int]) -> int:
    """Phrases that the run, between two spaces, is parsed into."""
    codes = [32, *map(ord, run), 32]
    at, n, end = 0, 0, len(codes)
    while at < end:
        state, start = 0, at
        while at < end:
            state = steps.get(state << 21 | codes[at])
            if state is None:
                break
            at += 1
        at += at == start
        n += 1
    return n


def arrays(steps: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(steps.keys(), dtype=np.int64, count=len(steps)), np.fromiter(steps.values(), dtype=np.int64, count=len(steps))


class Walker:
    """Phrase counts of many runs at once, for every automaton: all step through their letters side by side.

    Steps of all automata stand in one table. Where a run has no step on, its phrase ends, and the next one's first step is
    looked up at once, so each letter is one round.
    """

    def __init__(self, automata: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.n = len(automata)
        keys, ends = [x for x, _ in automata], [x for _, x in automata]
        # states are numbered anew, one automaton behind the other, each from its first state on
        held = [np.unique(np.concatenate(([0], k >> 21, e))) for k, e in zip(keys, ends, strict=True)]
        self.roots = np.cumsum([0, *map(len, held)])[:-1].astype(np.int64)
        number = lambda k, x: np.searchsorted(held[k], x) + self.roots[k]
        none = [np.empty(0, dtype=np.int64)]
        chars = np.concatenate(none + [k & (1 << 21) - 1 for k in keys])
        #: Letters that no automaton has are 0.
        self.letters = np.unique(np.append(chars, 32))
        source = np.concatenate(none + [number(k, x >> 21) for k, x in enumerate(keys)])
        target = np.concatenate(none + [number(k, x) for k, x in enumerate(ends)])
        code = np.searchsorted(self.letters, chars) + 1
        self.table = PairMap(source, code, target, room=2)
        self.first = np.repeat(self.roots[:, None], len(self.letters) + 1, axis=1)
        at_root = np.isin(source, self.roots)
        self.first[np.searchsorted(self.roots, source[at_root]), code[at_root]] = target[at_root]

    def coded(self, found: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.letters, found), len(self.letters) - 1)
        return np.where(self.letters[at] == found, at + 1, 0)

    def phrases(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each run, ``sizes`` codes from ``starts`` on, and each automaton the phrases that the run is parsed into."""
        order = np.argsort(-sizes, kind="stable")
        starts, left = starts[order], -sizes[order]
        count = np.zeros((self.n, len(order)), dtype=np.int64)
        state = np.repeat(self.roots[:, None], len(order), axis=1)
        for k in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(left, -k))  # runs of more than k codes
            c = np.broadcast_to(codes[starts[:live] + k], (self.n, live))
            now = state[:, :live]
            at_root = now == self.roots[:, None]
            on = self.table.get(now.ravel(), c.ravel()).reshape(now.shape)
            stop = on < 0
            fresh = np.take_along_axis(self.first, c, axis=1)
            # a phrase ends before this code; what can't begin one is a phrase of its own
            count[:, :live] += stop & ~at_root
            count[:, :live] += stop & (fresh == self.roots[:, None])
            state[:, :live] = np.where(stop, fresh, on)
        count += state != self.roots[:, None]
        out = np.empty_like(count)
        out[:, order] = count
        return out


class CrossParser:
    """Phrase counts of whole texts for every language."""

    def __init__(self, automata: dict[str, dict[int, int] | tuple[np.ndarray, np.ndarray]], kept: int = KEPT_RUNS) -> None:
        self.names = sorted(automata)
        self.automata = [x if isinstance(x := automata[name], tuple) else arrays(x) for name in self.names]
        self.walker = Walker(self.automata)
        self.steps: list[dict[int, int]] = []
        self.letter = np.zeros(0x110000, dtype=np.int8)  # of each character: 1 if it is a letter, -1 if not, 0 before that is known
        self.kept = kept
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.names) + 1), dtype=np.int64)

    def _rows(self, split: list[str]) -> np.ndarray:
        """Of each piece, without white space: phrases for each language, then characters."""
        out = np.zeros((len(split), len(self.names) + 1), dtype=np.int64)
        # a line break on both sides: pieces don't change each other's lower case
        found = np.frombuffer(("\n" + "\n".join(split) + "\n").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = self.letter[found]
        if not kind.all():
            fresh = np.unique(found[kind == 0])
            self.letter[fresh] = [1 if LETTERS.match(chr(x)) else -1 for x in fresh.tolist()]
            kind = self.letter[found]
        inside = kind > 0
        step = np.diff(inside.astype(np.int8))
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + 1  # of each run, with what is on both sides
        codes = self.walker.coded(np.where(inside, found, 32).astype(np.int64))
        owner = np.cumsum(found == 10)[starts] - 1
        sizes = ends - starts + 1
        out[:, -1] = np.bincount(owner, weights=sizes, minlength=len(split))
        short = np.flatnonzero(sizes <= LONG_RUN)
        for i in range(0, len(short), WALK):
            part = short[i : i + WALK]
            for k, n in enumerate(self.walker.phrases(codes, starts[part], sizes[part])):
                out[:, k] += np.bincount(owner[part], weights=n, minlength=len(split)).astype(np.int64)
        for i in np.flatnonzero(sizes > LONG_RUN).tolist():
            self.steps = self.steps or [dict(zip(keys.tolist(), ends.tolist(), strict=True)) for keys, ends in self.automata]
            run = "".join(map(chr, found[starts[i] + 1 : ends[i]].tolist()))
            out[owner[i], :-1] += [phrases(run, steps) for steps in self.steps]
        return out

    def counts(self, batch: list[str]) -> np.ndarray:
        """Of each text: phrases for each language, then characters."""
        split = [text.split() for text in batch]
        known = self.known
        fresh = sorted(set(chain.from_iterable(split)).difference(known), key=len)
        size = len(known)
        # the long ones come last and are forgotten after this batch
        known.update(zip(fresh, range(size, size + len(fresh)), strict=True))
        while len(known) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        for i in range(0, len(fresh), PARSED):
            part = fresh[i : i + PARSED]
            self.table[size + i : size + i + len(part)] = self._rows(part)
        total = np.zeros((len(batch), len(self.names) + 1), dtype=np.int64)
        for k, words in enumerate(split):
            if words:
                total[k] = self.table[list(map(known.__getitem__, words))].sum(axis=0)
        for piece in reversed(fresh):
            if len(piece) <= KEPT_LENGTH:
                break
            del known[piece]
        if len(known) > self.kept:
            self.clear()
        return total

    def predictions(self, batch: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text; ties go to the name that sorts first. score: what the runner-up needs of what both need."""
        return [self._best(total) for total in self.counts(batch)]

    def _best(self, total: np.ndarray) -> tuple[str, float]:
        if not total[-1] or not self.names:
            return "und", 0.0
        order = np.argsort(total[:-1], kind="stable")
        best = int(total[order[0]])
        second = int(total[order[1]]) if len(order) > 1 else int(total[-1])
        return self.names[order[0]], second / max(1, best + second)

    def predict(self, text: str) -> tuple[str, float]:
        return self.predictions([text])[0]


def learn(sample: dict[str, list[str]], chars: int = LEARN_CHARS) -> dict[str, dict[int, int]]:
    """Automata of each language from lists of labelled texts."""

    def normal(lines: list[str]) -> str:
        out, size = [], 0
        for line in lines:
            runs = " ".join(LETTERS.findall(line.lower()))
            if runs:
                out.append(runs)
                size += len(runs) + 1
            if size >= chars:
                break
        return " " + " ".join(out)[:chars] + " "

    lines = {name: list(dict.fromkeys(line for text in found for line in text.split("\n") if line.strip())) for name, found in sample.items()}
    # a line that several languages' documents quote tells nothing
    quoted = Counter(line for own in lines.values() for line in own)
    lines = {name: [line for line in own if quoted[line] == 1] or own for name, own in lines.items()}
    made = {name: automaton(normal(own)) for name, own in lines.items()}
    for _ in range(PURIFY):
        parser = CrossParser(made)
        lines = {name: [line for line, (found, _) in zip(own, parser.predictions(own), strict=True) if found in (name, "und")] or own for name, own in lines.items()}
        made = {name: automaton(normal(own)) for name, own in lines.items()}
    return made


def fit(docs: DataFrame, folder: str, *, text: str = "text", lang: str = "lang", key: str = "doc_id") -> str:
    """Learn from documents that aren't held out and have a label; write the automata into the shared folder.

    The sample is bounded: of each language one document for each of LEARN_DOCS values of a hash, and LEARN_DOC_CHARS
    characters of it; every label is learned. Classification, in contrast, always takes whole texts.
    """
    order = F.xxhash64(key, text)
    rows = docs.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    picked = rows.groupBy(F.col(lang).alias("lang"), F.pmod(order, F.lit(LEARN_DOCS)).alias("slot")).agg(F.min_by(F.substring(F.col(text), 1, LEARN_DOC_CHARS), order).alias("text"))
    sample: dict[str, list[str]] = {}
    for row in picked.orderBy("lang", "slot").collect():
        sample.setdefault(row["lang"], []).append(row["text"])
    automata = learn(sample)
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    out = io.BytesIO()
    names = sorted(automata)
    np.savez(out, names=np.array(names, dtype=str), **{f"{kind}{i}": held for i, x in enumerate(names) for kind, held in zip("kv", arrays(automata[x]), strict=True)})
    with fs.open_output_stream(posixpath.join(base, "languages.npz")) as f:
        f.write(out.getvalue())
    return posixpath.join(folder, "languages.npz")


def _load(path: str) -> CrossParser:
    own = state("language_id")
    if path not in own:
        own.clear()
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        with fs.open_input_file(at) as f:
            held = np.load(io.BytesIO(f.read()))
        own[path] = CrossParser({name: (held[f"k{i}"], held[f"v{i}"]) for i, name in enumerate(held["names"].tolist())})
    return own[path]


def classify(docs: DataFrame, model: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score) of every whole text; ``und`` and 0 where it is null or has no letter."""
    schema = docs.select(key).schema.add("held_out", "boolean").add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _load(model)
        for batch in pieces(batches, "text", BATCH_BYTES):
            found = parser.predictions(texts(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=schema.names)

    return docs.select(F.col(key), held_out(key).alias("held_out"), F.col(text).alias("text")).mapInArrow(run, schema)


def keep(docs: DataFrame, model: str, languages: list[str] | None = None) -> DataFrame:
    """``docs`` with a recognised language, or one of those given; the columns stay as they are."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _load(model)
        for batch in pieces(batches, "text", BATCH_BYTES):
            found = parser.predictions(texts(batch.column(batch.schema.get_field_index("text"))))
            yield batch.filter(pa.array([x != "und" and (languages is None or x in languages) for x, _ in found]))

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """fit and classify over one table."""
    return classify(docs, fit(docs, scratch(docs.sparkSession, "languages")))
