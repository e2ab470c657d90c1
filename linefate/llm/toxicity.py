"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features: densities of a given lexicon and of one learned from the sample, how near second-person words stand to lexicon
words, capitals, punctuation and obfuscation rates. The trees are grown here on a bounded sample of labelled rows; the
isotonic step, fitted on rows that the trees haven't seen, turns their sum into a probability under the labels' own share.
"""

from __future__ import annotations

import pickle
import posixpath
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, held_out, pieces, scratch, state, texts

#: Labelled rows of each label that are learned from at most; texts of more characters are not learned from (they are scored).
LEARN_ROWS = 1500
LEARN_TEXT_CHARS = 20_000
#: Words of the learned lexicon at most, and documents that must hold one.
LEARNED_WORDS = 400
LEARNED_LEAST = 3
#: Beginnings of words, of these lengths, are entries too: they stand for a word with any ending.
BEGINNINGS = (4, 5, 6, 7)
#: Mild general insults and threats; a parameter, not fixed values.
LEXICON = ("idiot", "stupid", "moron", "loser", "pathetic", "clown", "dumb", "fool", "trash", "garbage", "scum", "worthless", "disgusting", "hate", "kill", "die", "ugly", "shut", "creep", "jerk", "liar", "coward", "freak", "vermin", "imbecile", "filth", "useless", "crap", "hell", "damn")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "youre", "tu", "te", "toi", "ton", "du", "dich", "dir", "dein", "usted", "ustedes", "vous")
#: Look-alikes that obfuscated words are read back through.
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")
NEAR = 6
KEPT_PIECES = 300_000
KEPT_LENGTH = 48
LETTERS = re.compile(r"[^\W\d_]+")
REPEATED = re.compile(r"([^\W\d_])\1{2,}")
LEX, LEARNED, SECOND, CAPS, HIDDEN, MIXED, LONG = (1 << k for k in range(7))
NAMES = ("log_pieces", "lexicon", "lexicon_count", "learned", "learned_count", "weight_sum", "weight_mean", "weight_most", "second", "near", "least_gap", "caps_words", "hidden", "mixed", "long", "capitals", "exclaim", "question", "other_marks", "digits", "beyond_ascii")


def plain(piece: str) -> str:
    """The piece's letters, lower-cased, look-alikes read back and repeats cut."""
    return REPEATED.sub(r"\1\1", "".join(LETTERS.findall(piece.lower().translate(LOOKALIKE))))


def entries(word: str) -> list[str]:
    """What the learned lexicon may hold of a word: itself, and its beginnings marked by a star."""
    return [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) >= n]]


class Features:
    """Dense features of whole texts. Flags of a piece between white space are found once and kept, in bounded number."""

    def __init__(self, learned: dict[str, float], lexicon: tuple[str, ...] = LEXICON) -> None:
        self.learned, self.lexicon, self.second = learned, frozenset(lexicon), frozenset(SECOND_PERSON)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flags = np.zeros(1024, dtype=np.int64)
        self.weights = np.zeros(1024)

    def _flag(self, piece: str) -> tuple[int, float]:
        words = LETTERS.findall(piece.lower())
        simple = words[0] if len(words) == 1 else ""
        whole = plain(piece)
        flag = LEX * any(w in self.lexicon for w in words) | SECOND * any(w in self.second for w in words)
        hidden = whole != simple and (whole in self.lexicon or whole in self.learned)
        flag |= HIDDEN * hidden | (LEX * (whole in self.lexicon) if hidden else 0)
        weight = max([self.learned.get(e, 0.0) for w in words for e in entries(w)] + [self.learned.get(whole, 0.0) if hidden else 0.0])
        flag |= LEARNED * (weight > 0)
        flag |= CAPS * (len(piece) > 2 and piece.isupper())
        flag |= MIXED * (any(c.isalpha() for c in piece) and any(not c.isalnum() for c in piece.strip(".,;:!?()\"'«»¿¡")) or any(c.isdigit() for c in piece) and any(c.isalpha() for c in piece))
        flag |= LONG * bool(REPEATED.search(piece))
        return flag, weight

    def _ids(self, split: list[str]) -> list[int]:
        known = self.known
        ids = list(map(known.get, split))
        if None in ids:
            # pieces too long to keep get numbers behind those of all that are kept, for this text alone
            own: dict[str, int] = {}
            for k, i in enumerate(ids):
                if i is None:
                    piece = split[k]
                    i = known.get(piece)
                    if i is None and len(piece) <= KEPT_LENGTH:
                        i = known[piece] = len(known)
                        self._put(i, piece)
                    ids[k] = -1 if i is None else i
            for k, i in enumerate(ids):
                if i == -1:
                    if split[k] not in own:
                        own[split[k]] = len(known) + len(own)
                        self._put(own[split[k]], split[k])
                    ids[k] = own[split[k]]
        return ids

    def _put(self, i: int, piece: str) -> None:
        if i >= len(self.flags):
            self.flags = np.concatenate((self.flags, np.zeros_like(self.flags)))
            self.weights = np.concatenate((self.weights, np.zeros_like(self.weights)))
        self.flags[i], self.weights[i] = self._flag(piece)

    def __call__(self, column: pa.Array) -> np.ndarray:
        """(texts, features)."""
        raw, offsets = flat(column)
        sums = []
        for span in ((65, 91), (33, 34), (63, 64), None, (48, 58), (128, 256)):
            mask = MARK[raw] if span is None else (raw >= span[0]) & (raw < span[1])
            total = np.concatenate(([0], np.cumsum(mask)))
            sums.append(total[offsets[1:]] - total[offsets[:-1]])
        size = np.maximum(np.diff(offsets), 1)
        out = np.zeros((len(size), len(NAMES)))
        for d, text in enumerate(texts(column)):
            ids = self._ids(text.split())
            n = max(1, len(ids))
            flags, weights = self.flags[ids], self.weights[ids]
            lex = (flags & (LEX | LEARNED)) > 0
            at, you = np.flatnonzero(lex), np.flatnonzero(flags & SECOND)
            near, gap = 0, 50
            if len(at) and len(you):
                right = np.searchsorted(you, at)
                gaps = np.minimum(np.abs(at - you[np.minimum(right, len(you) - 1)]), np.abs(at - you[np.maximum(right - 1, 0)]))
                near, gap = int((gaps <= NEAR).sum()), min(50, int(gaps.min()))
            count = [int(((flags & f) > 0).sum()) for f in (LEX, LEARNED, SECOND, CAPS, HIDDEN, MIXED, LONG)]
            total = float(weights.sum())
            out[d, :15] = (np.log1p(len(ids)), count[0] / n, count[0], count[1] / n, count[1], total, total / n, weights.max() if len(ids) else 0, count[2] / n, near / n, gap, count[3] / n, count[4] / n, count[5] / n, count[6] / n)
            if len(self.known) > KEPT_PIECES:
                self.clear()
        out[:, 15:] = np.stack(sums, axis=1) / size[:, None]
        return out


MARK = np.array([33 < x < 128 and not chr(x).isalnum() and chr(x) not in "!?.,;:'\"-()" for x in range(256)])


class Trees:
    """Gradient-boosted trees for the logistic loss, over histograms of the features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 8.0, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        if not len(x):
            x = np.zeros((1, x.shape[1]))
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1)[: len(y)]
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
        self.start = float(np.log(share / (1 - share)))
        self.trees: list[list[tuple[int, int, float]]] = []
        total = np.full(len(y), self.start)
        for _ in range(self.rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-total))
            tree, leaf = self._grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            total += np.array([t[2] for t in tree])[leaf]
        return self

    def _grow(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[list[tuple[int, int, float]], np.ndarray]:
        """Nodes (feature or -1, cut, value) in heap order, and the leaf of each row."""
        nodes = [(-1, 0, 0.0)] * (2 ** (self.depth + 1))
        at = np.ones(len(grad), dtype=np.int64)
        for node in range(1, 2 ** (self.depth + 1)):
            rows = np.flatnonzero(at == node)
            g, h = grad[rows].sum(), hess[rows].sum()
            nodes[node] = (-1, 0, float(-self.rate * g / (h + self.ridge)))
            if node >= 2**self.depth or h < 2 * self.least / 4 or not len(rows):
                continue
            best = (1e-6, -1, 0)
            for f, cuts in enumerate(self.cuts):
                if not len(cuts):
                    continue
                gs = np.cumsum(np.bincount(binned[rows, f], weights=grad[rows], minlength=len(cuts) + 1))[:-1]
                hs = np.cumsum(np.bincount(binned[rows, f], weights=hess[rows], minlength=len(cuts) + 1))[:-1]
                gain = gs**2 / (hs + self.ridge) + (g - gs) ** 2 / (h - hs + self.ridge) - g**2 / (h + self.ridge)
                gain[(hs < self.least / 4) | (h - hs < self.least / 4)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            if best[1] >= 0:
                nodes[node] = (best[1], best[2], nodes[node][2])
                at[rows] = 2 * node + (binned[rows, best[1]] > best[2])
        return nodes, at

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for tree in self.trees:
            feature = np.array([t[0] for t in tree])
            cut = np.array([self.cuts[t[0]][t[1]] if t[0] >= 0 else 0.0 for t in tree])
            value = np.array([t[2] for t in tree])
            at = np.ones(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
                at = np.where(f >= 0, 2 * at + right, at)
            total += value[at]
        return total


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on margin by pooling adjacent violators."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # weight, mean, margin sum
    for m, v, w in zip(margin[order], y[order], weight[order], strict=True):
        blocks.append([w, v, w * m])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, m2 = blocks.pop()
            w1, v1, m1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), m1 + m2]
    return np.array([m / w for w, _, m in blocks]), np.array([v for _, v, _ in blocks])


class Model:
    def __init__(self, learned: dict[str, float]) -> None:
        self.learned = learned
        self.features = Features(learned)

    def score(self, column: pa.Array) -> np.ndarray:
        margin = self.trees.margin(self.features(column))
        if not len(self.knots):
            return np.full(len(margin), self.share)
        return np.clip(np.interp(margin, self.knots, self.values), 0.0, 1.0)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "features"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.features = Features(self.learned)


def _held(text: str) -> set[str]:
    """Lexicon entries that a text has."""
    return {e for w in set(LETTERS.findall(text.lower())) for e in entries(w)} | {plain(p) for p in set(text.split()) if not p.isalpha()}


def learned_lexicon(texts: list[str], y: np.ndarray) -> dict[str, float]:
    """Log-odds of the words, and beginnings of words, that toxic texts hold clearly more often than others.

    Toxic texts are counted first; of the others only what is frequent there, so few counts are held at once.
    """
    n = {label: int((y == label).sum()) for label in (0, 1)}
    bad: Counter[str] = Counter()
    for text, v in zip(texts, y, strict=True):
        if v == 1:
            bad.update(_held(text))
    frequent = {w: k for w, k in bad.items() if k >= max(LEARNED_LEAST, n[1] // 80) and len(w) > 1}
    del bad
    other: Counter[str] = Counter()
    for text, v in zip(texts, y, strict=True):
        if v == 0:
            other.update(_held(text).intersection(frequent))
    odds: dict[str, float] = {}
    for w, k in frequent.items():
        value = float(np.log((k + 0.5) / (n[1] + 1)) - np.log((other[w] + 0.5) / (n[0] + 1)))
        if value > 1.5 and value > 2.5 * np.sqrt(1 / (k + 0.5) + 1 / (other[w] + 0.5)):
            odds[w] = value
    return dict(sorted(odds.items(), key=lambda x: (-x[1], x[0]))[:LEARNED_WORDS])


def learn(sample: list[tuple[str, int]], totals: dict[int, int]) -> Model:
    """A model from (text, 0 or 1) and the number of training rows of each label.

    A text's features must not come from a lexicon that it helped to learn, nor its margin for the isotonic fit from trees
    that saw it. So both are learned on either half of the sample for the other; the final lexicon and trees are learned on
    all of it.
    """
    sample = list(dict.fromkeys(sample))
    y = np.array([label for _, label in sample], dtype=float)
    halves = [np.arange(len(sample)) % 2 == k for k in (0, 1)]
    content = [text for text, _ in sample]
    model = Model(learned_lexicon(content, y))
    model.share = totals.get(1, 0) / max(1, sum(totals.values()))
    model.trees, model.knots, model.values = Trees(), np.empty(0), np.empty(0)
    if any(len(set(y[h].tolist())) < 2 for h in halves):
        model.trees.fit(np.zeros((0, len(NAMES))), np.zeros(0))
        return model
    x = np.zeros((len(sample), len(NAMES)))
    for own, other in (halves, halves[::-1]):
        lexicon = learned_lexicon([t for t, use in zip(content, other, strict=True) if use], y[other])
        x[own] = Features(lexicon)(pa.array([t for t, use in zip(content, own, strict=True) if use], pa.string()))
    margin = np.zeros(len(sample))
    for own, other in (halves, halves[::-1]):
        margin[own] = Trees().fit(x[other], y[other]).margin(x[own])
    model.trees.fit(x, y)
    weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    model.knots, model.values = isotonic(margin, y, weight)
    return model


def fit(docs: DataFrame, labels: DataFrame, folder: str) -> str:
    """Learn from labelled documents that aren't held out; write the model into the shared folder and return its path.

    The sample has one row of each label for each of LEARN_ROWS values of a hash, of texts of at most LEARN_TEXT_CHARS.
    Labels other than 0 and 1, and rows without a text, are not learned from.
    """
    order = F.xxhash64("doc_id", F.lit(7))
    marked = labels.where(~held_out("doc_id") & F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic")).withColumn("slot", F.pmod(F.xxhash64("labelled"), F.lit(LEARN_ROWS)))
    totals = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # the ids of the sample are few: two labels, LEARN_ROWS slots, so the documents are read once against a small table
    ids = marked.groupBy("toxic", "slot").agg(F.min_by("labelled", F.xxhash64("labelled", F.lit(3))).alias("labelled"))
    rows = docs.where(F.length("text") <= LEARN_TEXT_CHARS).join(F.broadcast(ids), F.col("doc_id") == F.col("labelled"))
    sample = [(r["text"], r["toxic"]) for r in rows.select("doc_id", "text", "toxic").orderBy(order, "doc_id", "text").limit(2 * LEARN_ROWS).collect()]
    model = learn(sample, totals)
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(posixpath.join(base, "toxicity.pkl")) as f:
        f.write(pickle.dumps(model))
    return posixpath.join(folder, "toxicity.pkl")


def _load(path: str) -> Model:
    own = state("toxicity")
    if path not in own:
        own.clear()
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        with fs.open_input_file(at) as f:
            own[path] = pickle.loads(f.read())
    return own[path]


def score(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; null and empty texts are scored as texts without pieces."""
    schema = docs.select("doc_id").schema.add("held_out", "boolean").add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _load(model)
        for batch in pieces(batches, "text", 4 << 20):
            found = own.score(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """fit and score over one table."""
    return score(docs, fit(docs, labels, scratch(docs.sparkSession, "toxicity")))
