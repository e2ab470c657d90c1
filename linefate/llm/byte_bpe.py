"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The words of a batch are laid out once, each distinct word a chain of symbols. An inverted index leads from a merge rank
(of a token pair) to the positions where that pair stands, over all words. Ranks are replayed in ascending order, each
merge at all its positions at once, and only the two pairs beside a merged one are looked up again. Where a merge can make
a pair of a smaller rank, only the leftmost position of each word is taken at first, so each word gets exactly the merges
that encoding it alone would apply.

A word of more than LONG_WORD bytes is replayed by itself, its pairs in order of rank and place.

Whole texts are then put together from their pieces. Pieces already encoded are kept in a table of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PairMap, pieces, state, texts

#: Pieces that an encoder keeps encoded; the table is emptied when it holds more.
KEPT_PIECES = 300_000
#: Pieces of more characters are encoded but not kept.
KEPT_LENGTH = 48
#: Bytes of text whose new words are replayed together.
BATCH_BYTES = 6 << 20
#: Words of more bytes are replayed one by one.
LONG_WORD = 192


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTable(PairMap):
    """From two token ids to the rank that they merge into."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        found = []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    found.append((a, b, rank))
        a, b, rank = np.array(found, dtype=np.int64).reshape(-1, 3).T
        super().__init__(a, b, rank)
        #: Ranks whose merge can make a pair of a smaller rank.
        self.unordered = set(a[rank < a].tolist()) | set(b[rank < b].tolist())


class ByteBPE:
    """Encoder and decoder over one rank file and one pattern that splits texts into words."""

    def __init__(self, path: str, pattern: str, kept: int = KEPT_PIECES) -> None:
        self.ranks = load_ranks(path)
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.of_decimal = {str(i): token for i, token in enumerate(self.tokens)}
        #: Decimals of all ids, and at -1 what stands between words.
        self.decimals = [*self.of_decimal, ";"]
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.table = PairTable(self.ranks)
        self.find = regex.compile(pattern).findall
        #: Encoded pieces, as decimal ids joined by commas. A key stands for the piece after one space, or, behind a NUL, for itself.
        self.known: dict[str, str] = {}
        self.kept = kept

    def replay(self, words: Iterable[str]) -> dict[str, str]:
        """Decimal ids of each distinct word, joined by commas."""
        out: dict[str, str] = {}
        decimals = self.decimals
        open_words, raws = [], []
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None or not raw:
                out[word] = decimals[whole] if raw else ""
            elif len(raw) > LONG_WORD:
                out[word] = ",".join(map(decimals.__getitem__, self.replay_long(raw)))
            else:
                open_words.append(word)
                raws.append(raw)
        if not raws:
            return out
        sizes = np.array([len(x) for x in raws])
        starts = np.cumsum(sizes + 1) - sizes  # a wall of -1 before each word and after the last
        n = int(sizes.sum() + len(sizes) + 1)
        symbols = np.full(n, -1, dtype=np.int64)
        inside = np.ones(n, dtype=bool)
        inside[starts - 1] = inside[-1] = False
        symbols[inside] = self.byte_ids[np.frombuffer(b"".join(raws), dtype=np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1] = n - 1
        rank_at = np.full(n, -1, dtype=np.int64)  # of the pair that begins here
        rank_at[:-1] = self.table.get(symbols[:-1].copy(), symbols[1:].copy())
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            some = ranks >= 0
            places, ranks = places[some], ranks[some]
            if not len(ranks):
                return
            order = ranks.argsort()
            places, ranks = places[order], ranks[order]
            cuts = [0, *((ranks[1:] != ranks[:-1]).nonzero()[0] + 1).tolist(), len(ranks)]
            for rank, i, j in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
                if rank not in index:
                    heapq.heappush(heap, rank)
                index[rank].append(places[i:j])

        enter(np.arange(n), rank_at)
        while heap:
            rank = heapq.heappop(heap)
            held = index.pop(rank)
            places = np.concatenate(held) if len(held) > 1 else held[0]
            places = places[rank_at[places] == rank]
            if not len(places):
                continue
            places.sort()
            if len(places) > 1:
                # a place may have been entered twice
                fresh = np.ones(len(places), dtype=bool)
                np.not_equal(places[1:], places[:-1], out=fresh[1:])
                places = places[fresh]
            if rank in self.table.unordered or (rank_at[after[places]] == rank).any():
                # the leftmost of each word only: its merge may make a pair that comes before the others of this rank
                word = np.searchsorted(starts, places, side="right")
                first = np.concatenate(([True], word[1:] != word[:-1]))
                if not first.all():
                    enter(places[~first], np.full(int((~first).sum()), rank))
                    places = places[first]
            gone = after[places]
            right = after[gone]
            symbols[places], symbols[gone], rank_at[gone] = rank, -2, -1
            after[places], before[right] = right, places
            at = np.concatenate((before[places], places))
            at = at[symbols[at] >= 0]
            new = self.table.get(symbols[at], symbols[after[at]])
            rank_at[at] = new
            enter(at, new)
        # walls stand between the words
        ids = ",".join(map(decimals.__getitem__, symbols[symbols >= -1].tolist()))
        out.update(zip(open_words, ids[2:-2].split(",;,"), strict=True))
        return out

    def replay_long(self, raw: bytes) -> tuple[int, ...]:
        """Ids of one long word: its pairs wait in order of rank and place, so time grows little faster than the word."""
        ranks, tokens = self.ranks, self.tokens
        symbols: list[int] = self.byte_ids[np.frombuffer(raw, dtype=np.uint8)].tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[tuple[int, int], int] = {}

        def rank(i: int) -> int:
            j = after[i]
            if i < 0 or j >= n:
                return -1
            pair = symbols[i], symbols[j]
            if pair not in known:
                known[pair] = ranks.get(tokens[pair[0]] + tokens[pair[1]], -1)
            return known[pair]

        waiting = [(r, i) for i in range(n) if (r := rank(i)) >= 0]
        heapq.heapify(waiting)
        while waiting:
            r, i = heapq.heappop(waiting)
            if symbols[i] < 0 or rank(i) != r:
                continue
            gone = after[i]
            symbols[i], symbols[gone] = r, -1
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            for at in (before[i], i):
                if at >= 0 and (new := rank(at)) >= 0:
                    heapq.heappush(waiting, (new, at))
        return tuple(x for x in symbols if x >= 0)

    def _cut(self, text: str) -> list[str]:
        """Pieces, as keys of ``known``, at which the pattern cuts in any case.

        A space or a line break between two characters that aren't white space always begins a match, or is one.
        """
        words = text.split()
        if "\0" in text or " ".join(words) != text.replace("\n", " "):
            # the pattern looks past white space here, at either end or two in a row: cut the text itself
            return ["\0" + word for word in self.find(text)]
        if "\n" in text:
            return ("\0" + text.replace("\n", " \0\n \0")).split(" ")
        words[0] = "\0" + words[0]
        return words

    def encode_decimal(self, batch: list[str]) -> Iterator[str]:
        """Decimal ids of each text, joined by commas, by replaying the merges over all words of the batch not yet known."""
        place: dict[str, str] = {}
        # equal pieces become one object
        split = [list(map(place.setdefault, words, words)) for words in (self._cut(text) if text else [] for text in batch)]
        if len(self.known) > self.kept:
            self.known = {}
        known, find = self.known, self.find
        fresh = place.keys() - known.keys()
        del place
        cut: dict[str, list[str]] = {}
        wanted = set()
        for key in fresh:
            words = [as_key(word) for word in find(as_word(key))]
            wanted.update(words)
            if words != [key]:
                cut[key] = words
        wanted.difference_update(known)
        replayed = self.replay(map(as_word, wanted))
        ids = {key: replayed[as_word(key)] for key in wanted}
        del replayed
        whole = {key: ",".join([ids[w] if w in ids else known[w] for w in words]) for key, words in cut.items()}
        ids |= whole
        long = {key: x for key, x in ids.items() if len(key) > KEPT_LENGTH}
        known.update(ids if not long else ((key, x) for key, x in ids.items() if key not in long))
        del ids, whole, cut, fresh, wanted
        for words in split:
            if long:
                yield ",".join([long[w] if w in long else known[w] for w in words])
            else:
                yield ",".join(map(known.__getitem__, words))

    def encode_batch(self, batch: list[str]) -> Iterator[list[int]]:
        for ids in self.encode_decimal(batch):
            yield list(map(int, ids.split(","))) if ids else []

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_decimal(self, ids: list[str]) -> bytes:
        return b"".join(map(self.of_decimal.__getitem__, ids))


def as_key(word: str) -> str:
    return word[1:] if word[:1] == " " and word[1:2] not in ("", "\0") else "\0" + word


def as_word(key: str) -> str:
    return key[1:] if key[:1] == "\0" else " " + key


def encoder(path: str, pattern: str) -> ByteBPE:
    """One encoder for each worker process."""
    own = state("byte_bpe")
    if (path, pattern) not in own:
        own[path, pattern] = ByteBPE(path, pattern)
    return own[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Ids of every whole text: (key, ids array<int>). Null and empty texts have no ids; repeated rows give repeated rows.

    ``path`` must name the rank file on every executor.
    """
    schema = docs.select(key).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in pieces(batches, "text"):
            ids = list(bpe.encode_batch(texts(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, *, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Bytes of every list of ids: (key, decoded binary); null lists decode to no bytes."""
    schema = encoded.select(key).schema.add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            out = [bpe.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "decoded"])

    return encoded.select(F.col(key), F.col(ids).alias("ids")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and decode in one pass: (key, n_tokens, ids_sha256, decoded_sha256).

    Nothing but digests leaves the task, so no ids are shuffled or stored. Null and empty texts have 0 tokens and the
    digests of nothing.
    """
    schema = docs.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in pieces(batches, "text", BATCH_BYTES):
            counts, ids_digest, decoded_digest = [], [], []
            for joined in bpe.encode_decimal(texts(batch.column(1))):
                ids = joined.split(",") if joined else []
                counts.append(len(ids))
                ids_digest.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded_digest.append(hashlib.sha256(bpe.decode_decimal(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(decoded_digest, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, schema)


def lengths(docs: DataFrame, path: str, pattern: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encoded length of every whole text: (key, n_tokens); 0 for null and empty texts."""
    schema = docs.select(key).schema.add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in pieces(batches, "text", BATCH_BYTES):
            counts = [ids.count(",") + 1 if ids else 0 for ids in bpe.encode_decimal(texts(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[key, "n_tokens"])

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, schema)
