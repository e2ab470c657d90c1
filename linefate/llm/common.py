"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import os
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One document in HELD_OUT_FOLDS is never learned from.
HELD_OUT_FOLDS = 5


_STATES: dict[str, dict] = {}


def state(operator: str) -> dict:
    """What an operator keeps in a worker process between tasks. Workers are used again: another operator's goes."""
    if operator not in _STATES:
        if _STATES:
            _STATES.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
        _STATES[operator] = {}
    return _STATES[operator]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null id counts as the text ``''``."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_FOLDS == 0


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local default is set only where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = held.get() if held.isDefined() else "file:///tmp/checkpoints"
    return found if "://" in found or found.startswith("file:") else f"file://{os.path.abspath(found)}"


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return posixpath.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")


def with_checkpoints(spark: SparkSession) -> None:
    """Make DataFrame.checkpoint() usable: it writes to the shared folder."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def materialized(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder; survives the loss of any executor."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """Tables of one run below the shared folder. Those that nothing reads any more are dropped by name."""

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.base = spark, scratch(spark, what)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(posixpath.join(self.base, name))
        return self.spark.read.schema(df.schema).parquet(posixpath.join(self.base, name))

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(posixpath.join(self.base, name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Bits:
    """A set of 64-bit numbers as bits of a file in the shared folder: says yes to all members, and to few others.

    The file's size follows the number of members up to MOST bits (32 MB); beyond that more others get a yes.
    """

    MOST = 1 << 28
    CHUNK = 1 << 18

    @classmethod
    def write(cls, numbers: DataFrame, folder: "Folder", name: str) -> str:
        """``numbers`` has one long column. Bits are set by tasks, a chunk each; only the chunks come to the driver."""
        column = numbers.columns[0]
        held = folder.write(f"{name}-numbers", numbers.where(F.col(column).isNotNull()).distinct())
        size = min(cls.MOST, max(cls.CHUNK, 1 << (16 * held.count()).bit_length()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                cell = batch.column(0).to_numpy() & (size - 1)
                chunk = cell // cls.CHUNK
                for k in np.unique(chunk).tolist():
                    bits = np.zeros(cls.CHUNK, dtype=bool)
                    bits[cell[chunk == k] % cls.CHUNK] = True
                    found[k] = np.packbits(bits) | found.get(k, 0)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["chunk", "bits"])

        dealt = held.repartition(F.floor(F.col(column).bitwiseAND(size - 1) / cls.CHUNK))
        whole = np.zeros(size // 8, dtype=np.uint8)
        for chunk, bits in dealt.mapInArrow(run, "chunk long, bits binary").collect():
            at = chunk * cls.CHUNK // 8
            whole[at : at + cls.CHUNK // 8] |= np.frombuffer(bits, dtype=np.uint8)
        folder.drop(f"{name}-numbers")
        path = posixpath.join(folder.base, f"{name}.bits")
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(posixpath.dirname(at), recursive=True)
        with fs.open_output_stream(at) as f:
            f.write(whole.tobytes())
        return path

    @classmethod
    def load(cls, path: str) -> np.ndarray:
        """A worker keeps one set."""
        own = state("bits")
        if path not in own:
            own.clear()
            fs, at = pyarrow.fs.FileSystem.from_uri(path)
            with fs.open_input_file(at) as f:
                own[path] = np.frombuffer(f.read(), dtype=np.uint8)
        return own[path]

    @classmethod
    def has(cls, path: str, numbers: np.ndarray) -> np.ndarray:
        bits = cls.load(path)
        cell = numbers.view(np.uint64) & np.uint64(8 * len(bits) - 1)
        return (bits[(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 == 1


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts(column: pa.Array) -> list[str]:
    """Python strings of a text column; null becomes the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text at most, or a single row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at = batch.schema.get_field_index(column)
        sizes = np.cumsum(np.nan_to_num(np.array(pa.compute.binary_length(batch.column(at)).to_pylist(), dtype=float)))
        start = 0
        while start < n:
            before = sizes[start - 1] if start else 0.0
            end = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


class PairMap:
    """Open-addressing table from two non-negative numbers below 2**31 to a third."""

    def __init__(self, a: np.ndarray, b: np.ndarray, values: np.ndarray, room: int = 4) -> None:
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        self.bits = max(10, int(room * len(keys)).bit_length())
        mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int64)
        self.steps = 1
        left, held, slot = keys, values.astype(np.int64), self.slots(keys)
        while len(left):
            free = np.flatnonzero(self.keys[slot] < 0)
            at, first = np.unique(slot[free], return_index=True)
            take = free[first]
            self.keys[at], self.values[at] = left[take], held[take]
            rest = np.ones(len(left), dtype=bool)
            rest[take] = False
            left, held, slot = left[rest], held[rest], (slot[rest] + 1) & mask
            self.steps += 1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The value of each pair, or -1; negative numbers are in no pair."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        keys[(a < 0) | (b < 0)] = -2
        slot, mask = self.slots(keys), (1 << self.bits) - 1
        out = np.full(len(keys), -1, dtype=np.int64)
        at = np.arange(len(keys))
        for _ in range(self.steps):
            held = self.keys[slot]
            hit = held == keys
            out[at[hit]] = self.values[slot[hit]]
            more = ~hit & (held >= 0)
            if not more.any():
                break
            at, keys, slot = at[more], keys[more], (slot[more] + 1) & mask
        return out


#: Odd multiplier of word_hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i below n, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        for name, x in (("up", BASE), ("down", INVERSE)):
            steps = np.full(n, x, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null is an empty text."""
    wide = pa.compute.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.empty(0, dtype=np.uint8)
    return raw, at - at[0]


def word_table(is_word: np.ndarray) -> np.ndarray:
    """For each byte: 0 outside words, else one more than the byte, A-Z lower-cased."""
    table = np.arange(1, 257, dtype=np.uint16)
    table[65:91] += 32
    table[~is_word] = 0
    return table


#: Bytes whose words are looked at together; a word that is longer is looked at whole.
SLICE = 1 << 20


class Words:
    """Words of many texts at once: starts, ends (byte offsets), hashes, and first (of each text, the index of its first word).

    Memory beside the result is in proportion to SLICE, or to the longest word.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, cuts: np.ndarray | None = None) -> None:
        # a text's end ends its last word, though the next text begins with one; so do further cuts
        cut = offsets[1:-1] if cuts is None else np.concatenate((offsets[1:-1], cuts))
        cut = cut[(cut > 0) & (cut < len(raw))]
        cut = np.unique(cut[(table[raw[cut - 1]] != 0) & (table[raw[cut]] != 0)]) if len(cut) else cut
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, size = 0, len(raw)
        while at < size:
            low = table[raw[at : at + SLICE]]
            end = at + len(low)
            while end < size and table[raw[end - 1]] and table[raw[end]] and not (len(cut) and cut[min(int(np.searchsorted(cut, end)), len(cut) - 1)] == end):
                # the last word goes on: leave it to the next slice, unless it is all of this one
                outside = np.flatnonzero(low == 0)
                inner = cut[(cut > at) & (cut < end)]
                back = max(at + int(outside[-1]) + 1 if len(outside) else at, int(inner[-1]) if len(inner) else at)
                if back > at:
                    end = back
                    break
                low = table[raw[at : end + SLICE]]
                end = at + len(low)
            parts.append(self._slice(low[: end - at], cut[(cut > at) & (cut < end)] - at, at))
            at = end
        self.starts, self.ends, self.hashes = (np.concatenate([x[k] for x in parts]) if parts else np.empty(0, dtype=np.uint64 if k == 2 else np.int64) for k in range(3))
        self.first = np.searchsorted(self.starts, offsets)

    @staticmethod
    def _slice(low: np.ndarray, cut: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = np.zeros(len(low) + 2, dtype=np.int8)
        inside[1:-1] = low != 0
        step = np.diff(inside)
        begins, ends = step == 1, step == -1
        begins[cut] = ends[cut] = True
        starts, ends = np.flatnonzero(begins), np.flatnonzero(ends)
        up, down = _powers(len(low) + 1)
        sums = np.zeros(len(low) + 1, dtype=np.uint64)
        np.cumsum(low.astype(np.uint64) * up[: len(low)], out=sums[1:])
        mixed = (sums[ends] - sums[starts]) * down[starts]
        return starts + at, ends + at, mix(mixed + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))
