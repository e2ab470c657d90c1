"""Token-id files of independent zstandard frames with a trailing seek table and per-frame checksums.

A shard file is, in order:

    frame*   zstandard frames, each of the little-endian unsigned 32-bit ids of some whole documents
    table    zstandard frame of the entries: int64 doc_id, uint64 n_ids, uint32 frame for each document, then
             uint64 offset, uint64 compressed bytes, uint64 raw bytes, uint32 crc32 of the raw bytes for each frame
    trailer  <QQQQI8s: offset of table, its bytes, documents, frames, crc32 of the compressed table, magic

A reader seeks to the trailer, reads the table and then only the frames that hold the documents asked for. Frames hold
whole documents, so a document is one frame and a slice. A doc_id that is null is stored as NULL_ID.

Shards are written in ascending doc_id order by one task each, under a name of that attempt's own and then renamed, so a
lost executor's task is simply run again. The name that a finished task returns is the one that readers use.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, crc32, flat, pieces, state

MAGIC = b"LFTOKEN1"
TRAILER = struct.Struct("<QQQQI8s")
NULL_ID = -(2**63)
#: Raw bytes after which a frame is closed.
FRAME_BYTES = 1 << 20
#: Documents of a shard; a shard's table is held in memory while it is written.
SHARD_DOCS = 100_000
#: Encoded chunks that a worker keeps, and ids of theirs.
KEPT_CHUNKS = 1_000_000
KEPT_IDS = 8_000_000
#: Runs of letters that are encoded as one text.
RUNS = 500
#: A text with this in it may hold the tokenizer's special tokens and is encoded whole.
SPECIAL = "<|"
MARK = np.isin(np.arange(256), list(b".,;:!?"))
LETTER = np.array([x < 128 and chr(x).isalpha() for x in range(256)])


class ChunkEncoder:
    """Ids of whole texts from a tokenizer that encodes the parts between spaces and line breaks independently.

    That holds for tokenizers whose pre-tokenizer drops white space, as the one for which this is used does. Chunks are cut,
    hashed and looked up as arrays; every chunk that isn't known is encoded by the tokenizers library itself, and so is
    every whole text that may hold a special token. The tokenizer stays as it is loaded.
    """

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = end_id
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        table = np.arange(1, 257, dtype=np.uint16)
        table[[10, 32]] = 0
        self.table = table
        self.clear()

    def clear(self) -> None:
        """Forget all chunks but number 0, the end id."""
        self.known: dict[int, int] = {}
        self.ids = np.array([self.end], dtype="<u4")
        self.starts, self.sizes = np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64)

    def _keep(self, hashes: list[int], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.known.update(zip(hashes, range(len(self.sizes), len(self.sizes) + len(sizes)), strict=True))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.ids = np.concatenate((self.ids, ids.astype("<u4")))

    def _learn(self, hashes: list[int], chunks: list[str]) -> None:
        """Encode chunks by the library; runs of letters many at a time, told apart by the ids that end a word."""
        alone = [k for k, x in enumerate(chunks) if not x.isalpha()]
        letters = [k for k, x in enumerate(chunks) if x.isalpha()]
        runs = [letters[i : i + RUNS] for i in range(0, len(letters), RUNS)]
        found: list[tuple[list[int], np.ndarray, np.ndarray]] = []
        for own, x in zip(runs, self.tokenizer.encode_batch_fast([" ".join([chunks[k] for k in own]) for own in runs], add_special_tokens=False), strict=True):
            ids = np.array(x.ids, dtype=np.int64)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(own):
                found.append((own, np.diff(ends, prepend=0), ids))
            else:
                alone += own
        each = [x.ids for x in self.tokenizer.encode_batch_fast([chunks[k] for k in alone], add_special_tokens=False)]
        found.append((alone, np.fromiter(map(len, each), dtype=np.int64, count=len(each)), np.fromiter(chain.from_iterable(each), dtype=np.int64)))
        self._keep([hashes[k] for own, _, _ in found for k in own], np.concatenate([x for _, x, _ in found]), np.concatenate([x for _, _, x in found]))

    def encode_column(self, column: pa.Array) -> pa.Array:
        """Little-endian unsigned 32-bit ids of each text, with the end id, as binary."""
        special = pa.compute.fill_null(pa.compute.match_substring(column, SPECIAL), False)
        if pa.compute.any(special).as_py():
            rest = iter(self._plain(pa.compute.if_else(special, "", column)).to_pylist())
            whole = self.tokenizer.encode_batch_fast(column.filter(special).to_pylist(), add_special_tokens=False)
            own = iter([np.array([*x.ids, self.end], dtype="<u4").tobytes() for x in whole])
            return pa.array([next(own) if odd else plain for odd, plain in zip(special.to_pylist(), rest, strict=True)], pa.binary())
        return self._plain(column)

    def _plain(self, column: pa.Array) -> pa.Array:
        if len(self.known) > KEPT_CHUNKS or len(self.ids) > KEPT_IDS:
            self.clear()
        raw, offsets = flat(column)
        # the library's lower-casing of plain ASCII chunks can be done beforehand; others may depend on composition
        chunk = np.cumsum((raw == 32) | (raw == 10), dtype=np.int32)
        ascii_only = np.ones(int(chunk[-1]) + 1 if len(chunk) else 1, dtype=bool)
        ascii_only[chunk[raw >= 128]] = False
        raw = np.where((raw >= 65) & (raw < 91) & ascii_only[chunk], raw + 32, raw).astype(np.uint8)
        del chunk
        # a mark behind a letter begins a word of its own for the tokenizer
        marks = np.flatnonzero(MARK[raw[1:]] & LETTER[raw[:-1]]) + 1
        words = Words(raw, offsets, self.table, marks)
        hashes, at, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        names = hashes.tolist()
        missing = [k for k, x in enumerate(names) if x not in self.known]
        if missing:
            data, first, last = raw.tobytes(), words.starts[at].tolist(), words.ends[at].tolist()
            self._learn([names[k] for k in missing], [data[first[k] : last[k]].decode("utf-8", "replace") for k in missing])
        place = np.fromiter(map(self.known.__getitem__, names), dtype=np.int64, count=len(names))[which]
        place = np.insert(place, words.first[1:], 0)
        sizes = self.sizes[place]
        ends = np.cumsum(sizes)
        out = self.ids[np.repeat(self.starts[place] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate(([0], 4 * ends[words.first[1:] + np.arange(len(words.first) - 1)])).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(out.tobytes())])

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(batch, pa.string())).to_pylist()


def chunk_encoder(path: str, end_id: int) -> ChunkEncoder:
    """One encoder for each worker process; the library's own threads are off, as each core runs a worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    own = state("token_file")
    if (path, end_id) not in own:
        own[path, end_id] = ChunkEncoder(path, end_id)
    return own[path, end_id]


class ShardWriter:
    """Writes one shard file to a binary stream."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3) -> None:
        self.out, self.frame_bytes, self.at = out, frame_bytes, 0
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.open: list[bytes] = []
        self.size = 0
        self.docs: list[tuple[int, int, int]] = []
        self.frames: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((NULL_ID if doc_id is None else doc_id, len(ids) // 4, len(self.frames)))
        self.open.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        raw = b"".join(self.open)
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.frames.append((self.at, len(packed), len(raw), crc32(raw)))
        self.at += len(packed)
        self.open, self.size = [], 0

    def close(self) -> None:
        if self.open:
            self._flush()
        docs = np.array(self.docs, dtype=DOC) if self.docs else np.empty(0, dtype=DOC)
        frames = np.array(self.frames, dtype=FRAME) if self.frames else np.empty(0, dtype=FRAME)
        table = self.packer.compress(docs.tobytes() + frames.tobytes())
        self.out.write(table)
        self.out.write(TRAILER.pack(self.at, len(table), len(docs), len(frames), crc32(table), MAGIC))


DOC = np.dtype([("doc_id", "<i8"), ("n_ids", "<u8"), ("frame", "<u4")])
FRAME = np.dtype([("offset", "<u8"), ("packed", "<u8"), ("raw", "<u8"), ("crc32", "<u4")])


class ShardReader:
    """Reads a seekable shard file; only the frames asked for are read and decompressed."""

    def __init__(self, file) -> None:
        self.file = file
        file.seek(0, 2)
        size = file.tell()
        file.seek(size - TRAILER.size)
        table_at, table_size, n_docs, n_frames, check, magic = TRAILER.unpack(file.read(TRAILER.size))
        file.seek(table_at)
        table = file.read(table_size)
        if magic != MAGIC or crc32(table) != check:
            raise ValueError("not a token file, or its seek table is damaged")
        self.unpacker = zstandard.ZstdDecompressor()
        raw = self.unpacker.decompress(table, max_output_size=n_docs * DOC.itemsize + n_frames * FRAME.itemsize)
        self.docs = np.frombuffer(raw, dtype=DOC, count=n_docs)
        self.frames = np.frombuffer(raw, dtype=FRAME, offset=n_docs * DOC.itemsize, count=n_frames)

    def frame(self, k: int) -> bytes:
        f = self.frames[k]
        self.file.seek(int(f["offset"]))
        raw = self.unpacker.decompress(self.file.read(int(f["packed"])), max_output_size=max(1, int(f["raw"])))
        if len(raw) != f["raw"] or crc32(raw) != f["crc32"]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) in file order, one frame in memory at a time."""
        held, at, raw = -1, 0, b""
        for doc_id, n_ids, k in self.docs.tolist():
            if k != held:
                held, at, raw = k, 0, self.frame(k)
            yield (None if doc_id == NULL_ID else doc_id), raw[at : at + 4 * n_ids]
            at += 4 * n_ids

    def get(self, doc_ids: Iterable[int]) -> dict[int, bytes]:
        """Ids of the documents asked for that the shard holds; of repeated ids, the first."""
        asked, out = np.unique(np.array(list(doc_ids), dtype=np.int64)), {}
        for k in np.unique(self.docs["frame"][np.isin(self.docs["doc_id"], asked)]).tolist():
            raw, at = self.frame(k), 0
            for doc_id, n_ids, _ in self.docs[self.docs["frame"] == k].tolist():
                if doc_id in asked:
                    out.setdefault(doc_id, raw[at : at + 4 * n_ids])
                at += 4 * n_ids
        return out


def encode(docs: DataFrame, path: str, end_id: int, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, ids binary): little-endian unsigned 32-bit ids of every whole text and the end id; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chunk_encoder(path, end_id)
        for batch in pieces(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), own.encode_column(batch.column(1))], names=["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def write(docs: DataFrame, folder: str, path: str, end_id: int, *, shard_docs: int = SHARD_DOCS, frame_bytes: int = FRAME_BYTES, level: int = 3) -> DataFrame:
    """Encode ``docs`` and write shard files below ``folder`` in ascending doc_id order, nulls first; return the manifest.

    The manifest (shard int, file string, n_docs long, n_ids long) is itself written below the folder, one row for each
    shard; an empty table has none. Shards are dealt by approximate quantiles of doc_id, gathered from the ids alone, so
    the texts are read and encoded once; there is a quantile for each ``shard_docs`` rows. Rows of one doc_id share a
    shard, in the order of their encoded bytes.
    """
    spark = docs.sparkSession
    ids = F.col("doc_id").cast("long")
    n = docs.count()
    shards = max(1, -(-n // shard_docs), min(4 * spark.sparkContext.defaultParallelism, n // 1000))
    cuts = docs.agg(F.percentile_approx(ids, F.array(*[F.lit(k / shards) for k in range(1, shards)]), 100 * shards)).first()[0] if shards > 1 else None
    cuts = sorted(set(cuts or []))
    at = F.lit(0)
    if cuts:
        # position among the cuts by binary search in the plan: a short array, not a join
        at = F.coalesce(F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))]), F.lit(0), lambda low, step: F.when(F.try_element_at(F.lit(cuts), low + step) <= F.col("doc_id"), low + step).otherwise(low)), F.lit(0))
    dealt = encode(docs, path, end_id).withColumn("at", at.cast("int")).repartitionById(len(cuts) + 1, "at")
    manifest = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids").select("doc_id", "ids").mapInArrow(_task(folder, frame_bytes, level), "shard int, file string, n_docs long, n_ids long")
    manifest.write.parquet(posixpath.join(folder, "manifest"))
    return spark.read.schema(manifest.schema).parquet(posixpath.join(folder, "manifest"))


def _task(folder: str, frame_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        n_docs = n_ids = 0
        out = writer = None
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    out = fs.open_output_stream(posixpath.join(base, name + ".part"))
                    writer = ShardWriter(out, frame_bytes, level)
                writer.add(doc_id, ids or b"")
                n_docs, n_ids = n_docs + 1, n_ids + len(ids or b"") // 4
        if writer is not None:
            writer.close()
            out.close()
            fs.move(posixpath.join(base, name + ".part"), posixpath.join(base, name))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["shard", "file", "n_docs", "n_ids"])

    return run


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the shard files.

    start counts the ids of all documents before it over all shards; only the shards' totals are summed for that, one row
    for each shard.
    """
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                with fs.open_input_file(posixpath.join(base, file)) as f:
                    for doc_id, ids in ShardReader(f):
                        rows.append((doc_id, start, len(ids) // 4, crc32(ids)))
                        start += len(ids) // 4
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    placed = manifest.select("shard", "file", before.alias("start"))
    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return placed.repartition(max(n, SHARDS_READ), "shard").select("file", "start").mapInArrow(run, schema)


#: Partitions over which shards are dealt for reading, at least.
SHARDS_READ = 48


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
