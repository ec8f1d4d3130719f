"""Operator 9: token ids in binary files, coded by a static range asymmetric numeral system.

One table of frequencies, counted over all ids, serves all blocks. A block holds whole consecutive
documents in ascending doc_id order and is coded on its own: ids go to lanes in turn, each lane has a
64-bit state, and all lanes share one stream of 32-bit words. Every ``CHECKPOINT`` steps the block
keeps the lanes' states and the place in the stream, so a reader may start there; a header has
checksums of the coded bytes and of the ids.

The files are Parquet: a ``blocks`` table (file, block, the documents' ids and lengths, the coded
bytes) and a ``table`` of frequencies. Spark's own writer makes them, so lost tasks leave no partial
file and any store will do. Blocks decode in parallel.

Defined cases: a null or empty text has only the end id; null doc_ids come first; rows that repeat a
doc_id are kept, ordered by their ids' checksum; an empty table makes no block.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tables
from .chunks import ChunkEncoder, Vocabulary
from .textblocks import ranges, text_blocks, trim

SCALE_BITS = 20
LOW = 1 << 31
LANES = 4096
CHECKPOINT = 128
BLOCK_TOKENS = 1 << 20
MAGIC = b"RANS0001"
_HEAD = struct.Struct("<8sIIIIII")  # magic, ids, lanes, words, checkpoints, checksum of coded bytes, of ids


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE_BITS, at least 1 for each id that occurs."""
    total, target = int(counts.sum()), 1 << SCALE_BITS
    if not total:
        return np.zeros(len(counts), np.int64)
    freq = np.where(counts > 0, np.maximum(1, counts * (target / total)).astype(np.int64), 0)
    over = int(freq.sum()) - target
    order = np.argsort(-freq, kind="stable")
    if over < 0:
        freq[order[0]] -= over
    while over > 0:  # ids rounded up to 1 take from the frequent ones, in proportion
        room = np.maximum(freq - 1, 0)
        cut = np.minimum(room, -(-room * over // max(1, int(room.sum()))))
        below = np.minimum(np.cumsum(cut[order]), over)
        freq[order] -= np.diff(below, prepend=0)
        over -= int(below[-1])
    return freq


class Coder:
    def __init__(self, counts: np.ndarray):
        freq = scaled(counts)
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = max(1, min(LANES, -(-n // 64)))
        steps = -(-n // lanes)
        state = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []  # words from that step's start to the end, states
        high = np.uint64(63 - SCALE_BITS)
        count = 0
        for step in range(steps - 1, -1, -1):
            part = ids[step * lanes : (step + 1) * lanes]
            x, f = state[: len(part)], self.freq[part]
            out = np.flatnonzero(x >= f << high)
            if len(out):
                words.append((x[out] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                x[out] >>= np.uint64(32)
                count += len(out)
            quotient = x // f
            state[: len(part)] = (quotient << np.uint64(SCALE_BITS)) + (x - quotient * f) + self.cum[part]
            if step and step % CHECKPOINT == 0:
                marks.append((count, state.copy()))
        marks.reverse()
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        body = b"".join([state.tobytes(), np.array([count - m for m, _ in marks], np.uint32).tobytes(), *(s.tobytes() for _, s in marks), stream.tobytes()])
        return _HEAD.pack(MAGIC, n, lanes, len(stream), len(marks), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body

    def decode(self, block: bytes, checkpoint: int = 0) -> np.ndarray:
        """The block's ids from the start, or from its checkpoint of that number (1 is the first)."""
        magic, n, lanes, n_words, n_marks, body_sum, ids_sum = _HEAD.unpack_from(block)
        body = memoryview(block)[_HEAD.size :]
        if magic != MAGIC or zlib.crc32(body) != body_sum:
            raise ValueError("a block's bytes are damaged")
        states = np.frombuffer(body, np.uint64, lanes)
        places = np.frombuffer(body, np.uint32, n_marks, lanes * 8)
        marks_at = lanes * 8 + n_marks * 4
        stream = np.frombuffer(body, np.uint32, n_words, marks_at + n_marks * lanes * 8)
        first, at = 0, 0
        if checkpoint:
            states = np.frombuffer(body, np.uint64, lanes, marks_at + (checkpoint - 1) * lanes * 8)
            first, at = checkpoint * CHECKPOINT, int(places[checkpoint - 1])
        state = states.copy()
        out = np.zeros(n - first * lanes, np.int32)
        low = np.uint64((1 << SCALE_BITS) - 1)
        for step in range(first, -(-n // lanes)):
            a = (step - first) * lanes
            width = min(lanes, len(out) - a)
            x = state[:width]
            slot = x & low
            symbol = self.symbol[slot.astype(np.int64)]
            out[a : a + width] = symbol
            x = self.freq[symbol] * (x >> np.uint64(SCALE_BITS)) + slot - self.cum[symbol]
            more = np.flatnonzero(x < LOW)
            x[more] = (x[more] << np.uint64(32)) | stream[at : at + len(more)].astype(np.uint64)
            at += len(more)
            state[:width] = x
        if not checkpoint and zlib.crc32(out.astype("<u4").tobytes()) != ids_sum:
            raise ValueError("a block's ids don't match their checksum")
        return out


class LibraryEncoder:
    """New chunks encoded by the tokenizers library, many joined in one text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lengths = Vocabulary(path).lengths

    def encode_new(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined: list[int] = []
        alone: list[int] = []
        for k, c in enumerate(chunks):
            (joined if self._joins(c) else alone).append(k)
        counts = np.zeros(len(chunks), np.int64)
        order: list[np.ndarray] = []
        pieces: list[np.ndarray] = []
        for a in range(0, len(joined), 4096):
            part = joined[a : a + 4096]
            # a chunk without a space in front follows a line feed, which is a piece and an id of its own
            texts = [chunks[k] if chunks[k][0] == 32 else b"\n" + chunks[k] for k in part]
            ids = np.array(self._ids([b"".join(texts).decode()])[0], np.int64)
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(x) for x in texts])) + 1
            count = np.diff(cuts, prepend=0)
            extra = np.array([x[0] == 10 for x in texts])
            keep = np.ones(len(ids), bool)
            keep[(cuts - count)[extra]] = False
            counts[part] = count - extra
            order.append(np.array(part))
            pieces.append(ids[keep])
        for a in range(0, len(alone), 1024):
            part = alone[a : a + 1024]
            found = self._ids([chunks[k].decode() for k in part])
            counts[part] = [len(x) for x in found]
            order.append(np.array(part))
            pieces.append(np.array([i for x in found for i in x], np.int64))
        if not order:
            return np.zeros(0, np.int64), counts
        by = np.concatenate(order)
        first = np.zeros(len(chunks), np.int64)
        first[by] = np.cumsum(counts[by]) - counts[by]
        return np.concatenate(pieces)[ranges(first, counts)], counts

    @staticmethod
    def _joins(c: bytes) -> bool:
        """Whether a chunk starts and ends with characters that can't make a piece with its neighbours."""
        if not (32 < c[-1] < 127 or len(c) > 1 and c[-2] == 0xC3) or b"<|" in c:
            return False
        first = c[0] if c[0] != 32 else c[1] if len(c) > 1 else 0
        return 32 < first < 127 or first == 0xC3

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_state: dict[str, object] = {}


def _library(path: str) -> ChunkEncoder:
    if path not in _state:
        _state[path] = ChunkEncoder(LibraryEncoder(path).encode_new)
    return _state[path]


def token_rows(docs: DataFrame, tokenizer_path: str, end_id: int, bounds: list[int]) -> DataFrame:
    """doc_id, n_tokens, the ids with the end id as packed bytes, and which range between bounds doc_id is in."""
    schema = "doc_id long, n_tokens int, check long, packed binary, file int"
    limits = np.array(bounds, np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _library(tokenizer_path)
        packer = zstandard.ZstdCompressor(level=1, write_content_size=True)
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(1)):
                ids, bounds = encoder.encode(data, offsets)
                whole = np.insert(ids, bounds[1:], end_id)
                ends = bounds[1:] + np.arange(1, b - a + 1)
                starts = np.concatenate([[0], ends[:-1]])
                packed, checks = [], []
                own = batch.column(0).slice(a, b - a)
                least = np.iinfo(np.int64).min  # a null comes first
                file = pa.array(np.searchsorted(limits, own.fill_null(least).to_numpy(zero_copy_only=False)).astype(np.int32))
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    raw = whole[s:e].astype("<u4")
                    checks.append(zlib.crc32(raw.tobytes()))
                    packed.append(packer.compress(raw.astype("<u2").tobytes() if not np.any(raw >> 16) else b"\x01" + raw.tobytes()))
                yield pa.RecordBatch.from_arrays([own, pa.array((ends - starts).astype(np.int32)), pa.array(checks, pa.int64()), pa.array(packed, pa.binary()), file], names=["doc_id", "n_tokens", "check", "packed", "file"])
                trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _unpack(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return np.frombuffer(raw[1:], "<u4").astype(np.int32) if len(raw) % 2 else np.frombuffer(raw, "<u2").astype(np.int32)


def _frequencies(rows: DataFrame, size: int) -> DataFrame:
    """How often each id occurs: one count per id and task, then summed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids = [_unpack(packed) for packed in batch.column(0).to_pylist()]
            total += np.bincount(np.concatenate(ids), minlength=size) if ids else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["id", "n"])

    return rows.select("packed").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


BLOCKS = "first long, doc_ids array<long>, lengths array<int>, coded binary"
_ARROW_BLOCKS = pa.schema([("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("coded", pa.binary())])


def _counts_at(spark: SparkSession, folder: str, size: int) -> np.ndarray:
    """The frequency table of a folder, one number for each id of the vocabulary."""
    found = spark.read.schema("id int, n long").parquet(f"{folder}/table").toPandas()
    counts = np.zeros(size, np.int64)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    return counts


def write(docs: DataFrame, tokenizer_path: str, folder: str, *, end_id: int = 0) -> None:
    """Encode docs and write the files to folder, in ascending doc_id order."""
    spark = docs.sparkSession
    size = len(Vocabulary(tokenizer_path).lengths)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ranges of doc_id by its quantiles: a range shuffle of the encoded rows would encode them twice, once to sample
    steps = [i / (4 * parts) for i in range(1, 4 * parts)]
    bounds = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), F.array(*map(F.lit, steps)), F.lit(80 * parts))).first()[0] or []
    rows = token_rows(docs, tokenizer_path, end_id, sorted(set(bounds)))
    rows = rows.repartition(parts, "file").sortWithinPartitions("file", "doc_id", "check")
    # the place of a row in the order of all: the range in the upper bits, then the row in its partition
    place = F.shiftleft(F.col("file").cast("long"), 33) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.select("doc_id", "n_tokens", "packed", place.alias("place"))
    with tables.shuffle_files_dropped(spark):
        rows.write.option("compression", "none").parquet(f"{folder}/rows")
        rows = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
        _frequencies(rows, size).write.parquet(f"{folder}/table")
    counts = spark.sparkContext.broadcast(_counts_at(spark, folder, size))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(counts.value)
        first, last, n = 0, -2, 0
        doc_ids: list[int] = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []

        def done() -> pa.RecordBatch:
            row = {"first": first, "doc_ids": list(doc_ids), "lengths": list(lengths), "coded": coder.encode(np.concatenate(ids))}
            for x in (doc_ids, lengths, ids):
                x.clear()
            return pa.RecordBatch.from_pylist([row], schema=_ARROW_BLOCKS)

        for batch in batches:
            for doc_id, length, packed, place in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if doc_ids and (place != last + 1 or n + length > BLOCK_TOKENS):
                    yield done()
                if not doc_ids:
                    first, n = place, 0
                doc_ids.append(doc_id)
                lengths.append(length)
                ids.append(_unpack(packed))
                n, last = n + length, place
        if doc_ids:
            yield done()

    rows.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str, tokenizer_path: str) -> DataFrame:
    """Decode the files: doc_id, start (ids of all documents before it), ids; one row per document.

    Blocks decode in parallel. Starts come from the lengths alone: totals by file and then by block.
    """
    return _decoded(spark, folder, tokenizer_path, "ids array<int>", lambda ids: pa.array(ids, pa.list_(pa.int32())))


def checksums(spark: SparkSession, folder: str, tokenizer_path: str) -> DataFrame:
    """As read(), with each document's number of ids and their checksum instead of the ids."""
    return _decoded(spark, folder, tokenizer_path, "ids_crc32 long", lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()))


def _decoded(spark: SparkSession, folder: str, tokenizer_path: str, column: str, make) -> DataFrame:
    counts = spark.sparkContext.broadcast(_counts_at(spark, folder, len(Vocabulary(tokenizer_path).lengths)))
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(counts.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(j)[k] for j, n in enumerate(batch.schema.names)}
                ids = coder.decode(row["coded"].as_py())
                lengths = row["lengths"].values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(lengths, dtype=np.int64)
                parts = np.split(ids, ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values, pa.array(ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(np.full(len(parts), row["first"].as_py())), make(parts)],
                    names=["doc_id", "within", "n_tokens", "first", column.split()[0]],
                )

    docs = blocks.mapInArrow(run, f"doc_id long, within long, n_tokens long, first long, {column}")
    sizes = blocks.select("first", F.shiftright("first", 33).alias("file"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    files = sizes.groupBy("file").agg(F.sum("n").alias("n"))
    # one row for each file, however many documents it holds
    files = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("file_start"))
    starts = sizes.withColumn("block_start", F.sum("n").over(Window.partitionBy("file").orderBy("first")) - F.col("n")).join(files, "file")
    starts = starts.select("first", (F.col("file_start") + F.col("block_start")).alias("block_start"))
    return docs.join(starts, "first").select("doc_id", (F.col("block_start") + F.col("within")).alias("start"), "n_tokens", column.split()[0])
