"""Operator 1: BPE encoding and decoding with a segment tree over adjacent pair ranks.

Every piece of a text (by the byte-level pre-tokenizer's pattern) starts as one token per byte. Leaf j
of the piece's segment tree holds ``rank * size + j`` of the pair that begins at j; the root is thus the
leftmost pair of lowest rank. A merge changes three leaves, and each update walks one path to the root.
Many pieces of like length are worked on at once as rows of one array.

Defined cases: a null text is empty and has no ids; an empty text decodes to an empty text; extra
columns stay whatever their names, but those named like an output are replaced; rows may repeat and
tables may be empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables
from .chunks import ChunkEncoder, Vocabulary
from .textblocks import giving_back, ranges, text_blocks, trim

#: Fixed value: the public pattern by which byte-level BPE splits a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROWS_AT_ONCE = 1 << 14
LEAVES_AT_ONCE = 1 << 19


class SegmentTreeBpe:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pieces = regex.compile(PIECES)
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def _pieces_of(self, chunk: bytes) -> list[bytes | int]:
        text = chunk.decode("utf-8")
        out: list[bytes | int] = []
        for part in self.special.split(text) if self.special and "<" in text else [text]:
            if part in self.v.special:
                out.append(self.v.special[part])
            else:
                out += [p.encode("utf-8") for p in self.pieces.findall(part)]
        return out

    def encode_new(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        index: dict[bytes, int] = {}
        flat: list[int] = []  # piece numbers; a special token is its id, negative
        sizes = np.zeros(len(chunks), np.int64)
        for k, chunk in enumerate(chunks):
            parts = self._pieces_of(chunk)
            flat += [-1 - p if isinstance(p, int) else index.setdefault(p, len(index)) for p in parts]
            sizes[k] = len(parts)
        number = np.array(flat, np.int64)
        specials = np.unique(number[number < 0])
        ids, counts = self.merge(list(index))
        first = np.concatenate([np.cumsum(counts) - counts, len(ids) + np.arange(len(specials))])
        counts = np.concatenate([counts, np.ones(len(specials), np.int64)])
        ids = np.concatenate([ids, -1 - specials])
        if len(specials):
            number = np.where(number < 0, len(index) + np.searchsorted(specials, number), number)
        per = counts[number]
        total = np.concatenate([[0], np.cumsum(per)])
        ends = np.cumsum(sizes)
        return ids[ranges(first[number], per)], total[ends] - total[ends - sizes]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each piece, joined, and how many each has."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        starts = np.cumsum(lengths) - lengths
        counts = np.zeros(len(pieces), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        bits = np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64)
        for width in np.unique(bits) if len(pieces) else []:
            rows = np.flatnonzero(bits == width)
            step = max(1, min(ROWS_AT_ONCE, LEAVES_AT_ONCE >> int(width)))
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                ids, counts[part] = self._merge_rows(data, starts[part], lengths[part], 1 << int(width))
                found.append((part, ids))
        if not found:
            return np.zeros(0, np.int64), counts
        first = np.zeros(len(pieces), np.int64)
        at = 0
        for part, ids in found:
            first[part] = at + np.cumsum(counts[part]) - counts[part]
            at += len(ids)
        return np.concatenate([ids for _, ids in found])[ranges(first, counts)], counts

    def _merge_rows(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        n, none = len(starts), len(self.v.made)
        empty = none * size
        token = np.full((n, size + 1), -1, np.int64)
        row = np.repeat(np.arange(n), lengths)
        column = ranges(np.zeros(n, np.int64), lengths)
        token[row, column] = self.v.byte_id[data[ranges(starts, lengths)]]
        tree = np.full((n, 2 * size), empty, np.int64)
        has = column + 1 < lengths[row]
        r, c = row[has], column[has]
        rank = self.v.rank(token[r, c], token[r, c + 1], none)
        tree[r, size + c] = np.where(rank < none, rank * size + c, empty)
        level = size
        while level > 1:
            half = level >> 1
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, half:level])
            level = half
        after = np.tile(np.arange(1, size + 2), (n, 1))
        before = np.tile(np.arange(-1, size), (n, 1))
        end = lengths
        live = np.flatnonzero(tree[:, 1] < empty)
        while len(live):
            root = tree[live, 1]
            rank, at = root // size, root % size
            right = after[live, at]
            token[live, at] = self.v.made[rank]
            token[live, right] = -1
            beyond = after[live, right]
            after[live, at] = beyond
            inside = beyond < end[live]
            before[live[inside], beyond[inside]] = at[inside]
            self._set(tree, live, right, np.full(len(live), empty), size)
            key = np.full(len(live), empty)
            rows = live[inside]
            rank = self.v.rank(token[rows, at[inside]], token[rows, beyond[inside]], none)
            key[inside] = np.where(rank < none, rank * size + at[inside], empty)
            self._set(tree, live, at, key, size)
            left = before[live, at]
            some = left >= 0
            rows, left = live[some], left[some]
            rank = self.v.rank(token[rows, left], token[rows, at[some]], none)
            self._set(tree, rows, left, np.where(rank < none, rank * size + left, empty), size)
            live = live[tree[live, 1] < empty]
        kept = token[:, :size] >= 0
        return token[:, :size][kept], kept.sum(axis=1)

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, key: np.ndarray, size: int) -> None:
        """Point update: write the leaf, then the minimum of each pair of children up to the root."""
        node = leaf + size
        tree[rows, node] = key
        while size > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            size >>= 1


_encoders: dict[str, tuple[Vocabulary, ChunkEncoder]] = {}


def _encoder(path: str) -> tuple[Vocabulary, ChunkEncoder]:
    if path not in _encoders:
        v = Vocabulary(path)
        _encoders[path] = v, ChunkEncoder(SegmentTreeBpe(v).encode_new)
    return _encoders[path]


def decoded_texts(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each document's ids as text; bytes that aren't UTF-8 become U+FFFD, as in lossy decoding."""
    data = vocabulary.decode(ids)
    ends = np.concatenate([[0], np.cumsum(vocabulary.lengths[ids])])[bounds]
    raw = data.tobytes()
    whole = not np.any((data[ends[ends < len(data)]] & 0xC0) == 0x80)
    if whole:
        try:
            raw.decode("utf-8")
            return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw))
        except UnicodeDecodeError:
            pass
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())


def encode(docs: DataFrame, tokenizer_path: str, *, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add each text's token ids, and with ``decoded`` the text made again from those ids.

    The tokenizer file is read on the workers, so its path must exist there.
    """
    tables.small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (ids, decoded)]
    outputs = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded, T.StringType(), False)] if decoded else [])
    schema = T.StructType(kept + outputs)
    names = [f.name for f in kept]
    source = tables.unused(docs.columns) + "text"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, encoder = _encoder(tokenizer_path)
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(len(names))):
                tokens, bounds = encoder.encode(data, offsets)
                columns = [batch.column(k).slice(a, b - a) for k in range(len(names))]
                columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tokens)))
                if decoded:
                    columns.append(decoded_texts(vocabulary, tokens, bounds))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                trim()

    return docs.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text}`").cast("string").alias(source)).mapInArrow(giving_back(run), schema)


def decode(tokens: DataFrame, tokenizer_path: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of each row's ids; null ids give an empty text."""
    kept = [f for f in tokens.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(text, T.StringType(), False)])
    names = [f.name for f in kept]
    source = tables.unused(tokens.columns) + "ids"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = _encoder(tokenizer_path)
        for batch in batches:
            column = batch.column(len(names)).fill_null([])
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            columns = [batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, decoded_texts(vocabulary, values, bounds)], names=schema.names)

    return tokens.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{ids}`").cast("array<int>").alias(source)).mapInArrow(giving_back(run), schema)
