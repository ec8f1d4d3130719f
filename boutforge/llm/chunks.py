"""Token ids of whole texts by way of distinct chunks.

A text is cut before each single space or line feed that follows a character that is not white space,
after such a line feed, and before a comma or the like that follows a letter or digit. A byte-level BPE
pre-tokenizer always starts a new piece there, so a chunk's ids don't depend on its neighbours. Distinct chunks are found by hash in a table that a worker keeps; only new ones are
handed to an encoder, many at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np

from .textblocks import mix, ranges, spans_hash

_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
KEEP_CHUNKS = 1 << 19  # entries a worker keeps; then it starts anew
KEEP_TOKENS = 1 << 22


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies (a public convention)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        table[chr(256 + k)] = b
    return table


class Vocabulary:
    """A tokenizer file's merges, ids and bytes as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.byte_id = np.array([vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int64)
        rules = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        pairs = np.array([vocab[a] * size + vocab[b] for a, b in rules], np.int64)
        made = np.array([vocab[a + b] for a, b in rules], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.size, self.made = size, made
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        """The rank of merging each pair, or none."""
        key = left * self.size + right
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == key, self.ranks[at], none)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, joined."""
        return self.data[ranges(self.starts[ids], self.lengths[ids])]


def chunk_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the chunks that cover the bytes, and the first chunk of each document."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    padded = np.concatenate([np.full(3, 32, np.uint8), data])
    b1, b2, b3 = padded[2:-1], padded[1:-2], padded[:-3]  # the bytes before each byte
    space = (b1 == 32) | ((b1 >= 9) & (b1 <= 13)) | ((b1 >= 28) & (b1 <= 31))
    # the last bytes of white-space characters beyond ASCII; a few others also match, and then the chunk is only longer
    space |= (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
    space |= (b3 >= 0xE1) & (b3 <= 0xE3) & ((b2 == 0x80) | (b2 == 0x81) | (b2 == 0x9A))
    solid = ~space
    begin = ((data == 32) | (data == 10)) & solid
    # after a lone line feed; characters that may be white space beyond ASCII are left to the encoder
    plain = ((data > 32) & (data < 127)) | (data == 0xC3)
    begin[1:] |= begin[:-1] & (data[:-1] == 10) & plain[1:]
    # before a mark that follows an ASCII letter or digit or a letter of the Latin-1 block
    letter = ((b1 | 32) >= 97) & ((b1 | 32) <= 122) | (b1 >= 48) & (b1 <= 57) | (b2 == 0xC3) & (b1 >= 0x98) & (b1 <= 0xBF) & (b1 != 0xB7) | (b2 == 0xC3) & (b1 >= 0x80) & (b1 <= 0x96)
    begin |= letter & _MARK[data]
    inner = offsets[offsets < n]
    begin[inner] = True
    begin[0] = True
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


class ChunkEncoder:
    """encode_new takes a list of distinct chunks (bytes) and returns (ids, count of each)."""

    def __init__(self, encode_new: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.encode_new = encode_new
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each document begin (one entry more than documents)."""
        starts, ends, first_chunk = chunk_spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        h = spans_hash(data, starts, ends)
        keys, one, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > KEEP_CHUNKS or len(self.ids) > KEEP_TOKENS:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            ids, counts = self.encode_new([raw[s:e] for s, e in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)])
            place = at[new]
            first = len(self.ids) + np.cumsum(counts, dtype=np.int64) - counts
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.keys = np.insert(self.keys, place, keys[new])
            self.first = np.insert(self.first, place, first)
            self.count = np.insert(self.count, place, counts.astype(np.int32))
            at = np.searchsorted(self.keys, keys)
        row = at[which]
        counts = self.count[row].astype(np.int64)
        ids = self.ids[ranges(self.first[row], counts)]
        ends_at = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends_at[first_chunk]


def sub_seed(name: str) -> np.uint64:
    """A fixed 64-bit number of a name."""
    return mix(np.array([sum(b << (8 * (i % 8)) for i, b in enumerate(name.encode())) & (2**64 - 1)], np.uint64))[0]
