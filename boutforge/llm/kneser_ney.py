"""Operator 8: an interpolated modified Kneser-Ney model of word triples or pairs, counted in Spark.

Spark counts words and n-grams; each task sums its own first, and n-grams travel as packed sorted arrays
in hash buckets, so a frequent word, pair or triple is a few numbers per task. The model is a folder of
sorted hash arrays in the shared folder, which workers map into memory: words by 64-bit hash, triples in
buckets of their context's hash by (place of the context, word number), pairs by (context number, word
number) in buckets, and dense arrays by word number.

Order 3: triples have their counts; a pair (v, w) counts the distinct words before it (after the start
mark, where nothing varies, its own count), a word the distinct words before it; each level has its own
discounts. Order 2 begins with the counts of pairs.

A text is its words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) and one end token. The first word's
context is start marks, which are no tokens. An unknown word has the share that discounting leaves to
unseen words, spread evenly over the vocabulary and one unknown; after an unknown word, or a context
that was never seen, the model backs off.

Defined cases: a null text is empty (its only token is the end); a null doc_id counts as empty text in
the split; with no training token every probability is even; repeated rows count each time; extra columns
don't matter.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables
from .textblocks import hashed_words, mix, mix_int, text_blocks, trim

END = np.int64(np.uint64(mix_int(0x656E64)).astype(np.int64))
FLUSH = 1 << 20  # half the distinct keys a task keeps before it hands them on
SPREAD = np.uint64(8)  # buckets over which a context's pairs are spread


def _with_end(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end after each document, and where documents begin."""
    words, first = hashed_words(data, offsets)
    return np.insert(words.view(np.int64), first[1:], END), first + np.arange(len(first))


def _summed(keys: tuple[np.ndarray, ...], counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ascending distinct keys (of one column or more) and the sum of each one's counts."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    new = np.ones(len(order), bool)
    new[1:] = keys[0][1:] != keys[0][:-1]
    for k in keys[1:]:
        new[1:] |= k[1:] != k[:-1]
    begin = np.flatnonzero(new)
    return (*(k[begin] for k in keys), np.add.reduceat(counts[order], begin) if len(begin) else counts[:0])


class _Sums:
    """Keys of some columns with summed counts, merged now and then."""

    def __init__(self, columns: int = 1, flush: int = FLUSH):
        self.columns, self.flush = columns, flush
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, *keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is not None:
            part = (*keys, counts.astype(np.int64))
        elif len(keys) == 1:
            part = np.unique(keys[0], return_counts=True)
        else:
            part = _summed(keys, np.ones(len(keys[0]), np.int64))
        self.parts.append(part)
        self.held += len(part[0])
        if len(self.parts) > 1 and self.full:
            self.parts = [self.merged()]
            self.held = len(self.parts[0][0])

    @property
    def full(self) -> bool:
        return self.held > 2 * self.flush

    def merged(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.zeros(0, np.int64),) * (self.columns + 1)
        if len(self.parts) == 1:
            return self.parts[0]
        *keys, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        return _summed(tuple(keys), counts)

    def take(self) -> tuple[np.ndarray, ...]:
        out = self.merged()
        self.parts, self.held = [], 0
        return out


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length, the first of them ascending, as compressed byte planes."""
    planes = []
    for k, a in enumerate(arrays):
        a = np.diff(a, prepend=0) if not k else a
        planes.append(np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(b"".join(planes))


def unpack(packed: bytes, n_arrays: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    n = len(raw) // (8 * n_arrays)
    out = [np.ascontiguousarray(raw[8 * n * k : 8 * n * (k + 1)].reshape(8, n).T).view("<i8").ravel() for k in range(n_arrays)]
    out[0] = np.cumsum(out[0])
    return out


def _save(path: str, array: np.ndarray) -> None:
    """Write beside and rename, so that a lost or repeated task leaves only whole files."""
    part = f"{path}.{os.getpid()}.{zlib.crc32(os.urandom(8))}.part"
    with open(part, "wb") as f:
        array.tofile(f)
    os.replace(part, path)


def _map(path: str, dtype) -> np.ndarray:
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)


def _put(path: str, start: int, values: np.ndarray) -> None:
    """Write values at their place in a file of known length; repeating it changes nothing."""
    with open(path, "r+b") as f:
        f.seek(start * values.itemsize)
        f.write(values.tobytes())


class Words:
    """The vocabulary's shards: sorted word hashes and counts; a word's number is its place in all."""

    def __init__(self, folder: str, shards: list[tuple[int, int, int]]):
        self.shards = [(s, n, _map(f"{folder}/words-{s}.hash", np.int64), _map(f"{folder}/words-{s}.count", np.int64)) for s, n, _ in shards if n]
        self.lows = np.array([low for _, n, low in shards if n], np.int64)
        self.firsts = np.cumsum([0] + [n for _, n, *_ in self.shards])
        self.size = int(self.firsts[-1])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and count of each hash; sorts the distinct ones to read in order."""
        keys, which = np.unique(hashes, return_inverse=True)
        number, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        cuts = np.append(np.searchsorted(keys, self.lows), len(keys))
        for k, (_, _, have, counts) in enumerate(self.shards):
            part = keys[cuts[k] : cuts[k + 1]]
            if len(part):
                at = np.minimum(np.searchsorted(have, part), len(have) - 1)
                hit = have[at] == part
                number[cuts[k] : cuts[k + 1]][hit] = self.firsts[k] + at[hit]
                count[cuts[k] : cuts[k + 1]][hit] = counts[at[hit]]
        return number[which], count[which]


def bucket_of(context: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    """Pairs of one context are spread over SPREAD buckets, so that none holds a frequent word's followers alone."""
    return ((mix(context) + mix(word) % SPREAD) % np.uint64(buckets)).astype(np.int64)


def _discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ from the numbers of keys counted once, twice, three and four times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))])


MANY = 255  # counts from here on are in a list of their own


class Triples:
    """A bucket's triples: ascending contexts with their sums, and ascending (place of context, word) with counts."""

    SUMS = np.dtype([("total", "<i8"), ("n1", "<u4"), ("n2", "<u4")])

    def __init__(self, path: str):
        self.contexts, self.sums = _map(f"{path}.context", np.int64), _map(f"{path}.sums", self.SUMS)
        self.keys, self.counts, self.many = _map(f"{path}.key", np.int64), _map(f"{path}.count", np.uint8), _map(f"{path}.many", np.int64)

    @classmethod
    def save(cls, path: str, context: np.ndarray, word: np.ndarray, n: np.ndarray) -> None:
        """Write ascending (context, word) with counts."""
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        begin = np.flatnonzero(new)
        sums = np.zeros(len(begin), cls.SUMS)
        for name, x in (("total", n), ("n1", n == 1), ("n2", n == 2)):
            sums[name] = np.add.reduceat(x.astype(np.int64), begin) if len(begin) else 0
        at = np.flatnonzero(n >= MANY)
        _save(f"{path}.context", context[begin])
        _save(f"{path}.sums", sums)
        _save(f"{path}.key", (np.cumsum(new) - 1) << 32 | word)
        _save(f"{path}.count", np.minimum(n, MANY).astype(np.uint8))
        _save(f"{path}.many", np.stack([at, n[at]], axis=1).ravel())

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether each context is known, its total, its triples counted once, twice and oftener, and the triple's count."""
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        hit = self.contexts[at] == context
        sums = self.sums[at]
        begin, end = np.searchsorted(self.keys, at << 32), np.searchsorted(self.keys, (at + 1) << 32)
        once, twice = sums["n1"].astype(float), sums["n2"].astype(float)
        key = at << 32 | np.maximum(word, 0)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        count = np.where((self.keys[place] == key) & (word >= 0), self.counts[place], 0).astype(np.int64)
        if (large := np.flatnonzero(count == MANY)).size:
            many = np.asarray(self.many).reshape(-1, 2)
            count[large] = many[np.searchsorted(many[:, 0], place[large]), 1]
        return hit, sums["total"].astype(float), np.stack([once, twice, end - begin - once - twice], axis=1), count


def triple_bucket(context: np.ndarray, buckets: int) -> np.ndarray:
    """The two words before a word, as one number, say where its triples are."""
    return (mix(context) % np.uint64(buckets)).astype(np.int64)


class Model:
    """A worker's view of a model folder."""

    def __init__(self, spec: dict):
        folder = spec["folder"]
        self.words = Words(folder, spec["shards"])
        self.v = self.words.size
        self.tokens, self.buckets = spec["tokens"], spec["buckets"]
        self.order = spec["order"]
        self.d3 = _discounts(np.array(spec["n3"]))
        self.triples = {b: Triples(f"{folder}/triples-{b}") for b in spec["filled3"]}
        self.pairs = {b: (_map(f"{folder}/pairs-{b}.key", np.int64), _map(f"{folder}/pairs-{b}.count", np.uint32)) for b in spec["filled"]}
        self.stats = {k: _map(f"{folder}/{k}.dense", np.int64) for k in ("total", "n1", "n2", "n3", "follows")}
        self.d, self.d0 = _discounts(np.array(spec["n"])), _discounts(np.array(spec["n0"]))
        self.distinct = sum(spec["kinds"])
        self.left = float(np.dot(self.d0[1:], spec["kinds0"])) / self.distinct if self.distinct else 1.0

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per document: tokens, known tokens, base score, model score."""
        hashes, first = _with_end(data, offsets)
        word, count = self.words.find(hashes)
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[first[:-1]] = self.v
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * (self.v + 1)))
        known = word >= 0
        low = np.full(len(word), self.left / (self.v + 1))
        keys, which = np.unique(word[known], return_inverse=True)
        if self.distinct and len(keys):
            follows = self.stats["follows"][keys]
            low[known] += (np.maximum(follows - self.d0[np.minimum(follows, 3)], 0) / self.distinct)[which]
        p = low
        seen = np.flatnonzero(context >= 0)
        if self.distinct and len(seen):
            contexts, which = np.unique(context[seen], return_inverse=True)
            total, n1, n2, n3 = (self.stats[k][contexts].astype(float) for k in ("total", "n1", "n2", "n3"))
            gamma = np.where(total > 0, (self.d[1] * n1 + self.d[2] * n2 + self.d[3] * n3) / np.maximum(total, 1), 1.0)
            p = low.copy()
            p[seen] *= gamma[which]
            both = np.flatnonzero((context >= 0) & known)
            c = self.pair_counts(context[both], word[both])
            p[both] += np.maximum(c - self.d[np.minimum(c, 3)], 0) / np.maximum(self.stats["total"][context[both]], 1)
        if self.triples:
            before = np.empty_like(word)
            before[2:] = word[:-2]
            before[first[:-1]] = self.v
            second = first[:-1] + 1
            before[second[second < first[1:]]] = self.v
            self._with_triples(p, before, context, word)
        begin = first[:-1]
        return np.diff(first), np.add.reduceat(known.astype(np.int64), begin), np.add.reduceat(base, begin), np.add.reduceat(np.log10(p), begin)

    def _with_triples(self, p: np.ndarray, before: np.ndarray, context: np.ndarray, word: np.ndarray) -> None:
        """Make p, the pairs' probabilities, those of triples wherever the two words before were seen together."""
        some = np.flatnonzero((before >= 0) & (context >= 0))
        pair = before[some] << 32 | context[some]
        bucket = triple_bucket(pair, self.buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b, table in self.triples.items():
            part = order[cuts[b] : cuts[b + 1]]
            if len(part):
                hit, total, kinds, c = table.find(pair[part], word[some[part]])
                at, c = some[part[hit]], c[hit]
                gamma = kinds[hit] @ self.d3[1:]
                p[at] = (np.maximum(c - self.d3[np.minimum(c, 3)], 0) + gamma * p[at]) / total[hit]

    def pair_counts(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        keys, which = np.unique(context << 32 | word, return_inverse=True)
        bucket = bucket_of(keys >> 32, keys & 0xFFFFFFFF, self.buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        count = np.zeros(len(keys), np.int64)
        for b, (have, counts) in self.pairs.items():
            part = order[cuts[b] : cuts[b + 1]]
            if len(part):
                at = np.minimum(np.searchsorted(have, keys[part]), len(have) - 1)
                hit = have[at] == keys[part]
                count[part[hit]] = counts[at[hit]]
        return count[which]


def _blocks(batches: Iterable[pa.RecordBatch], column: int = 0) -> Iterator[tuple]:
    for batch in batches:
        for a, b, data, offsets in text_blocks(batch.column(column)):
            yield batch, a, b, data, offsets
        trim()


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def train(docs: DataFrame, *, text: str = "text", order: int = 2) -> dict:
    """Count docs and write a model of order 2 or 3; the result says where it is and has its few totals."""
    if order not in (2, 3):
        raise ValueError("the model's order is 2 or 3")
    spark = docs.sparkSession
    uri = tables.shared_dir(spark)
    folder = tables.local_path(uri)
    os.makedirs(folder, exist_ok=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(text).cast("string").alias("text"))

    def words(batches):
        sums = _Sums()
        for _, _, _, data, offsets in _blocks(batches):
            sums.add(_with_end(data, offsets)[0])
            if sums.full:
                keys, counts = sums.take()
                yield _batch(word=pa.array(keys), n=pa.array(counts))
        keys, counts = sums.take()
        yield _batch(word=pa.array(keys), n=pa.array(counts))

    def save_words(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        both = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        keys = np.concatenate([k for k, _ in both]) if both else np.zeros(0, np.int64)
        counts = np.concatenate([c for _, c in both]) if both else np.zeros(0, np.int64)
        _save(f"{folder}/words-{shard}.hash", keys)
        _save(f"{folder}/words-{shard}.count", counts)
        yield _batch(shard=pa.array([shard]), n=pa.array([len(keys)]), low=pa.array([int(keys[0]) if len(keys) else 0]), tokens=pa.array([int(counts.sum())]))

    with tables.shuffle_files_dropped(spark):
        counted = texts.mapInArrow(words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        ordered = counted.repartitionByRange(parts, "word").sortWithinPartitions("word")
        shards = sorted(tuple(r) for r in ordered.mapInArrow(save_words, "shard long, n long, low long, tokens long").collect())  # one row for each partition
    shards = sorted((s for s in shards if s[1]), key=lambda s: s[2])
    spec = {"folder": folder, "uri": uri, "shards": [s[:3] for s in shards], "tokens": sum(s[3] for s in shards), "buckets": 4 * parts}
    v = sum(s[1] for s in shards)
    if v >= 1 << 31:
        raise ValueError("word numbers take 31 bits; split the vocabulary by language first")
    for name in ("total", "n1", "n2", "n3", "follows"):
        with open(f"{folder}/{name}.dense", "wb") as f:
            f.truncate((v + 1) * 8)
    buckets = spec["buckets"]

    def split(number: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
        order = np.argsort(number, kind="stable")
        at = number[order]
        begin = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else []
        for k, part in zip(at[begin], np.split(order, begin[1:]), strict=True) if len(at) else []:
            yield int(k), pack(*(a[part] for a in arrays))

    def packed(number: np.ndarray, *arrays: np.ndarray, kind: int = 0) -> pa.RecordBatch:
        found = list(split(number, *arrays))
        return _batch(bucket=pa.array([k for k, _ in found], pa.int64()), kind=pa.array([kind] * len(found), pa.int64()), packed=pa.array([p for _, p in found], pa.binary()))

    def pairs(batches):
        vocabulary, sums = Words(folder, spec["shards"]), _Sums()

        def out():
            keys, counts = sums.take()
            return packed(bucket_of(keys >> 32, keys & 0xFFFFFFFF, buckets), keys, counts)

        for _, _, _, data, offsets in _blocks(batches):
            hashes, first = _with_end(data, offsets)
            word, _ = vocabulary.find(hashes)
            context = np.empty_like(word)
            context[1:] = word[:-1]
            context[first[:-1]] = v
            sums.add(context << 32 | word)
            if sums.full:
                yield out()
        yield out()

    def triples(batches):
        vocabulary, sums = Words(folder, spec["shards"]), _Sums(2, FLUSH // 2)

        def out():
            context, word, counts = sums.take()
            return packed(triple_bucket(context, buckets), context, word, counts)

        for _, _, _, data, offsets in _blocks(batches):
            hashes, first = _with_end(data, offsets)
            word, _ = vocabulary.find(hashes)
            context = np.empty_like(word)
            context[1:] = word[:-1]
            context[first[:-1]] = v
            before = np.empty_like(word)
            before[1:] = context[:-1]
            before[first[:-1]] = v
            sums.add(before << 32 | context, word)
            if sums.full:
                yield out()
        yield out()

    def save_triples(batches):
        # pairs count the distinct words before them; a bucket hands on what it has seen of them
        for bucket, held in groups(batches, 3):
            sums = _Sums(2)
            for _, (context, word, counts) in held:
                sums.add(context, word, counts=counts)
            context, word, counts = sums.take()
            Triples.save(f"{folder}/triples-{bucket}", context, word, counts)
            kinds = [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [bucket]
            yield _batch(bucket=pa.array([-1], pa.int64()), kind=pa.array([3], pa.int64()), packed=pa.array([np.array(kinds, "<i8").tobytes()], pa.binary()))
            last = context & 0xFFFFFFFF
            keys, n = _summed((last << 32 | word,), np.where(last == v, counts, 1))
            yield packed(bucket_of(keys >> 32, keys & 0xFFFFFFFF, buckets), keys, n)

    width = max(1, -(-(v + 1) // parts))  # words in a range of the dense arrays

    def groups(batches, n_arrays):
        """The packed arrays of one bucket after another; rows are sorted by bucket."""
        last, held = None, []
        for batch in batches:
            for bucket, kind, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held and bucket != last:
                    yield last, held
                    held = []
                last = bucket
                held.append((kind, raw if n_arrays is None or bucket < 0 else unpack(raw, n_arrays)))
        if held:
            yield last, held

    def save_pairs(batches):
        # what a task's buckets say of contexts and of words goes on together, a row for each range of words
        contexts: list[tuple[np.ndarray, ...]] = []
        follows: list[tuple[np.ndarray, ...]] = []

        def out():
            for kind, held in enumerate((contexts, follows)):
                if held:
                    ids, *values = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.argsort(ids, kind="stable")
                    ids = ids[order]
                    begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                    yield packed(ids[begin] // width, ids[begin], *(np.add.reduceat(x[order], begin) for x in values), kind=kind)
                held.clear()

        for bucket, held in groups(batches, 2):
            if bucket < 0:  # what is known of triples as a whole goes on
                yield _batch(bucket=pa.array([-1] * len(held), pa.int64()), kind=pa.array([3] * len(held), pa.int64()), packed=pa.array([raw for _, raw in held], pa.binary()))
                continue
            sums = _Sums()
            for _, (keys, counts) in held:
                sums.add(keys, counts=counts)
            keys, counts = sums.take()
            _save(f"{folder}/pairs-{bucket}.key", keys)
            _save(f"{folder}/pairs-{bucket}.count", counts.astype(np.uint32))
            context, word = keys >> 32, keys & 0xFFFFFFFF
            begin = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
            contexts.append((context[begin], *(np.add.reduceat(x, begin) for x in (counts, (counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64)))))
            follows.append(np.unique(word, return_counts=True))
            if sum(len(x[0]) for x in (*contexts, *follows)) > 2 * FLUSH:
                yield from out()
            kinds = [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int((counts > 2).sum()), bucket]
            yield _batch(bucket=pa.array([-1], pa.int64()), kind=pa.array([2], pa.int64()), packed=pa.array([np.array(kinds, "<i8").tobytes()], pa.binary()))
        yield from out()

    def save_stats(batches):
        for bucket, held in groups(batches, None):
            start = bucket * width
            n = min(width, v + 1 - start)
            dense = np.zeros((5, n), np.int64)
            for kind, raw in held:
                ids, *values = unpack(raw, 5 if kind == 0 else 2)
                for k, x in enumerate(values):
                    np.add.at(dense[k if kind == 0 else 4], ids - start, x)
            for k, name in enumerate(("total", "n1", "n2", "n3", "follows")):
                _put(f"{folder}/{name}.dense", start, dense[k])
            yield _batch(n=pa.array([[int((dense[4] == k).sum()) for k in (1, 2, 3, 4)] + [int((dense[4] > 2).sum())]], pa.list_(pa.int64())))

    schema = "bucket long, kind long, packed binary"
    def bucketed(rows: DataFrame, worker: Callable) -> DataFrame:
        return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(worker, schema)

    with tables.shuffle_files_dropped(spark):
        counted = texts.mapInArrow(pairs, schema) if order == 2 else bucketed(texts.mapInArrow(triples, schema), save_triples)
        bucketed(counted, save_pairs).write.parquet(f"{uri}/stats")
        stats = spark.read.schema(schema).parquet(f"{uri}/stats")
        # one row for each bucket
        own, above = ([np.frombuffer(bytes(r[0]), "<i8") for r in stats.where(F.col("kind") == k).select("packed").collect()] for k in (2, 3))
        rest = stats.where("kind < 2").repartition(parts, "bucket").sortWithinPartitions("bucket")
        levels = [r[0] for r in rest.mapInArrow(save_stats, "n array<long>").collect()]  # one row for each range of words
    sums, low = (np.sum(own, axis=0), np.sum(levels, axis=0)) if own else (np.zeros(6), np.zeros(5))
    third = np.sum(above, axis=0) if above else np.zeros(5)
    spec |= {"n": [int(x) for x in sums[:4]], "kinds": [int(sums[0]), int(sums[1]), int(sums[4])], "n0": [int(x) for x in low[:4]], "kinds0": [int(low[0]), int(low[1]), int(low[4])], "filled": sorted(int(x[5]) for x in own)}
    spec |= {"order": order, "n3": [int(x) for x in third[:4]], "filled3": sorted(int(x[4]) for x in above)}
    return spec


_models: dict[str, Model] = {}


def _model(spec: dict) -> Model:
    if spec["folder"] not in _models:
        _models.clear()
        _models[spec["folder"]] = Model(spec)
    return _models[spec["folder"]]


def score(docs: DataFrame, spec: dict, *, key: str = "doc_id", text: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """key, the columns of keep, n_tokens, n_known, base_score and score of each text."""
    keep = list(keep)
    fields = [docs.schema[c] for c in (key, *keep)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens long, n_known long, base_score double, score double"])
    names = [f.name for f in fields] + ["n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        model = _model(spec)
        for batch, a, b, data, offsets in _blocks(batches, len(fields)):
            found = [pa.array(x) for x in model.score(data, offsets)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(fields))), *found], names=names)

    return docs.select(*(F.col(f"`{f.name}`") for f in fields), F.col(f"`{text}`").cast("string").alias(tables.unused(docs.columns) + "text")).mapInArrow(run, schema)


def perplexity(score_column: str = "score", tokens: str = "n_tokens") -> Column:
    return F.pow(F.lit(10.0), -F.col(score_column) / F.col(tokens))
