"""Operator 12: ranked lexical search by trees of maxima over ranges of documents.

One pass reads every text and keeps, for each document, its number of terms and how often it holds the terms
that some item asks for. Sums over these rows give the collection's statistics. A second pass takes ranges of
CHUNK documents as they lie in the stored table, without a shuffle: for each term it builds a tree of
its largest contributions over ranges, FAN to a node, down to single documents. For all items at once a
best-first search opens the ranges of highest summed bounds, those of equal bound with the k-th score too, as
a tie may go to a smaller doc_id there; ranges of lower bound stay closed. A task keeps k documents an item,
and these lists are merged.

Items are searched in batches of about ``batch_terms`` terms, each over all documents, so what is broadcast
stays bounded however many items there are; batches don't change results.

Defined cases: a null text has no terms, an item without terms or without documents no rows; items that
repeat an item_id are one item with the terms of all of them; rows that repeat a doc_id are documents of
their own, each counted and ranked, in no fixed order where score and doc_id are equal; a null doc_id counts
like any other and is ranked last among equal scores. Columns besides those named are not read.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tables
from .textblocks import LOWER, ranges, spans_hash, text_blocks, trim, words

#: Fixed value: a term is a longest run of letters, digits and characters beyond ASCII.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_BETWEEN = np.ones(256, bool)
_BETWEEN[[ord(c) for c in string.ascii_letters + string.digits]] = False
_BETWEEN[128:] = False
CHUNK = 4096  # documents of one tree
ENTRIES = 1 << 20  # postings after which a tree is full
FAN = 16
WAVE = 8  # ranges that an item opens at a time
GROUP = 512  # items that descend together


class Terms:
    """Numbers of known terms among the words of a block, told by hash and then by their bytes."""

    def __init__(self, known: list[bytes]):
        data = np.frombuffer(b"".join(known), np.uint8)
        ends = np.cumsum([len(t) for t in known], dtype=np.int64)
        starts = ends - np.array([len(t) for t in known], np.int64)
        hashes = spans_hash(data, starts, ends) if known else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.data = hashes[self.order], data
        self.starts, self.lengths = starts[self.order], (ends - starts)[self.order]

    def find(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each low[start:end], -1 where it is unknown."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.hashes) or not len(starts):
            return out
        h = spans_hash(low, starts, ends)
        at = np.searchsorted(self.hashes, h)
        rows = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == h)
        while len(rows):
            place, length = at[rows], ends[rows] - starts[rows]
            same = self.lengths[place] == length
            some = np.flatnonzero(same)
            differ = low[ranges(starts[rows[some]], length[some])] != self.data[ranges(self.starts[place[some]], length[some])]
            same[some[np.repeat(np.arange(len(some)), length[some])[differ]]] = False
            out[rows[same]] = self.order[place[same]]
            rows = rows[~same]  # another term may have that hash
            at[rows] += 1
            rows = rows[at[rows] < len(self.hashes)]
            rows = rows[self.hashes[at[rows]] == h[rows]]
        return out


def postings(docs: DataFrame, known: list[bytes]) -> DataFrame:
    """doc_id, n (terms of the document), terms and tfs (known ones and how often), for documents with any term."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # of one batch of items

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Terms(shared.value)
        size = max(1, len(shared.value))
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(1)):
                low = LOWER[data]
                starts, ends, first = words(low, offsets, _BETWEEN)
                n = np.diff(first)
                number = finder.find(low, starts, ends)
                hit = number >= 0
                code, tf = np.unique(np.repeat(np.arange(b - a), n)[hit] * size + number[hit], return_counts=True)
                bounds = np.searchsorted(code, np.arange(b - a + 1) * size).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x, pa.int32())) for x in (code % size, tf)]
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))
            trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(read, "doc_id long, n long, terms array<int>, tfs array<int>")


class Tree:
    """For each term the largest contribution in each range of documents; entries of all levels lie in one array, leaves first."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray):
        order = np.lexsort((doc, term))
        node, term, value = doc[order], term[order], value[order]
        nodes, terms, values, begins, counts = [node], [term], [value], [np.zeros(len(node), np.int64)], [np.zeros(len(node), np.int64)]
        below, self.levels = 0, 0
        while len(node) and (node.max() > 0 or not self.levels):
            size = len(node)
            up = node // FAN
            new = np.flatnonzero(np.concatenate([[True], (up[1:] != up[:-1]) | (term[1:] != term[:-1])]))
            node, term, value = up[new], term[new], np.maximum.reduceat(value, new)
            nodes.append(node), terms.append(term), values.append(value)
            begins.append(below + new), counts.append(np.diff(np.append(new, size)))
            below += size
            self.levels += 1
        self.root, self.root_terms = below, term  # one entry a term at the top
        self.node, self.term, self.value, self.begin, self.count = (np.concatenate(x) for x in (nodes, terms, values, begins, counts))

    def roots(self, terms: np.ndarray) -> np.ndarray:
        """The entries of those of the terms that the tree has."""
        at = np.searchsorted(self.root_terms, terms)
        at = at[self.root_terms[np.minimum(at, len(self.root_terms) - 1)] == terms]
        return self.root + at


class Best:
    """The k best (score, doc_id) of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.items = k, items
        self.item, self.score, self.id, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.floor = np.ones(items, np.int64)  # only scores above 0 count

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        good = score >= self.floor[item]
        if not good.any():
            return
        item, score, ids, none = (np.concatenate(x) for x in ((self.item, item[good]), (self.score, score[good]), (self.id, ids[good]), (self.none, none[good])))
        order = np.lexsort((ids, none, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[rank < self.k]
        self.floor[item[rank == self.k - 1]] = score[order[rank == self.k - 1]]
        self.item, self.score, self.id, self.none = item[rank < self.k], score[kept], ids[kept], none[kept]


def descend(tree: Tree, best: Best, wanted: list[tuple[int, np.ndarray]], weight: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
    """Best-first search of one tree for some (item, terms): each time every item opens its WAVE ranges of highest bound."""
    entries = [tree.roots(terms) for _, terms in wanted]
    count = np.array([len(e) for e in entries], np.int64)
    pool = np.concatenate([*entries, np.zeros(0, np.int64)])
    start = np.cumsum(count) - count
    item = np.array([i for i, _ in wanted], np.int64)
    bound = np.zeros(len(item), np.int64)
    np.add.at(bound, np.repeat(np.arange(len(item)), count), weight[tree.term[pool]] * tree.value[pool])
    level = np.full(len(item), tree.levels)
    while True:
        order = np.flatnonzero((bound >= best.floor[item]) & (count > 0))
        if not len(order):
            return
        order = order[np.lexsort((-bound[order], item[order]))]
        own = item[order]
        rank = np.arange(len(order)) - np.searchsorted(own, own)
        now, later = order[rank < WAVE], order[rank >= WAVE]
        # the children of what is opened, summed by range
        opened = pool[ranges(start[now], count[now])]
        of = np.repeat(np.arange(len(now)), count[now])
        below = ranges(tree.begin[opened], tree.count[opened])
        code = np.repeat(of, tree.count[opened]) * FAN + tree.node[below] % FAN
        by_code = np.argsort(code, kind="stable")
        below, code = below[by_code], code[by_code]
        new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        sums = np.add.reduceat(weight[tree.term[below]] * tree.value[below], new)
        parent = now[code[new] // FAN]
        leaf = level[parent] == 1
        documents = tree.node[below[new[leaf]]]
        best.add(item[parent[leaf]], sums[leaf], ids[documents], none[documents])  # a document's bound is its score
        inner = ~leaf
        sizes = np.diff(np.append(new, len(below)))
        # what is still closed, old and new, with its entries
        kept, made = ranges(start[later], count[later]), ranges(new[inner], sizes[inner])
        pool = np.concatenate([pool[kept], below[made]])
        item = np.concatenate([item[later], item[parent[inner]]])
        level = np.concatenate([level[later], level[parent[inner]] - 1])
        bound = np.concatenate([bound[later], sums[inner]])
        count = np.concatenate([count[later], sizes[inner]])
        start = np.cumsum(count) - count


def ranked(posted: DataFrame, wanted: list[tuple[int, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item (its number in wanted), doc_id and score: the k best of each item and task."""
    shared = posted.sparkSession.sparkContext.broadcast((wanted, weight))  # of one batch of items

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w = shared.value
        best = Best(len(items), k)

        def search(held: list[pa.RecordBatch]) -> None:
            for batch in [pa.Table.from_batches(held).combine_chunks().to_batches()[0]] if held else []:
                none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = batch.column(0).fill_null(0).to_numpy()
                n = batch.column(1).to_numpy()
                term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                doc = np.repeat(np.arange(len(ids)), batch.column(2).value_lengths().to_numpy())
                if not len(doc):
                    continue
                m = 100 - 90 + (90 * n * n_docs) // n_terms
                tree = Tree(doc, term, (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                for a in range(0, len(items), GROUP):
                    descend(tree, best, items[a : a + GROUP], w, ids, none)

        held: list[pa.RecordBatch] = []
        size = rows = 0
        for big in batches:
            for a in range(0, big.num_rows, 256):
                batch = big.slice(a, 256)
                held.append(batch)
                rows += batch.num_rows
                size += len(batch.column(2).flatten())
                if rows >= CHUNK or size >= ENTRIES:
                    search(held)
                    held, size, rows = [], 0, 0
        search(held)
        ids = pa.array(best.id, pa.int64(), mask=best.none)
        yield pa.RecordBatch.from_arrays([pa.array(best.item), ids, pa.array(best.score)], names=["item", "doc_id", "score"])
        trim()

    return posted.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, *, k: int = 10, batch_terms: int = 1 << 18) -> DataFrame:
    """docs (doc_id, text), items (item_id, text): item_id, rank, doc_id and score of the k best documents of each item."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    terms = items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(TERM), 0))).alias("term")).groupBy("item_id", "term").agg(F.lit(1).alias("one"))
    asked = tables.stored(terms.groupBy("item_id").agg(F.collect_list("term").alias("terms")))  # an item's own terms
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    batches = -(-total // batch_terms)
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for b in range(batches):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == b).orderBy("item_id").collect()  # about batch_terms terms
        known = sorted({t for r in rows for t in r.terms})
        number = {t: i for i, t in enumerate(known)}
        posted = tables.stored(postings(docs, [t.encode() for t in known]))
        n_docs, n_terms = posted.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        df = np.zeros(len(known), np.int64)
        for term, count in posted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the batch at most
            df[term] = count
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        wanted = [(i, np.array(sorted(number[t] for t in r.terms), np.int64)) for i, r in enumerate(rows)]
        found = ranked(posted, wanted, weight, n_docs, n_terms, k)
        names = F.broadcast(spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item long, item_id {kind}"))  # the items of this batch
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = out.unionByName(top.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out
