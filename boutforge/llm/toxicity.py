"""Operator 10: toxicity by noisy-channel restoration and a linear model over restored words.

Words that may be disguised (a letter with a digit or symbol before, in or after it, three or more of a
letter, parts set apart by dots or dashes, single letters by spaces) become a character lattice: each
sign offers the letters it may stand for, each run of a letter a shorter run, each gap its removal.
Viterbi decoding under a character trigram model, counted over all texts, picks the restored words.
Symbols about a word may be punctuation, so it is decoded with and without them; a lattice of more than
WINDOW units is decoded in overlapping windows. A logistic model over the words of a text, plain and
restored, gives the score.

Labels come from a bounded sample of labelled rows (``max_labelled``, by hash of doc_id); all else,
the character counts and the scores, covers every text.

Defined cases: a null or empty text has no words, so its score is the model's intercept; without
usable labels of both kinds the score is the share of label 1 among those there are (0.0 without any);
label rows with a null doc_id or label are ignored, repeated ones count once by their highest label;
rows that repeat a labelled doc_id are documents of their own, each learnt from and each scored.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables
from .textblocks import LOWER, giving_back, spans_hash, text_blocks, trim, words

#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
WINDOW = 48  # units of a lattice that are decoded together
ROW = 32  # single letters that form one lattice
KNOWN_BYTES = 16 << 20  # of restored words that a task keeps
#: Channel costs, in nats.
SUBSTITUTE, KEEP_SIGN, SHORTEN, KEEP_RUN, DROP_GAP, KEEP_GAP = 1.0, 8.0, 0.7, 3.0, 0.4, 2.5

#: Among these the evidence that a word needs is chosen.
EVIDENCE = (5.0, 7.0, 9.0)

CLASSES = 43  # 0 ends a word; a-z; 16 for the bytes of other letters
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27 + (np.arange(128, 256) & 15)
_LETTER = _CLASS > 0
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LEET if ord(c) < 128]] = True
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in "._-*~,/"]] = True
_EDGE = "".join(c for c in LEET if ord(c) < 128 and not c.isdigit()) + "._-*~,/"
_SPLIT = re.compile(r"[^\W\d_]+")


class CharacterModel:
    """Interpolated trigram costs over character classes."""

    def __init__(self, counts: np.ndarray):
        c = counts.astype(float).reshape(CLASSES, CLASSES, CLASSES)
        one = c.sum((0, 1)) + 0.5
        one /= one.sum()
        two = c.sum(0) + 10 * one
        two /= two.sum(1, keepdims=True)
        three = c + 10 * two[None]
        three /= three.sum(2, keepdims=True)
        self.cost = -np.log(three)
        self.table = self.cost.tolist()


@functools.cache
def _classes(text: str) -> tuple[int, ...]:
    return tuple(int(_CLASS[byte]) for byte in text.encode())


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """The alternatives of each unit of a disguised word, with channel costs; an empty text drops it."""
    units: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(word):
        c = word[at]
        end = at
        while end < len(word) and word[end] == c:
            end += 1
        n = end - at
        if c in LEET:
            letters = [(x, SUBSTITUTE + SHORTEN * (n > 1)) for x in LEET[c]]
            if n > 1:
                letters += [(x * 2, 2 * SUBSTITUTE) for x in LEET[c]]
            units.append([*letters, (" ", KEEP_SIGN)])
        elif c.isalpha():
            units.append([(c, SHORTEN * (n > 1)), *([(c * 2, 0.0 if n == 2 else SHORTEN)] if n > 1 else []), *([(c * n, KEEP_RUN)] if n > 2 else [])])
        else:
            units.append([("", DROP_GAP), (" ", KEEP_GAP)])
        at = end
    return units


def decode(units: list[list[tuple[str, float]]], model: CharacterModel, ends: set[int]) -> list[str]:
    """The cheapest paths through the units up to each of the ends (Viterbi over the last two characters)."""
    table = model.table
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    out = []
    for at, unit in enumerate(units, 1):
        steps = [(alternative, extra, _classes(alternative)) for alternative, extra in unit]
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (x, y), (cost, text) in best.items():
            for alternative, extra, classes in steps:
                a, b, total = x, y, cost + extra
                for k in classes:
                    total += table[a][b][k]
                    a, b = b, k
                have = new.get((a, b))
                if have is None or total < have[0] or (total == have[0] and text + alternative < have[1]):
                    new[a, b] = (total, text + alternative)
        best = new
        if at in ends:
            out.append(min((cost + table[a][b][0], text) for (a, b), (cost, text) in best.items())[1])
    return out


def restore(word: str, model: CharacterModel) -> list[str]:
    """What the word may stand for: one text for each choice of how many of the symbols about it belong to it."""
    solid = [k for k, c in enumerate(word) if c.isalnum() or ord(c) > 127]
    if not solid:
        return []
    head, core, tail = word[: solid[0]], word[solid[0] : solid[-1] + 1], word[solid[-1] + 1 :]
    head = head[len(head.rstrip(_EDGE)) :]
    tail = tail[: len(tail) - len(tail.lstrip(_EDGE))]
    before, inner, after = lattice(head), lattice(core), lattice(tail)
    units = before + inner + after
    first, last = len(before), len(before) + len(inner)
    sign = lambda unit: unit[0][0] != ""
    begins = {k for k, u in enumerate(before) if sign(u)} | {first}
    ends = {last + k for k, u in enumerate(after, 1) if sign(u)} | {last}
    out: list[str] = []
    for a in range(0, max(1, len(units) - WINDOW // 2), WINDOW // 2):
        b = min(len(units), a + WINDOW)
        if b <= first or a >= last:  # symbols alone
            continue
        stops = {e for e in ends if a < e < b} | {b}
        for begin in sorted({k for k in begins if a < k < b} | {a}):
            out += decode(units[begin:b], model, {e - begin for e in stops if e > begin})
    return out


class Reader:
    """Words of texts, plain and restored, as numbers of distinct (document, word)."""

    def __init__(self, model: CharacterModel):
        self.model = model
        self.known: dict[bytes, tuple[bytes, ...]] = {}
        self.held = 0

    def restored(self, raw: bytes) -> tuple[bytes, ...]:
        if raw not in self.known:
            self.held += len(raw) + 200  # the entry's objects, about
            if self.held > KNOWN_BYTES:
                self.known.clear()
                self.held = len(raw) + 200
            texts = restore(raw.decode("utf-8", "ignore"), self.model)
            self.known[raw] = tuple(dict.fromkeys(w.encode() for text in texts for w in _SPLIT.findall(text) if len(w) > 2))
        return self.known[raw]

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, tuple[bytes, ...]]], bytes]:
        """Starts, ends, documents and hashes of plain words; (document, restored words); the bytes."""
        low = LOWER[data]
        raw = low.tobytes()
        starts, ends, first = words(low, offsets)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        if not len(starts):
            return starts, ends, doc, np.zeros(0, np.uint64), [], raw
        solid = _LETTER[low] | _DIGIT[low]
        sign, letter = self._signs(low)
        begin, last = self._trimmed(solid, starts, ends)
        out: list[tuple[int, tuple[bytes, ...]]] = []
        count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        letters, signs, gaps = count(letter), count(sign), count(_GAP[low])
        run = np.zeros(len(low), bool)
        if len(low) > 2:
            run[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & (low[2:] < 128) & _LETTER[low[2:]]
        runs = count(run)
        some_letter = letters[last] > letters[begin]
        disguised = some_letter & ((signs[ends] > signs[starts]) | (runs[last] - runs[np.minimum(begin + 2, last)] > 0) | (gaps[last] > gaps[begin]))
        for k in np.flatnonzero(disguised).tolist():
            if found := self.restored(raw[starts[k] : ends[k]]):
                out.append((int(doc[k]), found))
        out += self._spaced(low, raw, starts, ends, begin, last, doc)
        solid_words = last > begin
        begin, last, doc = begin[solid_words], last[solid_words], doc[solid_words]
        return begin, last, doc, spans_hash(low, begin, last), out, raw

    @staticmethod
    def _trimmed(solid: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word from its first to its last letter or digit."""
        n = len(solid)
        at = np.arange(n)
        following = np.minimum.accumulate(np.where(solid, at, n)[::-1])[::-1]
        preceding = np.maximum.accumulate(np.where(solid, at, -1))
        return np.minimum(following[starts], ends), np.maximum(preceding[ends - 1] + 1, np.minimum(following[starts], ends))

    @staticmethod
    def _signs(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes begin a sign, and which are letters and no part of one."""
        sign, letter = _SIGN[low], _LETTER[low]
        for wide in (c.encode() for c in LEET if ord(c) > 127):
            at = np.flatnonzero(low[: len(low) - len(wide) + 1] == wide[0]) if len(low) >= len(wide) else np.zeros(0, np.int64)
            for k in range(1, len(wide)):
                at = at[low[at + k] == wide[k]]
            sign[at] = True
            for k in range(len(wide)):
                letter[at + k] = False
        return sign, letter

    def _spaced(self, low: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, last: np.ndarray, doc: np.ndarray) -> list[tuple[int, tuple[bytes, ...]]]:
        """Three or more single letters, digits or symbols in a row form one lattice; very long rows are cut in overlapping pieces."""
        characters = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
        bare = last == begin
        a, b = np.where(bare, starts, begin), np.where(bare, ends, last)
        single = np.flatnonzero((characters[b] - characters[a] == 1) & (~bare | _SIGN[low[starts]]))
        if len(single) < 3:
            return []
        out = []
        breaks = np.flatnonzero((np.diff(single) != 1) | (np.diff(doc[single]) != 0)) + 1
        for part in np.split(single, breaks):
            if len(part) >= 3:
                for at in range(0, max(1, len(part) - ROW // 2), ROW // 2):
                    text = b"-".join(raw[a[k] : b[k]] for k in part[at : at + ROW])
                    out.append((int(doc[part[0]]), self.restored(text)))
        return out


def character_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each three classes follow one another, over all texts; each task sums its own."""
    slices, size = 16, CLASSES**3
    cuts = np.linspace(0, size, slices + 1).astype(int)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                c = np.zeros(len(data) + 2, np.int64)
                c[2:] = _CLASS[data]
                code = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
                total += np.bincount(code, minlength=size)
            trim()
        rows = [total[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array(rows, pa.list_(pa.int64()))], names=["slice", "n"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, row in enumerate(batch.column(0).to_pylist()):
                values = batch.column(1)[k].values.to_numpy()
                total[row] = total[row] + values if row in total else values
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.int64()))], names=["slice", "n"])

    schema = "slice int, n array<long>"
    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(giving_back(count), schema).repartition(slices, "slice").mapInArrow(giving_back(add), schema)
    found = np.zeros(size, np.int64)
    for k, row in rows.collect():  # 16 rows of fixed length
        found[cuts[k] : cuts[k + 1]] += np.array(row, np.int64)
    return found


def fit(rows: list[tuple[int, list[int]]], n_features: int, *, steps: int = 400, l2: float = 0.02, rate: float = 0.5) -> tuple[float, np.ndarray]:
    """Logistic weights of present features by full-batch Adam; deterministic."""
    label = np.array([y for y, _ in rows], float)
    feature = np.array([i for _, x in rows for i in x], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(x) for _, x in rows])
    w = np.zeros(n_features + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.clip(w[-1] + np.bincount(row, w[feature], len(rows)), -30, 30)
        error = 1 / (1 + np.exp(-z)) - label
        g = np.append(np.bincount(feature, error[row], n_features), error.sum()) + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return float(w[-1]), w[:-1]


def chosen_evidence(rows: list[tuple[bool, int, list[int]]], told: np.ndarray) -> float:
    """Of EVIDENCE, that under which rows held back from the sample are likeliest when words and weights come from the rest.

    rows: (held back, label, words by number); told: each word's evidence in the rest. Ties go to the stricter one.
    """
    seen, back = [r[1:] for r in rows if not r[0]], [r[1:] for r in rows if r[0]]
    if len({y for y, _ in seen}) < 2 or not back:
        return max(EVIDENCE)
    best = (math.inf, max(EVIDENCE))
    for e in sorted(EVIDENCE, reverse=True):
        number = np.where(told > e, np.cumsum(told > e) - 1, -1)
        listed = lambda part: [(y, number[x][number[x] >= 0].tolist()) for y, x in ((y, np.array(x, np.int64)) for y, x in part)]
        bias, weights = fit(listed(seen), int((told > e).sum()))
        z = np.array([bias + weights[x].sum() for _, x in listed(back)])
        y = np.array([y for y, _ in back])
        best = min(best, (float(np.logaddexp(0, np.where(y == 1, -z, z)).mean()), e), key=lambda found: found[0])
    return best[1]


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000, evidence: float | None = None) -> dict:
    """docs (doc_id, text): all texts; labels (doc_id, toxic): the rows to learn from, at most max_labelled of them.

    Features are all words of the sample whose spread over the two labels gives that much evidence: the log
    likelihood ratio against a word that goes with neither. With fewer texts than that takes, no word is one.
    How much evidence, unless it is given, is chosen within the sample: a quarter of it, by hash, is held back.
    """
    spark = docs.sparkSession
    counts = character_counts(docs)
    labelled = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = docs.select("doc_id", "text").join(labelled, "doc_id").select("toxic", F.col("text").cast("string").alias("text"), F.xxhash64("doc_id").alias("h"))
    bound = labelled.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(max_labelled).agg(F.max("h")).first()[0]
    # dealt anew, as reading words takes longer than reading files
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    back = (F.pmod(F.col("h"), F.lit(4)) == 0).cast("long")
    sample = tables.stored(chosen.where(F.col("h") <= (bound if bound is not None else 0)).repartition(parts, "h").select("toxic", "text", back.alias("back")))
    shared = spark.sparkContext.broadcast(counts)  # fixed length

    def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(CharacterModel(shared.value))
        found: dict[bytes, list[int]] = {}
        for batch in batches:
            place = batch.column(0).to_numpy() + 2 * batch.column(2).to_numpy()
            for a, b, data, offsets in text_blocks(batch.column(1)):
                begin, last, doc, h, restored, raw = reader.read(data, offsets)
                _, one = np.unique(np.stack([doc, h.view(np.int64)]), axis=1, return_index=True) if len(h) else (None, [])
                pairs = {(int(doc[k]), raw[begin[k] : last[k]]) for k in one}
                pairs |= {(d, w) for d, ws in restored for w in ws}
                for d, w in pairs:
                    found.setdefault(w, [0, 0, 0, 0])[place[a:b][d]] += 1
        some = list(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), *(pa.array([found[w][k] for w in some], pa.int64()) for k in range(4))], names=["word", "neg", "pos", "neg_back", "pos_back"])

    totals = sample.agg(F.count("*"), F.sum("toxic"), F.sum("back"), F.sum(F.col("back") * F.col("toxic"))).first()
    n, p, n_back, p_back = (int(x or 0) for x in totals)
    spec = {"counts": counts, "words": [], "weights": np.zeros(0), "bias": -math.inf if not p else math.inf if p == n else math.log(p / (n - p))}
    if not p or p == n:
        return spec
    summed = [F.sum(c).alias(c) for c in ("neg", "pos", "neg_back", "pos_back")]
    by_word = sample.mapInArrow(giving_back(count_words), "word binary, neg long, pos long, neg_back long, pos_back long").groupBy("word").agg(*summed)

    def told(neg: Column, pos: Column, rate: float) -> Column:
        share = lambda part, base: F.when(part > 0, part * F.log(part / ((pos + neg) * F.lit(base)))).otherwise(0.0)
        return share(pos, rate) + share(neg, 1 - rate)

    seen = told(F.col("neg"), F.col("pos"), (p - p_back) / max(1, n - n_back)) if 0 < p - p_back < n - n_back else F.lit(0.0)
    both = told(F.col("neg") + F.col("neg_back"), F.col("pos") + F.col("pos_back"), p / n)
    least = min(EVIDENCE) if evidence is None else evidence
    listed_words = by_word.select("word", seen.alias("seen"), both.alias("told")).where(F.greatest("seen", "told") > least).orderBy("word").collect()  # of at most max_labelled texts
    if not listed_words:
        return spec
    shared_words = spark.sparkContext.broadcast([bytes(r.word) for r in listed_words])  # words of at most max_labelled texts

    def present(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value, shared_words.value)
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(1)):
                doc, feature = finder.find(data, offsets)
                found = np.split(feature, np.searchsorted(doc, np.arange(1, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(a, b - a), batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array([x.tolist() for x in found], pa.list_(pa.int64()))], names=["back", "toxic", "features"])

    rows = sorted((bool(r.back), int(r.toxic), list(r.features)) for r in sample.mapInArrow(giving_back(present), "back long, toxic long, features array<long>").collect())  # at most max_labelled short rows
    if evidence is None:
        evidence = chosen_evidence(rows, np.array([r.seen for r in listed_words]))
    number = {k: i for i, k in enumerate(k for k, r in enumerate(listed_words) if r.told > evidence)}
    spec["evidence"] = evidence
    if not number:
        return spec
    bias, weights = fit(sorted((y, [number[k] for k in x if k in number]) for _, y, x in rows), len(number))
    return spec | {"words": [bytes(listed_words[k].word) for k in number], "weights": weights, "bias": bias}


class Finder:
    """Distinct (document, feature) of a block of texts."""

    def __init__(self, counts: np.ndarray, features: list[bytes]):
        self.reader = Reader(CharacterModel(counts))
        self.number = {w: k for k, w in enumerate(features)}
        data = np.frombuffer(b"".join(features), np.uint8)
        ends = np.cumsum([len(w) for w in features], dtype=np.int64)
        hashes = spans_hash(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if features else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, _, doc, h, restored, _ = self.reader.read(data, offsets)
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        more = [(d, self.number[w]) for d, ws in restored for w in ws if w in self.number]
        code = np.concatenate([doc[hit] * len(self.hashes) + self.order[at[hit]], np.array([d * len(self.hashes) + k for d, k in more], np.int64)])
        code = np.unique(code)
        return code // len(self.hashes), code % len(self.hashes)


def score(docs: DataFrame, spec: dict, *, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of each text (0 to 1); a column already named so is replaced."""
    tables.small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != out]
    names = [f.name for f in kept]
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # counts of fixed length, words of at most max_labelled texts
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{out}` double"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        finder = Finder(s["counts"], s["words"])
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(batch.num_columns - 1)):
                doc, feature = finder.find(data, offsets)
                z = s["bias"] + np.bincount(doc, s["weights"][feature], b - a) if len(doc) else np.full(b - a, s["bias"])
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                p = np.where(z == -np.inf, 0.0, np.where(z == np.inf, 1.0, p))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(names))), pa.array(p)], names=[*names, out])
            trim()

    return docs.select(*(F.col(f"`{n}`") for n in names), F.col(f"`{text}`").cast("string").alias(tables.unused(docs.columns) + "text")).mapInArrow(giving_back(run), schema)
