"""Operator 11: document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line is told by binned measures (lengths, signs, capitals, digits, repetition of
words and lines, how it ends) of its own and of the lines before and after it; each bin has a weight, and
each pair of labels of neighbouring lines another. Forward-backward gives each line's probability of being
good; their mean weighted by length, put through a logistic curve, is the document's score.

Labels are of documents, not lines. A good document says that all its lines are good, a bad one that lines of
more than half of its length are bad, and the field finds which (posterior regularisation). The sample is bounded: at most
``max_labelled`` labelled documents, the first ones by hash of doc_id, of at most ``max_lines`` lines each and
``max_total`` together. Weights come from that sample; all texts are scored, whole.

Forward and backward messages are products of 2 x 2 matrices, taken by doubling over all lines of a block at
once: a first line's matrix forgets what came before, so documents need no separate loops.

Defined cases: a null or empty text has one empty line and gets its score like any other; without usable
labels of both kinds the score is the share of label 1 among those there are (0.0 without any); label rows
with a null doc_id or another label than 0 and 1 are ignored, repeated ones count once by their highest
label, repeated documents with one label count in the sample each; a column named as the score is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from .textblocks import LOWER, mix, spans_hash, text_blocks, trim, words

#: A line's measures and where their bins are cut.
CUTS: dict[str, tuple[float, ...]] = {
    "characters": (1, 20, 60, 120, 300, 1000),
    "words": (1, 2, 5, 10, 30, 100),
    "signs": (0.0001, 0.02, 0.05, 0.1, 0.2, 0.4),
    "words with signs": (0.0001, 0.1, 0.3, 0.6, 0.9),
    "words of signs": (0.0001, 0.1, 0.3),
    "capitals": (0.0001, 0.05, 0.15, 0.4, 0.8),
    "digits": (0.0001, 0.05, 0.2, 0.5),
    "word as before": (0.0001, 0.1, 0.3, 0.6),
    "words met before": (0.1, 0.3, 0.5, 0.7, 0.9),
    "word length": (2, 3, 4, 5, 7, 10, 20),
    "end": (0.5, 1.5, 2.5),  # nothing, a sentence's end, a letter or digit, another sign
    "line met before": (0.5,),
}
BINS = [len(c) + 2 for c in CUTS.values()]  # the last one: no such line
WIDTH = len(BINS)
_FIRST = np.cumsum([0, *BINS * 3])
N_FEATURES = int(_FIRST[-1])

_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "#$%&*|!<>=_~^@{}[]\\/+"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END = np.full(256, 3, np.int8)
_END[_LETTER | _DIGIT] = 2
_END[128:] = 2
_END[[ord(c) for c in ".?!"]] = 1


def line_bins(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bins of each line's measures (a row each), the first line of each document, and lines' lengths in characters."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    breaks_of = np.searchsorted(breaks, offsets)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")  # a document begins a line, and so does each break
    first = np.arange(n_docs + 1) + breaks_of
    end = np.append(begin[1:], offsets[-1])
    end[np.setdiff1d(np.arange(len(begin)), first[1:] - 1)] -= 1  # without the break
    doc = np.repeat(np.arange(n_docs), np.diff(first))

    def within(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[end] - sums[begin]

    low = LOWER[data]
    starts, ends, _ = words(low, offsets)
    word = np.searchsorted(starts, np.stack([begin, end]))  # a word never crosses a break
    n_words = word[1] - word[0]

    def of_words(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[word[1]] - sums[word[0]]

    h = spans_hash(low, starts, ends)
    word_doc = np.searchsorted(offsets[1:], starts, "right")
    again = np.ones(len(starts), bool)
    again[np.unique(mix(h + word_doc.astype(np.uint64)), return_index=True)[1]] = False
    same = np.zeros(len(starts), bool)
    same[1:] = h[1:] == h[:-1]
    inner = np.ones(len(starts), bool)
    inner[word[0][n_words > 0]] = False  # a line's first word follows none
    signs = np.concatenate([[0], np.cumsum(_SIGN[data])])
    in_word = signs[ends] - signs[starts]
    met = np.ones(len(begin), bool)
    met[np.unique(mix(spans_hash(low, begin, end) + doc.astype(np.uint64)), return_index=True)[1]] = False
    last = np.zeros(len(begin), np.int64)
    some = n_words > 0
    last[some] = _END[data[ends[word[1][some] - 1] - 1]]

    characters = within((data & 0xC0) != 0x80)
    per_character, per_word = np.maximum(characters, 1), np.maximum(n_words, 1)
    values = {
        "characters": characters,
        "words": n_words,
        "signs": within(_SIGN[data]) / per_character,
        "words with signs": of_words(in_word > 0) / per_word,
        "words of signs": of_words(in_word == ends - starts) / per_word,
        "capitals": within(_UPPER[data]) / np.maximum(within(_LETTER[data]), 1),
        "digits": within(_DIGIT[data]) / per_character,
        "word as before": of_words(same & inner) / per_word,
        "words met before": of_words(again) / per_word,
        "word length": characters / per_word,
        "end": last,
        "line met before": met & some,
    }
    bins = np.stack([np.searchsorted(cuts, values[name], "right") for name, cuts in CUTS.items()], axis=1).astype(np.uint8)
    return bins, first, characters


def features(bins: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Numbers of the features of each line: its own bins, and those of the lines before and after it."""
    none = np.array(BINS, np.uint8) - 1
    before, after = np.empty_like(bins), np.empty_like(bins)
    before[1:], after[:-1] = bins[:-1], bins[1:]
    before[first[:-1]], after[first[1:] - 1] = none, none
    return np.concatenate([bins, before, after], axis=1).astype(np.int64) + _FIRST[:-1]


def _doubled(m: np.ndarray, longest: int) -> np.ndarray:
    """Row k: m[k - longest + 1] ... m[k] multiplied, each scaled; m is (2, 2, n)."""
    step = 1
    while step < longest:
        a, b = m[:, :, :-step], m[:, :, step:]
        new = a[:, 0, None, :] * b[None, 0] + a[:, 1, None, :] * b[None, 1]
        new /= new.max(axis=(0, 1))
        m = np.concatenate([m[:, :, :step], new], axis=2)
        step *= 2
    return m


def messages(score: np.ndarray, pair: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and P(each pair of labels) of each line and the one before (2, 2, n; 0 for a first line).

    score: each line's for good, against 0 for bad; pair[a, b]: the score of b (0 good, 1 bad) after a.
    """
    n = len(score)
    longest = int(np.diff(first).max(initial=1))
    top = np.maximum(score, 0)
    emit = np.exp(np.stack([score - top, -top]))
    move = np.exp(pair)
    m = move[:, :, None] * emit[None]
    m[:, :, first[:-1]] = emit[None, :, first[:-1]]
    forward = _doubled(m, longest)[0]
    forward = forward / forward.sum(0)  # P(label | lines so far)
    back = np.ones_like(m)
    back[:, :, :-1] = m[:, :, 1:]
    back[:, :, first[1:] - 1] = 1
    # the reverse order multiplies from the other side, so with transposes
    backward = _doubled(back[:, :, ::-1].transpose(1, 0, 2), longest)[0, :, ::-1]
    good = forward * backward
    good = good[0] / good.sum(0)
    before = np.zeros((2, n))
    before[:, 1:] = forward[:, :-1]
    before[:, first[:-1]] = 0
    both = before[:, None] * m * backward[None]
    total = both.sum((0, 1))
    both /= np.where(total > 0, total, 1)
    return good, both


def fit(bins: np.ndarray, first: np.ndarray, characters: np.ndarray, label: np.ndarray, *, bad_share: float = 0.6, steps: int = 150, rate: float = 0.1, l2: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and pairs of labels (full-batch Adam; deterministic).

    The lines of a good document are to be good. In a bad one those are to be bad that the field finds
    worst, until they make up bad_share of its length: its lines' scores are lowered together (dual ascent
    on the constraint), and the field is drawn to the probabilities that it gives under lowered scores.
    """
    index = features(bins, first)
    lines = np.diff(first)
    length = characters + 1.0
    share = length / np.repeat(np.add.reduceat(length, first[:-1]), lines)
    weigh = share * np.repeat(lines, lines)
    bad = label == 0
    bad_line = np.repeat(bad, lines)
    lowered = np.zeros(len(label))
    w = np.zeros(N_FEATURES + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        score, pair = w[index].sum(axis=1), w[N_FEATURES:].reshape(2, 2)
        good, both = messages(score, pair, first)
        aim, aim_both = messages(score - np.repeat(lowered, lines) * weigh, pair, first)
        lowered = np.where(bad, np.maximum(0, lowered + 3 * (np.add.reduceat(aim * share, first[:-1]) - (1 - bad_share))), 0)
        aim[~bad_line] = 1
        aim_both[:, :, ~bad_line] = 0
        aim_both[0, 0, ~bad_line] = 1
        aim_both[:, :, first[:-1]] = 0
        g = np.zeros_like(w)
        for k in range(index.shape[1]):
            g[:N_FEATURES] += np.bincount(index[:, k], aim - good, N_FEATURES)
        g[N_FEATURES:] = (aim_both - both).sum(axis=2).ravel()
        g = (g - l2 * w) / len(label)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:N_FEATURES], w[N_FEATURES:].reshape(2, 2)


def shares(bins: np.ndarray, first: np.ndarray, characters: np.ndarray, weights: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Each document's mean probability of good over its lines, weighted by length (an empty line by one)."""
    index = features(bins, first)
    score = np.zeros(len(bins))
    for k in range(index.shape[1]):
        score += weights[index[:, k]]
    good, _ = messages(score, pair, first)
    length = characters + 1.0
    return np.add.reduceat(good * length, first[:-1]) / np.add.reduceat(length, first[:-1])


def curve(share: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of the logistic curve from shares to labels (Newton steps with a small ridge)."""
    x = np.stack([np.ones_like(share), share - 0.5])
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(b @ x, -30, 30)))
        g = x @ (label - p) - 0.1 * b
        b += np.linalg.solve((x * (p * (1 - p))) @ x.T + 0.1 * np.eye(2), g)
    return float(b[0]), float(b[1])


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 6000, max_lines: int = 2000, max_total: int = 300_000) -> dict:
    """docs (doc_id, text), labels (doc_id, quality): the field's weights, from a bounded sample of labelled documents."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, ones = known.agg(F.count("*"), F.sum("quality")).first()
    spec = {"weights": None, "share": (ones or 0) / n if n else 0.0}
    if not n or not ones or ones == n:
        return spec
    bound = known.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(max_labelled).agg(F.max("h")).first()[0]
    few = known.where(F.xxhash64("doc_id") <= bound)
    chosen = docs.select("doc_id", "text").join(few, "doc_id").select("quality", F.xxhash64("doc_id").alias("h"), F.col("text").cast("string").alias("text"))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(2)):
                bins, first, characters = line_bins(data, offsets)
                packed = [(bins[x:y].tobytes(), characters[x:y].astype("<i8").tobytes()) for x, y in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), batch.column(1).slice(a, b - a), pa.array(np.diff(first)), *(pa.array([p[k] for p in packed], pa.binary()) for k in (0, 1))], names=["quality", "h", "lines", "bins", "characters"]
                )
            trim()

    sample = tables.stored(chosen.mapInArrow(measure, "quality long, h long, lines long, bins binary, characters binary").where(F.col("lines") <= max_lines))
    sizes = sorted((r.h, r.lines) for r in sample.groupBy("h").agg(F.sum("lines").alias("lines")).collect())  # at most max_labelled
    within = np.cumsum([x for _, x in sizes]) <= max_total
    if not within.any():
        return spec
    rows = sorted(sample.where(F.col("h") <= sizes[int(within.sum()) - 1][0]).drop("lines").collect())  # at most max_total short lines
    label = np.array([r.quality for r in rows])
    if label.min() == label.max():
        return spec
    bins = np.frombuffer(b"".join(r.bins for r in rows), np.uint8).reshape(-1, WIDTH)
    characters = np.frombuffer(b"".join(r.characters for r in rows), "<i8")
    first = np.cumsum([0, *(len(r.bins) // WIDTH for r in rows)])
    weights, pair = fit(bins, first, characters, label)
    return spec | {"weights": weights, "pair": pair, "curve": curve(shares(bins, first, characters, weights, pair), label)}


def score(docs: DataFrame, spec: dict, *, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the quality of each text (0 to 1)."""
    kept = [f for f in docs.schema.fields if f.name != out]
    names = [f.name for f in kept]
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # some hundred weights
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{out}` double"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(batch.num_columns - 1)):
                if s["weights"] is None:
                    told = np.full(b - a, s["share"])
                else:
                    z = s["curve"][0] + s["curve"][1] * (shares(*line_bins(data, offsets), s["weights"], s["pair"]) - 0.5)
                    told = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(names))), pa.array(told)], names=[*names, out])
            trim()

    return docs.select(*(F.col(f"`{n}`") for n in names), F.col(f"`{text}`").cast("string").alias(tables.unused(docs.columns) + "text")).mapInArrow(run, schema)
