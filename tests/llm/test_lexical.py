"""Operator 12 beside plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boutforge.llm import lexical
from boutforge.llm.textblocks import LOWER, text_blocks, words

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def scored(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        found = []
        for i, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, **more):
    frame = spark.createDataFrame(docs, DOCS).withColumns({"score": F.lit("clash"), "terms": F.lit(1), "n": F.lit(1), "item": F.lit(2)})
    asked = spark.createDataFrame(items, ITEMS).withColumns({"doc_id": F.lit("clash"), "rank": F.lit(0)})
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(frame, asked, **more).collect()), key=str)


@pytest.mark.parametrize("chunk, batch_terms", [(4096, 1 << 18), (40, 1 << 18), (7, 20)])
def test_search_equals_scoring_everything(spark, monkeypatch, chunk, batch_terms):
    monkeypatch.setattr(lexical, "CHUNK", chunk)
    monkeypatch.setattr(lexical, "GROUP", 5)
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(60)] + ["The", "É", "日本", "a_b", "x-y", "🙂", "dé"]
    text = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.08)), len(vocabulary) - 1)] for _ in range(n))
    docs = [(k, text(rng.randint(0, 30))) for k in range(900)]
    docs += [(k, docs[0][1]) for k in range(900, 1100)]  # ties
    docs += [(5000, None), (5001, ""), (5002, " ./ "), (None, docs[0][1]), (5003, text(60_000))]
    items = [(k, text(rng.choice([1, 3, 20]))) for k in range(25)] + [(30, None), (31, ""), (32, "unheard"), (33, docs[0][1]), (3, "w1 w50"), (None, "w2 É")]
    assert searched(spark, docs, items, batch_terms=batch_terms) == scored(docs, items)


def test_ties_over_many_ranges_go_to_the_smallest_ids(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK", 64)
    docs = [(k, "same text") for k in random.Random(1).sample(range(3000), 3000)] + [(k, "other") for k in range(4000, 5000)]
    assert searched(spark, docs, [(1, "same")]) == [(1, r, r - 1, s) for _, r, _, s in scored(docs, [(1, "same")])]
    again = [(7, "same text")] * 12 + [(8, "other")] * 30
    assert searched(spark, again, [(1, "text")]) == scored(again, [(1, "text")])


def test_no_documents_or_items(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, None), (2, " - ")], [(1, "a")]) == []


def test_few_ranges_are_opened(monkeypatch):
    """One strong document among 4096: the search opens its path and what has as high a bound, no more."""
    opened = []
    take = lexical.Best.add
    monkeypatch.setattr(lexical.Best, "add", lambda self, item, *rest: (opened.append(len(item)), take(self, item, *rest))[1])
    doc = np.arange(4096)
    tree = lexical.Tree(np.concatenate([doc, [77]]), np.concatenate([np.zeros(4096, np.int64), [1]]), np.concatenate([1 + doc % 5, [1000]]))
    best = lexical.Best(1, 1)
    lexical.descend(tree, best, [(0, np.array([0, 1]))], np.array([1, 1]), doc, np.zeros(4096, bool))
    assert best.id.tolist() == [77] and sum(opened) <= 2 * lexical.WAVE * lexical.FAN


def test_terms_of_one_hash_are_told_apart():
    """Thue-Morse texts collide in any polynomial hash modulo 2**64."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    finder = lexical.Terms([a.encode()])
    both = lexical.Terms([a.encode(), b.encode(), b"c"])
    for _, _, data, offsets in text_blocks(pa.array([f"{a} {b} c"])):
        starts, ends, _ = words(LOWER[data], offsets)
        assert finder.find(LOWER[data], starts, ends).tolist() == [0, -1, -1]
        assert both.find(LOWER[data], starts, ends).tolist() == [0, 1, 2]
