"""Operator 11: messages beside all labellings, measures beside plain Python, and held-out documents."""

import itertools
import random
import re
from bisect import bisect_right

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from boutforge.llm import line_crf, queries
from boutforge.llm.textblocks import text_blocks

SF = "/root/testdata/sf0.01"


def test_marginals_equal_the_sum_over_all_labellings():
    rng = np.random.default_rng(11)
    first = np.cumsum([0, 1, 2, 7, 1, 5])
    score, pair = rng.normal(0, 3, first[-1]), rng.normal(0, 2, (2, 2))
    good, both = line_crf.messages(score, pair, first)
    for a, b in itertools.pairwise(first):
        total, one, two = 0.0, np.zeros(b - a), np.zeros((2, 2, b - a))
        for labels in itertools.product((0, 1), repeat=b - a):
            p = np.exp(sum(score[a + k] for k, x in enumerate(labels) if x == 0) + sum(pair[x, y] for x, y in itertools.pairwise(labels)))
            total += p
            for k, x in enumerate(labels):
                one[k] += p * (x == 0)
                if k:
                    two[labels[k - 1], x, k] += p
        assert np.allclose(good[a:b], one / total)
        assert np.allclose(both[:, :, a:b], two / total)


def test_messages_of_many_lines_stay_finite():
    n = 300_000
    good, both = line_crf.messages(np.tile([60.0, -60.0, 0.0], n // 3), np.array([[3.0, -3.0], [-3.0, 3.0]]), np.array([0, n]))
    assert np.isfinite(good).all() and np.isfinite(both).all()
    assert good[0] > 0.99 and good[1] < 0.01


def plain_bins(text):
    """Bins of each line of one text, and lengths."""
    out, lengths, words_met, lines_met = [], [], set(), set()
    for line in text.split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line))
        raw = re.findall(r"[^\x20\x09-\x0D]+", line)
        sign = lambda c: c in "#$%&*|!<>=_~^@{}[]\\/+"
        again = 0
        for w in words:
            again += w in words_met
            words_met.add(w)
        n, m = max(len(line), 1), max(len(words), 1)
        letters = sum(c.isascii() and c.isalpha() for c in line)
        end = 0 if not raw else 1 if raw[-1][-1] in ".?!" else 2 if raw[-1][-1].isalnum() or ord(raw[-1][-1]) > 127 else 3
        low = re.sub("[A-Z]", lambda k: k[0].lower(), line)
        values = [len(line), len(words), sum(map(sign, line)) / n, sum(any(map(sign, w)) for w in words) / m, sum(all(map(sign, w)) for w in words) / m, sum("A" <= c <= "Z" for c in line) / max(letters, 1)]
        values += [sum("0" <= c <= "9" for c in line) / n, sum(a == b for a, b in itertools.pairwise(words)) / m, again / m, len(line) / m, end, bool(words) and low in lines_met]
        lines_met.add(low)
        out.append([bisect_right(c, v) for c, v in zip(line_crf.CUTS.values(), values, strict=True)])
        lengths.append(len(line))
    return out, lengths


def test_measures_of_lines():
    rng = random.Random(5)
    parts = ["a", "The", " ", " ", "\n", "|", "!!", "é", "\t", "1", ".", "\n\n", "the the ", "日本"]
    texts = ["", "\n", "a\n", "x", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400))]
    for a, b, data, offsets in text_blocks(pa.array(texts)):
        bins, first, characters = line_crf.line_bins(data, offsets)
        for k, text in enumerate(texts[a:b]):
            want, lengths = plain_bins(text)
            assert bins[first[k] : first[k + 1]].tolist() == want, text
            assert characters[first[k] : first[k + 1]].tolist() == lengths


def test_held_out_documents(spark):
    rows = queries.op11_line_crf(spark, SF).collect()
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in texts)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert sum(p == 1 for p, y in held if y) >= 0.98 * sum(y for _, y in held)
    assert sum(p == 0 for p, y in held if not y) >= 0.8 * sum(not y for _, y in held)


def test_bad_lines_are_found_within_documents(spark):
    """Bad documents begin with clean lines; lines alike in good ones keep them good."""
    rng = random.Random(3)
    clean = lambda: " ".join(rng.choice(["alba", "bero", "cint", "dola", "efre", "gimo", "hust"]) for _ in range(12)) + "."
    noisy = lambda: " ".join(rng.choice(["##", "$$x", "%%y", "&&"]) for _ in range(12))
    texts = [(k, "\n".join([clean(), clean(), clean(), *(noisy() if k % 3 == 0 else clean() for _ in range(12))]), int(k % 3 > 0)) for k in range(120)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    spec = line_crf.train(docs, spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, quality int"))
    for _, _, data, offsets in text_blocks(pa.array([texts[0][1]])):
        bins, first, _ = line_crf.line_bins(data, offsets)
        good, _ = line_crf.messages(spec["weights"][line_crf.features(bins, first)].sum(axis=1), spec["pair"], first)
        assert (good[:2] > 0.5).all() and (good[3:] < 0.5).all()


def test_edges(spark):
    some = [(1, None), (2, ""), (3, "A b."), (3, "A b."), (None, "## $$"), (4, "\n" * 50_000), (5, "word " * 200_000)]
    docs = spark.createDataFrame(some, "doc_id long, text string").withColumns({"quality": F.lit("clash"), "h": F.lit(1), "score": F.lit("gone"), "bins": F.lit(0)})
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (None, 0), (5, None), (4, 7)], "doc_id long, quality int")
    out = line_crf.score(docs, line_crf.train(docs, labels)).collect()
    assert len(out) == len(some) and all(0 <= r.score <= 1 for r in out)
    by_id = {r.doc_id: r.score for r in out}
    assert by_id[1] == by_id[2]  # a null text is an empty one
    none, ones = labels.where("false"), labels.where("doc_id = 1")
    assert {r.score for r in line_crf.score(docs, line_crf.train(docs, none)).collect()} == {0.0}
    assert {r.score for r in line_crf.score(docs, line_crf.train(docs, ones)).collect()} == {1.0}
    empty = docs.where("false")
    assert line_crf.score(empty, line_crf.train(empty, labels)).count() == 0
