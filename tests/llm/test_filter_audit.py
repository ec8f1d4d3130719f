"""Operator 13 beside a plain walk of every document through every order."""

import itertools
import random
import re

from pyspark.sql import functions as F

from boutforge.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def walked(docs, labels):
    """docs: (doc_id, text, lang); a dict (part, order, step) to the counts, by removing documents one after another."""
    texts = [t or "" for _, t, _ in docs]
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    fails = []
    for (i, _, _), t in zip(docs, texts, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        capitals = sum("A" <= c <= "Z" for c in t)
        copy = any(i is not None and j is not None and j < i and u == t for (j, _, _), u in zip(docs, texts, strict=True))
        fails.append({f for f, x in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(t), re.search(r"[#$%&*|]", t), copy), strict=True) if x})
    out = {}
    for part in {lang or "" for _, _, lang in docs}:
        own = [k for k, d in enumerate(docs) if (d[2] or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in fails[k]]
                redundant = [k for k in own if f in fails[k] and k not in left]
                left = [k for k in left if f not in fails[k]]
                removed_by[f] += len(gone)
                ids = [docs[k][0] for k in gone]
                out[part, "".join(order), step] = [len(left), len(gone), len(redundant), sum(fails[k] == {f} for k in own), sum(i in good for i in ids), sum(i in toxic for i in ids)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


def rows(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_every_order_and_step(spark):
    rng = random.Random(13)
    pieces = ["a ", "the ", "B ", "é ", "# ", "|x ", " ", "\n", "\x0b"]
    texts = [None, "", "A", "x" * 200_000, "w " * 250, " ".join(map(str, range(250))), " ".join(map(str, range(250))) + " $"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.choice([3, 450]))) + " ".join(str(rng.randint(0, 400)) for _ in range(rng.choice([0, 300]))) for _ in range(30)]
    docs = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(90)]
    docs += [(3, docs[3][1], "de"), (3, docs[3][1], "en"), (None, "", "en"), (None, docs[5][1], None)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 80, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"part": F.lit(1), "A": F.lit("clash"), "mask": F.lit(2), "n": F.lit(3)})
    told = filter_audit.audit(frame, spark.createDataFrame(labels, LABELS).withColumn("good", F.lit("clash")))
    assert rows(told) == walked(docs, labels)
    assert dict(told.dtypes) | {"part": "string", "filter_order": "string", "step": "int", "kept": "bigint", "shapley": "bigint"} == dict(told.dtypes)


def test_no_documents_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit(none, spark.createDataFrame([(1, 1, 1)], LABELS)).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    got = rows(filter_audit.audit(one, spark.createDataFrame([], LABELS)))
    assert len(got) == 600
    assert got == walked([(1, None, None)], [])
