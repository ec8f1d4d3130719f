"""Texts of megabytes, repeated rows and empty tables through operators whose other tests have none of them."""

import math

import pytest
from pyspark.sql import functions as F

from boutforge.llm import bpe, filter_audit, kneser_ney, lexical, line_crf, mixing, queries, rans, superminhash

WORDS = 60_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{k % 7919}" for k in range(WORDS))
    rows = [(1, long), (2, long + " end"), (3, "a short text of six words"), (3, "a short text of six words"), (4, None), (5, "x" * 20_000)]
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)


def test_near_duplicates(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in superminhash.near_duplicates(docs.select("doc_id", "text"), percent=80).collect()}
    assert got[1] == (7919, 1) and got[2] == (7920, 1) and got[3] == (2, 3) and got[4] == (0, 4) and got[5] == (1, 5)


def test_mixing(docs):
    out = mixing.mix(docs).collect()
    assert len(out) == 6 and {r.tokens for r in out if r.doc_id == 1} == {WORDS}


def test_language_model(docs):
    out = {r.doc_id: r for r in kneser_ney.score(docs.select("doc_id", "text"), kneser_ney.train(docs.select("doc_id", "text"), order=2)).collect()}
    assert out[1].n_tokens == WORDS + 1 and out[5].n_tokens == 2 and all(math.isfinite(r.score) for r in out.values())


def test_token_files(docs, spark, tmp_path):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((r.doc_id, r.again) for r in bpe.encode(docs, queries.TOKENIZER, decoded="again").collect()) == sorted((i, t or "") for i, t in rows)
    rans.write(docs, queries.TOKENIZER, str(tmp_path / "f"), end_id=0)
    sums = rans.checksums(spark, str(tmp_path / "f"), queries.TOKENIZER).collect()
    sizes = sorted((r.doc_id, len(r.ids) + 1) for r in bpe.encode(docs, queries.TOKENIZER).collect())
    assert sorted((r.doc_id, r.n_tokens) for r in sums) == sizes


def test_the_new_operators(docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    scored = line_crf.score(docs, line_crf.train(docs, labels.select("doc_id", "quality"))).collect()
    assert len(scored) == 6 and all(0 <= r.score <= 1 for r in scored)
    found = lexical.search(docs, spark.createDataFrame([(1, "w5 six")], "item_id long, text string")).collect()
    assert {r.doc_id for r in found} == {1, 2, 3} and sorted(r["rank"] for r in found) == [1, 2, 3, 4]
    last = filter_audit.audit(docs, labels).where("step = 5").select("kept").distinct().collect()
    assert [r.kept for r in last] == [0]  # the long ones repeat their words, the others are short


def test_empty_tables(docs, spark):
    none = docs.where(F.lit(False))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert superminhash.near_duplicates(none.select("doc_id", "text"), percent=80).count() == 0
    assert mixing.mix(none).count() == 0
    assert filter_audit.audit(none, labels).count() == 0
    assert line_crf.score(none, line_crf.train(none, labels)).count() == 0
