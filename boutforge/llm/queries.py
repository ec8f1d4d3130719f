"""The registered queries of the ten operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, filter_audit, hilbert, kneser_ney, lexical, line_crf, mixing, oracles, pii, rans, secrets, spans, superminhash, topk, toxicity
from .tables import crc_bucket, read, shared_dir, text_or_empty

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def digest(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    out = bpe.encode(docs, TOKENIZER, decoded="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        digest("decoded").alias("decoded_sha256"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find(docs).select("doc_id", "secrets", F.filter("secrets", lambda s: s["kind"] != "random").alias("base"))
    counts = {f"n_{k}": spans.count_of(F.col("base"), k) for k in secrets.BASE}
    return found.select("doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(spans.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans.joined(F.col("secrets")).alias("spans"))


def op3_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs).select("doc_id", "pii", F.filter("pii", lambda s: s["kind"].isin(pii.BASE)).alias("base"))
    counts = {f"n_{k}": spans.count_of(F.col("base"), k) for k in pii.BASE}
    return found.select("doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(spans.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans.joined(F.col("pii")).alias("spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs).select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "kept")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=20, every=20)


def op7_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=20, every=20)


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (crc_bucket("doc_id", 10) == 0).alias("held_out"))
    model = kneser_ney.train(docs.where(~F.col("held_out")))
    scored = kneser_ney.score(docs, model, keep=["held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op9_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    folder = shared_dir(spark)
    rans.write(docs, TOKENIZER, folder, end_id=0)
    return rans.checksums(spark, folder, TOKENIZER).select("doc_id", "start", "n_tokens", "ids_crc32")


THRESHOLD = 0.3


def toxicity_scores(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with held_out, score and predicted; labels are learnt from rows that aren't held out."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(crc_bucket("doc_id", 4) != 2)
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model)
    return scored.withColumns({"held_out": crc_bucket("doc_id", 4) == 2, "predicted": (F.col("score") >= THRESHOLD).cast("int")})


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_scores(spark, docs, sf_dir).select("doc_id", "held_out", "score", "predicted")


def op11_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").where(crc_bucket("doc_id", 3) != 1)
    scored = line_crf.score(docs, line_crf.train(docs, labels))
    return scored.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_max_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"), k=10)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_secrets": op2_secrets,
    "op3_superminhash": op3_superminhash,
    "op4_pii": op4_pii,
    "op5_mixing": op5_mixing,
    "op6_topk": op6_topk,
    "op7_hilbert": op7_hilbert,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_rans": op9_rans,
    "op10_toxicity": op10_toxicity,
    "op11_line_crf": op11_line_crf,
    "op12_max_tree": op12_max_tree,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {"op3_superminhash": oracles.NEAR_DUPLICATES, "op5_mixing": oracles.mixing_sql(), "op6_topk": oracles.TOP_K, "op12_max_tree": oracles.RANKED_DOCUMENTS, "op13_filter_audit": oracles.FILTER_AUDIT}
