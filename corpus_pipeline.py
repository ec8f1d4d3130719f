"""The corpus pipeline: five operators one after another, each on all that the one before kept.

Every stage takes and, but for the last, returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutforge.llm import bpe, mixing, pii, superminhash, tables
from boutforge.llm.queries import TOKENIZER, toxicity_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The stages' decisions are tested against a brute-force version: SQL can't express the first two.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents predicted toxic go.

    A null or empty text has no words and stays unless most labelled documents are toxic; each row of a repeated
    or null doc_id is judged by its own text; no documents give none.
    """
    return toxicity_scores(spark, docs.select(*COLUMNS), sf_dir).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 at a similarity of 0.8: of each group the document of smallest doc_id stays; one without doc_id is in no group.

    Rows that repeat a doc_id are one document, so one of them stays: that of the largest text, as compared.
    """
    if superminhash.repeats(docs):
        largest = F.max_by(F.struct(*COLUMNS), F.struct(F.coalesce("text", F.lit("")), *(c for c in COLUMNS if c != "doc_id")))
        single = docs.where("doc_id is not null").groupBy("doc_id").agg(largest.alias("row")).select("row.*")
        docs = single.unionByName(docs.where("doc_id is null").select(*COLUMNS))
    kept = superminhash.near_duplicates(docs.select("doc_id", "text"), percent=80).where("kept").select("doc_id")
    return docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null").select(*COLUMNS))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each span of personal data gives way to its kind in brackets; n_chars follows.

    A null text stays null with its n_chars, and so does an n_chars where nothing was found; every row stays.
    """
    found = pii.find(docs.select(*COLUMNS), out="__pii")
    clean = F.when(F.col("text").isNotNull(), pii.redacted(F.col("text"), F.col("__pii")))
    changed = F.size("__pii") > 0
    return found.withColumn("text", clean).withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents are drawn by the probabilities that bring sources, languages and topics to target.

    The draw is a hash of doc_id, so rows that repeat one are drawn alike where they are of one cell; null
    sources and languages are cells like others; a null or empty text weighs one token.
    """
    return mixing.mix(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: each text's token ids; a null or empty text has none, and every row stays."""
    return bpe.encode(docs.select(*COLUMNS), TOKENIZER).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's rows written as Parquet in the shared folder and read again."""
    docs = tables.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = tables.stored(stage(spark, docs, sf_dir))
    return docs
