"""Operator 5: mixing sources to target weights by iterative proportional fitting; DataFrame functions only.

Documents are summed to cells of (source, lang, topic), which is all that fitting sees. Each round scales
the cells' weights to the target share of every source, then language, then topic. A document is kept
with the probability that its cell needs: the same factor times fitted weight over the cell's tokens,
at most 1, with the factor set so that the expected number of tokens is the asked share of all. The
draw is a hash of doc_id, so it is the same in every run.

Without given targets a dimension's target is its observed shares to the power TEMPER, made to sum to
1, which lifts rare sources, languages and topics. A topic is the kind of writing that the text shows
(table, symbols, shouting, notice, long or short prose).

Defined cases: null source or lang is the cell value '' ; a null or empty text weighs one token; a null
doc_id draws as the empty text; repeated rows are drawn alike; an empty table gives an empty result;
columns of the input named topic, tokens, probability or kept are replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables

DIMENSIONS = ["source", "lang", "topic"]
ROUNDS, STORED_EVERY, TEMPER, SHARE = 8, 3, 0.7, 0.5
STEPS = 12


def tokens(text: Column) -> Column:
    """Words by their separators: spaces, tabs and line feeds, and one more."""
    return (F.char_length(text) - F.char_length(F.translate(text, " \t\n", "")) + 1).cast("long")


def topic(text: Column) -> Column:
    n = F.char_length(text)
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("$$$")) | F.contains(text, F.lit("###")), "symbols")
        .when(F.contains(text, F.lit("!! ")), "shouting")
        .when(F.contains(text, F.lit("License")), "notice")
        .when(n >= 2000, "long")
        .otherwise("short")
    )


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) of a document: the first 32 bits of a digest."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def _targets(cells: DataFrame, dimension: str, given: DataFrame | None) -> DataFrame:
    """dimension, target: shares that sum to 1."""
    if given is not None:
        seen = cells.select(dimension).distinct().join(given.select(dimension, F.col("share").cast("double").alias("part")), dimension, "left").withColumn("part", F.coalesce("part", F.lit(0.0)))
    else:
        seen = cells.groupBy(dimension).agg(F.pow(F.sum("tokens").cast("double"), F.lit(TEMPER)).alias("part"))
    total = seen.agg(F.sum("part").alias("all"))
    return seen.crossJoin(F.broadcast(total)).select(dimension, (F.col("part") / F.col("all")).alias(f"{dimension}_target"))  # one row of one number


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight: shares that meet the targets as nearly as cells allow."""
    frame = cells
    for d in DIMENSIONS:
        frame = frame.join(_targets(cells, d, (targets or {}).get(d)), d)
    frame = tables.stored(frame.withColumn("weight", F.col("tokens").cast("double")))
    for k in range(ROUNDS):
        for d in DIMENSIONS:
            has = frame.groupBy(d).agg(F.sum("weight").alias("has"))
            scaled = F.when(F.col("has") > 0, F.col("weight") * F.col(f"{d}_target") / F.col("has")).otherwise(0.0)
            frame = frame.join(has, d).withColumn("weight", scaled).drop("has")
            if (k * len(DIMENSIONS) + DIMENSIONS.index(d) + 1) % STORED_EVERY == 0:
                frame = tables.stored(frame)
    return frame.select(*DIMENSIONS, "tokens", "weight")


def calibrated(cells: DataFrame, share: float) -> DataFrame:
    """cells with probability: min(1, factor * weight / tokens), of which the expected tokens are share of all."""
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    row = cells.agg(F.sum("tokens").alias("all")).first()
    everything = float(row[0] or 0)
    factor = share * everything
    for _ in range(STEPS):  # cells at 1 stay there, and the rest share what is left; a sum of two numbers each time
        open_ = factor * ratio < 1
        full, weight = cells.agg(F.sum(F.when(~open_, F.col("tokens"))).alias("full"), F.sum(F.when(open_, F.col("weight"))).alias("weight")).first()
        if not weight:
            break
        new = (share * everything - float(full or 0)) / float(weight)
        if new <= factor * (1 + 1e-12):
            break
        factor = new
    return cells.withColumn("probability", F.least(F.lit(1.0), F.lit(factor) * ratio))


def mix(docs: DataFrame, *, share: float = SHARE, targets: dict[str, DataFrame] | None = None, text: str = "text") -> DataFrame:
    """docs with topic, tokens, probability and kept."""
    own = ["topic", "tokens", "probability", "kept"]
    kept = [c for c in docs.columns if c not in own]
    p = tables.unused(docs.columns)
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    facts = {"source": _cell("source"), "lang": _cell("lang"), "topic": topic(content)}
    keys = [p + d for d in DIMENSIONS]
    placed = docs.select(*(F.col(f"`{c}`") for c in kept), *(v.alias(p + d) for d, v in facts.items()), tokens(content).alias(f"{p}tokens"))
    # the same three short columns, without the text, make the cells
    cells = docs.select(*(v.alias(d) for d, v in facts.items()), tokens(content).alias("tokens")).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    fitted = tables.stored(calibrated(tables.stored(rake(tables.stored(cells), targets)), share))
    lookup = fitted.select(*(F.col(d).alias(p + d) for d in DIMENSIONS), F.col("probability").alias(f"{p}probability"))
    probability = F.col(f"{p}probability")
    results = [F.col(f"{p}topic").alias("topic"), F.col(f"{p}tokens").alias("tokens"), probability.alias("probability"), (draw(F.col("doc_id")) < probability).alias("kept")]
    return placed.join(lookup, keys).select(*(F.col(f"`{c}`") for c in kept), *results)


def _cell(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def marginal_error(fitted: DataFrame, targets: dict[str, DataFrame] | None = None) -> float:
    """The largest distance of a source's, language's or topic's fitted share from its target: one number."""
    worst = 0.0
    for d in DIMENSIONS:
        shares = fitted.groupBy(d).agg(F.sum("weight").alias("w"))
        far = shares.join(_targets(fitted, d, (targets or {}).get(d)), d).agg(F.max(F.abs(F.col("w") - F.col(f"{d}_target")))).first()[0]
        worst = max(worst, far or 0.0)
    return worst
