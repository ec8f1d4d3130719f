"""Operator 13: what each of five filters removes in every order, from one cube of failure flags.

Each text gets five failure flags. Equal (part, flags) are counted first, so the CUBE over the flags and
the part expands a row for each combination that occurs, not for each document. Its grouping sets whose
selected flags are all false hold how many documents survive a set of filters. A step of an order is the
pair of such sets before and after its filter, so all 120 orders are joins over 32 counts a part.

Defined cases: a null text is empty, a null language the part ''. Texts are compared whole (by length and
SHA-256), so a null and an empty one are identical; only a row with a smaller doc_id makes a row a copy, so
rows that repeat a doc_id with its text do not, and a null doc_id neither is nor has a smaller one. Every
row counts once, whatever its doc_id; label rows that repeat a doc_id count as their highest label, those
without doc_id don't count. No documents give no parts and no rows. Columns besides doc_id, text and lang
are not read.
"""

from __future__ import annotations

import itertools
import math
import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tables

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
#: What the filters ask of a text.
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 200, 50, 3, "[#$%&*|]"
MEASURES = ("documents", "good", "toxic")


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def flagged(docs: DataFrame) -> DataFrame:
    """doc_id, part, the flags A to D (true: fails) and what tells texts apart (points, digest), a row for each of docs."""
    row = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    row = row.withColumn("words", F.filter(F.split("text", "[ \\x09-\\x0D]+"), lambda w: w != ""))
    points = F.char_length("text").cast("long")
    capitals = points - F.char_length(F.translate("text", string.ascii_uppercase, ""))
    return row.select(
        "doc_id",
        "part",
        (F.size("words") < MIN_WORDS).alias("A"),
        (100 * F.size(F.array_distinct("words")).cast("long") < DISTINCT_PERCENT * F.size("words")).alias("B"),
        (100 * capitals > CAPITAL_PERCENT * points).alias("C"),
        F.col("text").rlike(SIGNS).alias("D"),
        points.alias("points"),
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
    )


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How many rows (documents, good, toxic) have each combination of part and flags A to E.

    All but the rows of smallest doc_id fail E among equal texts, so counts by text are enough: copies of one
    text are summed before they meet, and no row is joined with its group.
    """
    labels = labels.where("doc_id is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    rows = flagged(docs).join(labels, "doc_id", "left").na.fill(False, ["good", "toxic"])
    own = ["part", *FILTERS[:4], "good", "toxic"]
    by_id = rows.groupBy("doc_id", "points", "digest", *own).agg(F.count("*").alias("n"))
    by_text = by_id.groupBy("points", "digest", *own).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.min("doc_id").alias("low"),
        F.min_by("n", "doc_id").alias("at_low"),
    )
    lowest = F.min("low").over(Window.partitionBy("points", "digest"))
    first = F.col("no_id") + F.when(F.col("low") == lowest, F.col("at_low")).otherwise(0)
    split = F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("first").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("first")).alias("n"))))
    of_flags = by_text.withColumn("first", first).select(*own, split.alias("x")).select(*own, "x.E", "x.n").where("n > 0")
    return of_flags.groupBy("part", *FILTERS).agg(
        F.sum("n").alias("documents"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def survivors(counted: DataFrame) -> DataFrame:
    """part, mask (a set of filters) and the rows that fail none of them, zeros included."""
    cube = counted.cube(*FILTERS, "part").agg(F.grouping("part").alias("whole"), *(F.grouping(f).alias(f"no_{f}") for f in FILTERS), *(F.sum(m).alias(m) for m in MEASURES))
    passed = cube.where("whole = 0")
    for f in FILTERS:
        passed = passed.where(f"no_{f} = 1 or not {f}")
    mask = sum((1 - F.col(f"no_{f}").cast("int")) * bit(f) for f in FILTERS)
    found = passed.select("part", mask.alias("mask"), *MEASURES)
    parts = counted.select("part").distinct()
    every = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("mask"))
    return every.join(found, ["part", "mask"], "left").na.fill(0, list(MEASURES))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang), labels (doc_id, quality, toxic): a row for each part, order of the filters and step."""
    spark = docs.sparkSession
    pairs = [(f, before, before | bit(f)) for f in FILTERS for before in range(ALL + 1) if not before & bit(f)]
    orders = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            orders.append(("".join(order), step, f, before))
            before |= bit(f)
    steps_of = [(f, before, after, math.factorial(before.bit_count()) * math.factorial(4 - before.bit_count())) for f, before, after in pairs]  # orders with that step
    pairs_df = F.broadcast(spark.createDataFrame(steps_of, "filter string, before int, after int, n_orders long"))  # 80 rows
    orders_df = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, filter string, before int"))  # 600 rows

    sets = survivors(tables.stored(cells(docs, labels)))  # 32 rows a part at most, written once as four joins read them
    left = sets.select("part", F.col("mask").alias("before"), *(F.col(m).alias(f"{m}_before") for m in MEASURES)).join(pairs_df, "before")
    right = sets.select("part", F.col("mask").alias("after"), *MEASURES)
    lost = left.join(right, ["part", "after"]).select("part", "filter", "before", "n_orders", F.col("documents").alias("kept"), *((F.col(f"{m}_before") - F.col(m)).alias(f"{m}_lost") for m in MEASURES))
    of_filter = Window.partitionBy("part", "filter")  # 16 rows
    alone = F.max(F.when(F.col("before") == 0, F.col("documents_lost"))).over(of_filter)
    last = F.max(F.when(F.bit_count("before") == len(FILTERS) - 1, F.col("documents_lost"))).over(of_filter)
    told = lost.withColumns({"failing": alone, "unique_fails": last, "shapley": F.sum(F.col("documents_lost") * F.col("n_orders")).over(of_filter)})
    return told.join(orders_df, ["filter", "before"]).select(
        "part",
        "filter_order",
        "step",
        "kept",
        F.col("documents_lost").alias("removed"),
        (F.col("failing") - F.col("documents_lost")).alias("redundant"),
        "unique_fails",
        F.col("good_lost"),
        F.col("toxic_lost"),
        "shapley",
    )
