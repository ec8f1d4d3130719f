"""Why places and scores in a ranking changed between two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores

PARTS = ("bouts_part", "ripple_part", "discount_part")


def bout_deltas(trace: DataFrame, since: Column) -> DataFrame:
    """Each fighter's bouts after a date with what they moved, in order: date, opponent, result and delta to two places."""
    result = F.when(F.col("score") == 0.5, "draw").when(F.col("score") == 1, "win").otherwise("loss")
    told = F.struct("date", "key", "opponent", result.alias("result"), scores.half_up(F.col("after") - F.col("before"), 2).alias("delta"))
    new = trace.where(F.col("date") > since)
    return new.groupBy("fighter").agg(F.sum(F.col("after") - F.col("before")).alias("moved"), F.count("*").alias("n_new"), F.array_sort(F.collect_list(told)).alias("new_bouts"))  # a fighter's bouts since the last run


def edge_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """How many pairs (division, winner, loser) that held before hold no more, and how many are new, for each fighter in them."""
    keys = ["division", "winner", "loser"]
    was, now = previous.select(*keys).distinct(), current.select(*keys).distinct()
    both = was.withColumn("was", F.lit(1)).join(now.withColumn("now", F.lit(1)), keys, "full").where("was is null or now is null")
    sides = both.select("division", F.explode(F.array("winner", "loser")).alias("fighter"), "was", "now")
    return sides.groupBy("division", "fighter").agg(F.count("was").alias("expired"), F.count("now").alias("resolved"))


def edge_changes_between(results: DataFrame, since: Column, now: Column, tie: str) -> DataFrame:
    """The same from all results (division, winner, loser, date) with two days in order: a pair holds as its latest result says, of the same date the first by tie."""
    told = F.struct("date", (-F.col(tie)).alias("tie"), (F.col("winner") < F.col("loser")).alias("first_won"))
    latest = lambda day: F.max(F.when(F.col("date") <= day, told))
    known = results.where(F.col("date") <= now)
    pairs = known.groupBy("division", F.least("winner", "loser").alias("lo"), F.greatest("winner", "loser").alias("hi")).agg(latest(since).alias("was"), latest(now).alias("now"))
    both = pairs.where("was is null or was.first_won <> now.first_won")
    return both.select("division", F.explode(F.array("lo", "hi")).alias("fighter"), "was").groupBy("division", "fighter").agg(F.count("was").alias("expired"), F.count("*").alias("resolved"))


def report(previous: DataFrame, current: DataFrame, trace: DataFrame, since: Column, previous_edges: DataFrame, current_edges: DataFrame) -> DataFrame:
    """What moved each ranked fighter: rankings (division, fighter, rating, fights, rank), the current run's trace, and pairs."""
    side = lambda df, tag: df.select("division", "fighter", *(F.col(c).alias(f"{c}_{tag}") for c in ("rating", "fights", "rank")))
    rows = side(previous, "before").join(side(current, "after"), ["division", "fighter"], "full")
    return explained(rows.join(bout_deltas(trace, since), "fighter", "left"), edge_changes(previous_edges, current_edges))


def explained(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """rows (division, fighter, moved, n_new, and rating, fights and rank before and after) with the parts of each change, and changes of pairs.

    A change of the discounted rating is the sum of three parts: the bouts since (bouts_part); what the current rules or
    corrections make of earlier bouts, the fighter's own and others' (ripple_part); and the discount for few bouts
    (discount_part). A fighter who is new has no parts, one who has gone neither. Left out are those for whom nothing
    changed: neither rating nor place nor listing, and no pair of theirs expired.
    """
    told = [c for c in rows.columns if c == "new_bouts"]
    rows = rows.join(changes, ["division", "fighter"], "left")
    rows = rows.na.fill(0, ["n_new", "expired", "resolved"])
    shown = lambda tag: scores.sigma_discount(F.col(f"rating_{tag}"), F.col(f"fights_{tag}"))
    raw = F.col("rating_after") - F.col("rating_before")
    listed = raw.isNotNull()
    moved = F.when(listed, F.coalesce("moved", F.lit(0.0)))
    rows = rows.withColumns({"change": shown("after") - shown("before"), "bouts_part": moved, "ripple_part": raw - moved, "discount_part": shown("after") - shown("before") - raw})
    a, b = F.col("rank_after"), F.col("rank_before")
    kind = F.when(b.isNull(), "new").when(a.isNull(), "dropped").when(a < b, "up").when(a > b, "down").otherwise("same")
    rows = rows.withColumn("move", kind)
    changed = (F.abs(F.coalesce(raw, F.lit(0.0))) >= 0.005) | (F.col("move") != "same") | (F.col("expired") > 0)
    return rows.where(changed).select("division", "fighter", "rank_before", "rank_after", "move", "change", *PARTS, "n_new", *told, "expired", "resolved")
