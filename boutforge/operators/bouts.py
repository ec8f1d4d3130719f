"""Bouts: two-sided views, reconciliation, and records aggregated from them.

A bout row has bout_id, date, a, b, score_a (1, 0, 0.5 or null for no contest), finish, and what else
an operator names. Everything here is built from partial aggregates and equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import percent


def two_sided(bouts: DataFrame, *keep: str) -> DataFrame:
    """One row for each side of each bout: fighter, opponent and result seen from there."""
    result = lambda score: F.when(score == 1, "win").when(score == 0, "loss").when(score == 0.5, "draw").otherwise("nc")
    side = lambda own, other, score: F.struct(F.col(own).alias("fighter"), F.col(other).alias("opponent"), result(score).alias("result"))
    both = F.explode(F.array(side("a", "b", F.col("score_a")), side("b", "a", 1 - F.col("score_a"))))
    return bouts.select(both.alias("s"), *keep).select("s.*", *keep)


def reconcile(rows: DataFrame) -> DataFrame:
    """Rows of one bout as told by both sides (key, ord, score_a, finish, payload) to a bout.

    A bout whose tellers contradict each other on the score is dropped; a finish holds only if all say
    so; the payload is the first row's.
    """
    told = rows.groupBy("key").agg(
        F.min("score_a").alias("lo"), F.max("score_a").alias("hi"), F.min("finish").alias("finish"), F.min_by("payload", "ord").alias("payload"), F.count("*").alias("n_rows")
    )
    return told.where("lo = hi").select("key", F.col("lo").alias("score_a"), "finish", "payload", "n_rows")


def without_ghosts(wall: DataFrame, known: DataFrame, related: Column) -> DataFrame:
    """Rows of wall (aliased w) without those that known (aliased k) has under another name.

    Same fighter and date, and the same method, or the same result with names that ``related`` takes for one.
    """
    w, k = wall.alias("w"), known.alias("k")
    same = (F.col("w.fighter") == F.col("k.fighter")) & (F.col("w.date") == F.col("k.date"))
    return w.join(k, same & ((F.col("w.method") == F.col("k.method")) | ((F.col("w.result") == F.col("k.result")) & related)), "left_anti")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def records(sides: DataFrame, *by: str, kinds: Column | None = None) -> DataFrame:
    """Wins, losses, draws and no contests of each group, and wins by kind of ending where there is one."""
    columns = {f"{name}": count_if(F.col("result") == value) for name, value in (("wins", "win"), ("losses", "loss"), ("draws", "draw"), ("no_contests", "nc"))}
    if kinds is not None:
        columns |= {f"{k}_wins": count_if((F.col("result") == "win") & (kinds == k)) for k in ("ko", "sub", "decision")}
    return sides.groupBy(*by).agg(*(c.alias(n) for n, c in columns.items()))


def with_rates(record: DataFrame, finishes: str = "finish_wins") -> DataFrame:
    """Win rate over decided bouts and finish rate over wins, in whole percent, null without any."""
    return record.withColumns({"win_rate": percent(F.col("wins"), F.col("wins") + F.col("losses")), "finish_rate": percent(F.col(finishes), F.col("wins"))})


def across_orgs(per_org: DataFrame, order: list[str]) -> DataFrame:
    """Records summed over organisations, with those that have a bout, in a fixed order."""
    sums = [F.sum(c).alias(c) for c in ("wins", "losses", "draws", "no_contests")]
    seen = per_org.groupBy("fighter").agg(*sums, F.collect_set(F.when(F.col("wins") + F.col("losses") + F.col("draws") + F.col("no_contests") > 0, F.col("org"))).alias("seen"))
    return seen.withColumn("orgs", F.array_join(F.filter(F.array(*map(F.lit, order)), lambda o: F.array_contains("seen", o)), ",")).drop("seen")


def method_shares(record: DataFrame) -> DataFrame:
    """Shares of endings over the greater of wins and of what the endings add up to."""
    base = F.greatest("wins", F.col("ko_wins") + F.col("sub_wins") + F.col("decision_wins"))
    return record.withColumns({f"{k}_share": percent(F.col(f"{k}_wins"), base) for k in ("ko", "sub", "decision")})


def scoped(sides: DataFrame, starts: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Bouts from each fighter's start on (all, where none is given) without excluded (fighter, date, opponent)."""
    from_start = sides.join(starts, "fighter", "left").where(F.col("start").isNull() | (F.col("date") >= F.col("start"))).drop("start")
    return from_start.join(exclusions, ["fighter", "date", "opponent"], "left_anti")


def before_first(sides: DataFrame, qualifies: Column) -> DataFrame:
    """Bouts before the fighter's first qualifying one; all of those of a fighter without any are left out."""
    first = F.min(F.when(qualifies, F.col("date"))).over(Window.partitionBy("fighter"))
    return sides.withColumn("first", first).where("date < first").drop("first")


def integrity(history: DataFrame, totals: DataFrame) -> DataFrame:
    """Counted and stated results of each fighter: fatal where more are counted than stated, warn where fewer."""
    counted = records(history, "fighter")
    both = totals.alias("t").join(counted.alias("c"), "fighter", "left")
    diffs = [F.coalesce(F.col(f"c.{x}"), F.lit(0)) - F.col(f"t.{x}") for x in ("wins", "losses", "draws")]
    level = F.when((diffs[0] > 0) | (diffs[1] > 0) | (diffs[2] > 0), "fatal").when((diffs[0] < 0) | (diffs[1] < 0) | (diffs[2] < 0), "warn").otherwise("ok")
    return both.select("fighter", *(d.alias(f"{n}_diff") for d, n in zip(diffs, ("wins", "losses", "draws"), strict=True)), level.alias("level"))


def repaired_totals(history: DataFrame, totals: DataFrame) -> DataFrame:
    """Stated totals, or the counted ones where the two differ and there is a history."""
    counted = records(history, "fighter")
    both = totals.alias("t").join(counted.alias("c"), "fighter", "left")
    differs = F.col("c.wins").isNotNull() & ((F.col("c.wins") != F.col("t.wins")) | (F.col("c.losses") != F.col("t.losses")) | (F.col("c.draws") != F.col("t.draws")))
    return both.select("fighter", *(F.when(differs, F.col(f"c.{x}")).otherwise(F.col(f"t.{x}")).alias(x) for x in ("wins", "losses", "draws")), differs.alias("repaired"))


def sole_sibling_date(rows: DataFrame, group: str, date: str = "date") -> DataFrame:
    """A missing date takes the group's date if the group has exactly one."""
    w = Window.partitionBy(group)
    only = F.when(F.min(date).over(w) == F.max(date).over(w), F.min(date).over(w))
    return rows.withColumn(date, F.coalesce(F.col(date), only))


def recent_mode(rows: DataFrame, value: str, order: list[Column], last: int) -> DataFrame:
    """Each fighter's most frequent value among the last few rows; ties go to the newest."""
    recent = rows.withColumn("nth", F.row_number().over(Window.partitionBy("fighter").orderBy(*order))).where(F.col("nth") <= last)
    counts = recent.groupBy("fighter", value).agg(F.count("*").alias("n"), F.min("nth").alias("newest"))
    best = F.min_by(value, F.struct(-F.col("n"), F.col("newest")))
    return counts.groupBy("fighter").agg(best.alias(value), F.max("n").alias("n"))


def vote(rows: DataFrame, value: str, rank: Column) -> DataFrame:
    """The majority value of each fighter; ties by the latest date, then by rank."""
    counts = rows.groupBy("fighter", value).agg(F.count("*").alias("n"), F.max("date").alias("latest"), F.min(rank).alias("rank"))
    order = Window.partitionBy("fighter").orderBy(F.desc("n"), F.desc("latest"), "rank")
    return counts.withColumn("place", F.row_number().over(order)).where("place = 1").select("fighter", value, "n", "latest")


def title_value(titles: DataFrame, as_of: Column) -> DataFrame:
    """Titles won, weighted to half every two years; one still to come counts as one."""
    years = F.datediff(as_of, F.col("date")) / F.lit(365.25)
    weight = F.least(F.lit(1.0), F.pow(F.lit(0.5), years / 2))
    return titles.groupBy("fighter").agg(F.sum(weight).alias("title_value"), F.count("*").alias("titles"), F.max("date").alias("last_title"))


def records_by_winner_name(bouts: DataFrame) -> DataFrame:
    """Records from bouts (a, b, name_a, name_b, winner_name, result_type, rules), where only a name says who won.

    Bouts under other rules than mixed martial arts are counted apart; a winner who is neither side is unknown.
    """
    side = lambda own, name: F.struct(F.col(own).alias("fighter"), (F.col("winner_name") == F.col(name)).alias("won"), F.col("winner_name").isin(F.col("name_a"), F.col("name_b")).alias("known"))
    rows = bouts.select("result_type", "rules", F.explode(F.array(side("a", "name_a"), side("b", "name_b"))).alias("s")).select("s.*", "result_type", "rules").where("fighter is not null")
    counted = F.col("rules").isin("MMA", "unknown")
    decided = counted & (F.col("result_type") == "decisive") & F.col("known")
    return rows.groupBy("fighter").agg(
        count_if(decided & F.col("won")).alias("wins"),
        count_if(decided & ~F.col("won")).alias("losses"),
        count_if(counted & (F.col("result_type") == "draw")).alias("draws"),
        count_if(counted & (F.col("result_type") == "nc")).alias("no_contests"),
        count_if(~counted).alias("excluded"),
    )
