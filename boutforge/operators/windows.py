"""Sequences: ranks, gaps, runs and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, order: list[Column], *by: str, out: str = "rank") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def pulled_up(rows: DataFrame, group: str, position: str, score: str, out: str) -> DataFrame:
    """Each score at least as high as every one below it in its group."""
    below = Window.partitionBy(group).orderBy(position).rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn(out, F.max(score).over(below))


def last_before_gap(rows: DataFrame, days: float, *, by: str = "fighter", tie: str = "bout_id") -> DataFrame:
    """The latest date after which a fighter was away longer than so many days; null without such a gap."""
    earlier = F.lag("date").over(Window.partitionBy(by).orderBy("date", tie))
    gaps = rows.withColumn("__before", earlier)
    return gaps.groupBy(by).agg(F.max(F.when(F.datediff("date", "__before") > days, F.col("__before"))).alias("cutoff"))


def division_cutoff(rows: DataFrame, current: str = "current", division: str = "division", tie: str = "bout_id") -> DataFrame:
    """The latest bout outside the current division that isn't a lone trip between two bouts in it."""
    w = Window.partitionBy("fighter").orderBy("date", tie)
    known = rows.where(F.col(division).isNotNull()).withColumns({"__prev": F.lag(division).over(w), "__next": F.lead(division).over(w)})
    lone = F.coalesce((F.col("__prev") == F.col(current)) & (F.col("__next") == F.col(current)), F.lit(False))
    return known.groupBy("fighter").agg(F.max(F.when((F.col(division) != F.col(current)) & ~lone, F.col("date"))).alias("cutoff"))


def last_results(rows: DataFrame, n: int, tie: str = "bout_id") -> DataFrame:
    """The last n results that aren't no contests, newest first, as one string."""
    nth = F.row_number().over(Window.partitionBy("fighter").orderBy(F.desc("date"), F.desc(tie)))
    recent = rows.where("result <> 'nc'").withColumn("nth", nth).where(F.col("nth") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("nth", F.upper(F.substring("result", 1, 1)).alias("r"))))
    return recent.groupBy("fighter").agg(F.array_join(F.transform(ordered, lambda x: x["r"]), "").alias("form"))


def first_long_gap(rows: DataFrame, years: int, value: str, tie: str = "bout_id") -> DataFrame:
    """The first gap of so many calendar years across which a value changes."""
    w = Window.partitionBy("fighter").orderBy("date", tie)
    pairs = rows.withColumns({"__date": F.lag("date").over(w), "__value": F.lag(value).over(w)})
    hit = (F.year("date") - F.year("__date") >= years) & (F.col(value) != F.col("__value"))
    return pairs.where(hit).groupBy("fighter").agg(F.min("date").alias("date"), F.min_by(F.col("__value"), F.struct("date", tie)).alias("before"), F.min_by(F.col(value), F.struct("date", tie)).alias("after"))


def unretired(edges: DataFrame, wins: DataFrame) -> DataFrame:
    """Edges (winner, loser, date) whose loser has no later win."""
    last = wins.groupBy(F.col("fighter").alias("loser")).agg(F.max("date").alias("last_win"))
    return edges.join(last, "loser", "left").where(F.col("last_win").isNull() | (F.col("last_win") <= F.col("date"))).drop("last_win")


def latest_pair(edges: DataFrame, tie: str) -> DataFrame:
    """The latest edge of each unordered pair; of the same date the first."""
    best = F.max_by(F.struct("winner", "loser", "date"), F.struct(F.col("date"), -F.col(tie)))
    return edges.groupBy(F.least("winner", "loser").alias("lo"), F.greatest("winner", "loser").alias("hi")).agg(best.alias("e")).select("e.*")


def rank_change(current: DataFrame, previous: DataFrame, keys: list[str], shown: int = 15) -> DataFrame:
    """Places won or lost since before: a rank beyond those shown counts as none."""
    before = previous.where(F.col("rank") <= shown).select(*keys, F.col("rank").alias("before"))
    moved = F.col("before") - F.col("rank")
    kind = F.when(F.col("before").isNull(), "new").when(moved > 0, "up").when(moved < 0, "down").otherwise("same")
    return current.join(before, keys, "left").withColumns({"kind": kind, "places": F.abs(F.coalesce(moved, F.lit(0)))})


def running_year(rows: DataFrame, month: str, order: str, start: int, *by: str) -> DataFrame:
    """The year of each row of a list in descending months: a month above the one before is in the year before."""
    w = Window.partitionBy(*by).orderBy(order)
    wraps = F.when(F.col(month) > F.lag(month).over(w), 1).otherwise(0)
    return rows.withColumn("__wrap", wraps).withColumn("year", F.lit(start) - F.sum("__wrap").over(w)).drop("__wrap")


def recent_or_newest(rows: DataFrame, at: str, tie: str, since: Column, fallback: int, cap: int) -> DataFrame:
    """Rows since a moment, newest first, at most cap; where none is, the newest few of all."""
    newest = rows.orderBy(F.desc(at), tie).limit(max(cap, fallback))
    n = F.sum(F.when(F.col(at) >= since, 1).otherwise(0)).over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc(at), tie))
    return newest.withColumns({"__n": n, "place": place}).where(((F.col("__n") > 0) & (F.col(at) >= since) & (F.col("place") <= cap)) | ((F.col("__n") == 0) & (F.col("place") <= fallback))).drop("__n")


def top_per(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an ordering; numbers below 1 are 1."""
    number, size = max(1, number), max(1, size)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def ranged_page(rows: DataFrame, key: str, ties: list[Column], number: int, size: int, *, ranges: int = 64) -> DataFrame:
    """One page of rows by key, then ties, rows without a key last; numbers below 1 are 1, those beyond the last page the last.

    Counts of ranges between quantiles of the key tell where a page lies, so only the ranges it touches are
    read and sorted, whichever page it is. A key that very many rows share is one range, sorted by ties.
    """
    size = max(1, size)
    steps = [k / ranges for k in range(1, ranges)]
    cuts = sorted(set(rows.agg(F.percentile_approx(key, steps, 10_000)).first()[0] or []))
    marks = F.array(*map(F.lit, cuts)) if cuts else F.array().cast(f"array<{rows.schema[key].dataType.simpleString()}>")
    bucket = F.when(F.col(key).isNull(), len(cuts) + 1).otherwise(F.size(F.filter(marks, lambda c: c < F.col(key))))
    counts = dict(rows.groupBy(bucket.alias("b")).count().collect())  # a row for each range
    pages = max(1, -(-sum(counts.values()) // size))
    start = (min(max(1, number), pages) - 1) * size
    before, touched = 0, []
    skip = start
    for b in sorted(counts):
        if before + counts[b] > start and before < start + size:
            if not touched:
                skip = start - before
            touched.append(b)
        before += counts[b]
    if not touched:
        return rows.limit(0)
    low, high = touched[0], touched[-1]
    inside = F.lit(True) if low == 0 else F.col(key) > cuts[low - 1] if low <= len(cuts) else F.lit(False)
    if high < len(cuts):
        inside = inside & (F.col(key) <= cuts[high])
    if high > len(cuts):
        inside = inside | F.col(key).isNull()
    return rows.where(inside).orderBy(F.asc_nulls_last(key), *ties).offset(skip).limit(size)


def by_reading(rows: DataFrame, reading: str, name: str, out: str = "place") -> DataFrame:
    """Places in the Japanese order of readings, then names; rows without a reading come last, by name."""
    collated = lambda c: F.collate(F.col(c), "ja")
    return rows.withColumn(out, F.row_number().over(Window.orderBy(F.col(reading).isNull(), collated(reading), collated(name))))


def quantiles(rows: DataFrame, value: str, *by: str, parts: int = 4) -> DataFrame:
    """Each group's exact quartiles (or other parts) of a value."""
    steps = [k / parts for k in range(1, parts)]
    return rows.groupBy(*by).agg(F.percentile(value, F.array(*map(F.lit, steps))).alias("cuts"))


def within_range(rows: DataFrame, by: str, at: str, back: int, out: str = "n") -> DataFrame:
    """How many of the group's rows lie at most so many units before each row, itself included."""
    return rows.withColumn(out, F.count("*").over(Window.partitionBy(by).orderBy(at).rangeBetween(-back, 0)))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A sample that depends on the seed and the keys alone."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)
