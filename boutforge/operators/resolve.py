"""Names to identities, and joins on more than equal keys.

Dimensions are joined by Spark's own choice of strategy; interval and fuzzy joins get an equi-key from
blocks or buckets, so that none is a nested loop over both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed

SENT_BYTES = 8 << 20  # of a table that is sent to every task


def first_wins(names: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key to the value that came first."""
    return names.groupBy(key).agg(F.min_by(value, order).alias(value))


def unique_only(names: DataFrame, key: str, value: str) -> DataFrame:
    """key to its value where there is just one."""
    return names.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo = hi").select(key, F.col("lo").alias(value))


def cascade(rows: DataFrame, lookups: list[tuple[str, DataFrame]], value: str, out: str) -> DataFrame:
    """The value from the first lookup that has the row's key; each lookup is (column of rows, table of key and value)."""
    found = []
    for n, (column, table) in enumerate(lookups):
        named = table.select(F.col(table.columns[0]).alias(f"__k{n}"), F.col(value).alias(f"__v{n}"))
        rows = rows.join(named, rows[column] == named[f"__k{n}"], "left").drop(f"__k{n}")
        found.append(f"__v{n}")
    return rows.withColumn(out, F.coalesce(*found)).drop(*found)


def agreeing(rows: DataFrame, direct: str, stripped: str, denied: DataFrame, key: list[str], out: str) -> DataFrame:
    """Two ways to resolve a name, which must agree where both succeed; denied keys resolve to nothing."""
    both = F.when(F.col(direct).isNotNull() & F.col(stripped).isNotNull() & (F.col(direct) != F.col(stripped)), F.lit(None)).otherwise(F.coalesce(direct, stripped))
    flagged = rows.join(denied.select(*key).distinct().withColumn("__denied", F.lit(True)), key, "left")
    return flagged.withColumn(out, F.when(F.col("__denied").isNull(), both)).drop("__denied")


def override_results(history: DataFrame, official: DataFrame) -> DataFrame:
    """Official results by (fighter, date); several on a day count only for the opponent they name; else history stays."""
    n = F.count("*").over(Window.partitionBy("fighter", "date"))
    o = official.select("fighter", "date", F.col("opponent").alias("o_opponent"), F.col("result").alias("o_result")).withColumn("o_n", n)
    joined = history.join(o.withColumnsRenamed({"fighter": "o_fighter", "date": "o_date"}), (F.col("fighter") == F.col("o_fighter")) & (F.col("date") == F.col("o_date")) & ((F.col("o_n") == 1) | (F.col("opponent") == F.col("o_opponent"))), "left")
    return joined.withColumn("result", F.coalesce("o_result", "result")).withColumn("overridden", F.col("o_result").isNotNull()).drop("o_fighter", "o_date", "o_opponent", "o_result", "o_n")


def symmetric_enrich(sides: DataFrame, facts: DataFrame, value: str, order: str) -> DataFrame:
    """A value known for a pair and date in either order; of several the first."""
    key = facts.groupBy("date", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min_by(value, order).alias(value))
    keyed = sides.withColumns({"lo": F.least("fighter", "opponent"), "hi": F.greatest("fighter", "opponent")})
    return keyed.join(key, ["date", "lo", "hi"], "left").drop("lo", "hi")


def common_opponents(left: DataFrame, right: DataFrame) -> DataFrame:
    """Bouts of two fighters against the same opponents, the i-th oldest of one beside the i-th oldest of the other."""
    nth = F.row_number().over(Window.partitionBy("opponent").orderBy("date", "bout_id"))
    a = left.join(right.select("opponent").distinct(), "opponent", "left_semi").select("opponent", nth.alias("nth"), F.col("date").alias("date_a"), F.col("result").alias("result_a"))
    b = right.join(left.select("opponent").distinct(), "opponent", "left_semi").select("opponent", nth.alias("nth"), F.col("date").alias("date_b"), F.col("result").alias("result_b"))
    return a.join(b, ["opponent", "nth"], "full")


def within_days(left: DataFrame, right: DataFrame, keys: list[str], days: int, left_date: str, right_date: str) -> DataFrame:
    """Pairs with equal keys and dates at most so many days apart: buckets of that width, each left row in three."""
    number = lambda c: F.floor(F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")) / max(1, days))
    a = left.withColumn("__bucket", F.explode(F.array(number(left_date) - 1, number(left_date), number(left_date) + 1)))
    b = right.withColumn("__bucket", number(right_date))
    near = F.abs(F.datediff(F.col(left_date).cast("date"), F.col(right_date).cast("date"))) <= days
    return a.join(b, [*keys, "__bucket"]).where(near).drop("__bucket")


def sole_match(pairs: DataFrame, key: str) -> DataFrame:
    """Only pairs whose left row has no other."""
    return pairs.withColumn("__n", F.count("*").over(Window.partitionBy(key))).where("__n = 1").drop("__n")


def sole_within_days(left: DataFrame, right: DataFrame, keys: list[str], days: int, left_date: str, right_date: str, key: str) -> DataFrame:
    """Each left row with the only right row of equal keys so many days around it; rows with none or several are left out.

    Right rows are counted by day first, and windows over the daily counts find left rows with one match.
    So a key of very many rows on either side makes no pairs but those that stay.
    """
    number = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date"))
    daily = right.groupBy(*keys, number(right_date).alias("__day")).agg(F.count("*").alias("__n"))
    asked = left.select(*keys, number(left_date).alias("__day")).distinct().withColumn("__n", F.lit(0))
    around = Window.partitionBy(*keys).orderBy("__day").rangeBetween(-days, days)
    both = daily.withColumn("__asked", F.lit(False)).unionByName(asked.withColumn("__asked", F.lit(True)))
    sole = both.withColumn("__all", F.sum("__n").over(around)).where("__asked and __all = 1").select(*keys, F.col("__day").alias("__left_day"))
    ready = left.withColumn("__left_day", number(left_date)).join(sole, [*keys, "__left_day"], "left_semi").drop("__left_day")
    return within_days(ready, right, keys, days, left_date, right_date)


def near_names(names: DataFrame, others: DataFrame, *, most: int = 2, gram: int = 2) -> DataFrame:
    """(name, other, distance) at edit distance 1 to most, and 2 at least for names of up to three characters.

    Names meet by a deletion signature: two names at distance d share a string that is left of each when
    at most d characters are deleted, so the join is on equal strings of bounded number for short names.
    """

    def signatures(frame: DataFrame, column: str) -> DataFrame:
        one = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(s), F.lit(1))), lambda i: F.concat(F.substring(s, 1, i - 1), F.substr(s, i + 1)))
        parts = F.array(F.col(column))
        for _ in range(most):
            parts = F.array_distinct(F.concat(parts, F.flatten(F.transform(parts, one))))
        return frame.select(column, F.explode(parts).alias("__sig"))

    a = signatures(names.select(F.col(names.columns[0]).alias("name")).distinct(), "name")
    b = signatures(others.select(F.col(others.columns[0]).alias("other")).distinct(), "other")
    pairs = a.join(b, "__sig").select("name", "other").distinct()
    far = pairs.withColumn("distance", F.levenshtein("name", "other"))
    short = (F.col("distance") == 1) & (F.least(F.char_length("name"), F.char_length("other")) <= 3)
    return far.where(F.col("distance").between(1, most) & ~short)


def greedy_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """One-to-one pairs within equal keys, first with first; what is over stays unpaired."""
    a = left.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(left_id)))
    b = right.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(right_id)))
    return a.join(b, [*keys, "__n"]).drop("__n")


def next_event(rows: DataFrame, events: DataFrame, key: str, at: str, event_at: str, event: Column) -> DataFrame:
    """Each row with its key's earliest event after it: rows and events in one ordered window, no range join."""
    r = rows.select(F.lit(0).alias("__side"), F.col(key).alias("__key"), F.col(at).alias("__at"), F.struct(*rows.columns).alias("__row"), F.lit(None).cast(events.select(event.alias("e")).schema["e"].dataType).alias("__event"))
    e = events.select(F.lit(1).alias("__side"), F.col(key).alias("__key"), F.col(event_at).alias("__at"), F.lit(None).cast(r.schema["__row"].dataType).alias("__row"), event.alias("__event"))
    # later rows first; of the same moment, events come after rows and so don't count as later
    w = Window.partitionBy("__key").orderBy(F.desc("__at"), F.asc("__side"), F.desc("__event")).rowsBetween(Window.unboundedPreceding, -1)
    return r.unionByName(e).withColumn("next", F.last("__event", ignorenulls=True).over(w)).where("__side = 0").select("__row.*", "next")


def contained(titles: DataFrame, names: DataFrame, title: str, name: str, *, top: int, gram: int = 3) -> DataFrame:
    """Names that occur in titles, the first few of each by place; they meet by the names' first characters.

    Names of at most ``SENT_BYTES`` in all are sent to every task, and titles stay where they are; more names are
    shuffled with the titles. Titles are never sent: they become a row for each place, which sizes of files don't tell.
    """
    grams = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(title) - gram + 1, F.lit(1))), lambda i: F.substring(F.col(title), i, gram))))
    t = titles.withColumn("__gram", grams)
    n = checkpointed(names.where(F.char_length(name) >= gram).withColumn("__gram", F.substring(name, 1, gram)))
    few = (n.agg(F.sum(F.octet_length(name) + 16)).first()[0] or 0) <= SENT_BYTES
    found = t.join(n.hint("broadcast" if few else "merge"), "__gram").drop("__gram").withColumn("at", F.instr(F.col(title), F.col(name))).where("at > 0")
    order = Window.partitionBy(*titles.columns).orderBy("at", name)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def keep_last_good(previous: DataFrame, fresh: DataFrame, key: str, bad: Column, columns: list[str]) -> DataFrame:
    """Fresh rows, but the previous one where the fresh one is bad or missing."""
    p = previous.select(key, F.struct(*columns).alias("__p"))
    f = fresh.select(key, F.struct(*columns).alias("__f"), bad.alias("__bad"))
    use = F.when(F.col("__f").isNull() | (F.col("__bad") & F.col("__p").isNotNull()), F.col("__p")).otherwise(F.col("__f"))
    return p.join(f, key, "full").select(key, use.alias("__r"), (F.col("__f").isNull() | (F.col("__bad") & F.col("__p").isNotNull())).alias("kept_previous")).select(key, "__r.*", "kept_previous")
