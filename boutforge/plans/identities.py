"""Rosters of customers and suppliers, and bouts told by three sources, brought together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import identity
from .registry import query
from .testdata import BOUTS_SQL, bouts, table


def roster(spark, sf_dir) -> DataFrame:
    """Customers and suppliers as roster rows of four sources and three kinds of gym; names are shared by some neighbours."""
    forms = []
    for name, key, nation, first in (("customer", "c_custkey", "c_nationkey", 0), ("supplier", "s_suppkey", "s_nationkey", 1)):
        k = F.col(key)
        alias = F.when(k % 3 == 0, F.concat(F.lit("n"), F.floor((k + 7) / 5)))
        gym = F.when(F.col(nation) % 4 == 1, "gym").when(F.col(nation) % 4 == 2, "gym east").when(F.col(nation) % 4 == 3, "dojo")
        forms.append(table(spark, sf_dir, name).select((k * 2 + first).alias("ord"), F.array_compact(F.array(F.concat(F.lit("n"), F.floor(k / 5)), alias)).alias("names"), F.concat(F.lit("s"), (k + first) % 4).alias("source"), gym.alias("gym"), (k % 7 != 0).alias("full")))
    return reduce(DataFrame.unionByName, forms)


@query()
def roster_entities(spark, sf_dir):
    """SQL has no form for unions under constraints; a test goes through all edges one after another."""
    return identity.roster_union(roster(spark, sf_dir))


@query(f"""{BOUTS_SQL}, o AS (SELECT a AS fighter, b AS opponent, date, date - DATE '1970-01-01' AS d, bout_id, org FROM bouts),
w AS (SELECT fighter, opponent, date + INTERVAL 1 DAY AS date, d + 1 AS d FROM o WHERE bout_id % 3 = 0), u AS (SELECT fighter, opponent, count(*) AS n FROM o WHERE bout_id % 5 = 0 GROUP BY ALL),
days AS (SELECT fighter, opponent, d, count(*) AS n, any_value(org) AS org FROM o GROUP BY ALL), runs AS (SELECT *, d - row_number() OVER (PARTITION BY fighter, opponent ORDER BY d) AS run FROM days),
places AS (SELECT *, row_number() OVER (PARTITION BY fighter, opponent, run ORDER BY d) % 2 AS odd FROM runs), heads AS (SELECT fighter, opponent, d, n, 0 AS wiki, CASE WHEN odd = 1 THEN d ELSE d - 1 END AS head FROM places),
wd AS (SELECT fighter, opponent, d, count(*) AS n FROM w GROUP BY ALL),
wh AS (SELECT wd.fighter, wd.opponent, wd.d, 0 AS n, wd.n AS wiki, CASE WHEN same.d IS NOT NULL THEN same.head WHEN before.head = wd.d - 1 THEN wd.d - 1 WHEN after.d IS NOT NULL THEN wd.d + 1 ELSE wd.d END AS head FROM wd
  LEFT JOIN heads same ON same.fighter = wd.fighter AND same.opponent = wd.opponent AND same.d = wd.d LEFT JOIN heads before ON before.fighter = wd.fighter AND before.opponent = wd.opponent AND before.d = wd.d - 1
  LEFT JOIN heads after ON after.fighter = wd.fighter AND after.opponent = wd.opponent AND after.d = wd.d + 1),
t AS (SELECT fighter, opponent, head, sum(n) AS n, sum(wiki) AS wiki FROM (SELECT * FROM heads UNION ALL SELECT * FROM wh) GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY fighter, opponent ORDER BY CASE WHEN n > 0 THEN 0 ELSE 1 END, head) = 1 AS first FROM t)
SELECT f.fighter, f.opponent, CAST(DATE '1970-01-01' + CAST(head AS INTEGER) AS VARCHAR) AS date, CASE WHEN f.n > 0 THEN 'official' ELSE 'wiki' END AS source, CASE WHEN first AND u.n IS NOT NULL THEN 'final' END AS title,
concat_ws(',', CASE WHEN f.n > 0 AND wiki > 0 THEN 'wiki' END, CASE WHEN first AND u.n IS NOT NULL THEN 'web' END) AS also_from
FROM f LEFT JOIN u ON u.fighter = f.fighter AND u.opponent = f.opponent""")
def bouts_told_once(spark, sf_dir):
    """All bouts as their organiser tells them, some a day late by a wiki and some without a date elsewhere; a sponsor's name stands before an event's."""
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    number = lambda source: F.concat(F.lit(str(source)), F.lpad(day.cast("string"), 6, "0"), F.lpad(F.col("bout_id").cast("string"), 20, "0"))
    form = lambda source, name, date, event, title: F.struct(number(source).alias("ord"), F.col("a").alias("fighter"), F.col("b").alias("opponent"), date.alias("date"), event.alias("event"), F.lit(name).alias("source"), F.lit(title).cast("string").alias("title"))
    official = form(0, "official", F.col("date"), F.concat(F.lit("Cup "), "org"), None)
    wiki = form(1, "wiki", F.date_add("date", 1), F.concat(F.lit("Sponsor presents CUP"), "org"), None)
    web = form(2, "web", F.lit(None).cast("date"), F.concat(F.lit("cup "), "org"), "final")
    told = F.array_compact(F.array(official, F.when(F.col("bout_id") % 3 == 0, wiki), F.when(F.col("bout_id") % 5 == 0, web)))
    found = identity.repeated_bouts(bouts(spark, sf_dir).select(F.explode(told).alias("x")).select("x.*"))
    return found.select("fighter", "opponent", F.col("date").cast("string").alias("date"), "source", "title", F.array_join("also_from", ",").alias("also_from"))
