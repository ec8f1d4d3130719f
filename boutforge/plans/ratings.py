"""Ratings and rankings from the bouts view."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import headtohead, rating
from .registry import query
from .sequences import _EDGES, edges, ranks_sql, wins_ranking
from .testdata import AS_OF, BOUTS_SQL, bouts, sides, table, tasks_for

_ELIGIBLE_SQL = f"""cur AS (SELECT fighter, arg_max(division, (date, bout_id)) AS current FROM sides GROUP BY fighter), s AS (SELECT sides.*, current FROM sides JOIN cur USING (fighter) WHERE NOT opener),
g AS (SELECT fighter, max(CASE WHEN datediff('day', before, date) > 547.92 THEN before END) AS gap FROM (SELECT fighter, date, lag(date) OVER (PARTITION BY fighter ORDER BY date, bout_id) AS before FROM s) GROUP BY fighter),
m AS (SELECT fighter, max(CASE WHEN division <> current AND NOT coalesce(prev = current AND next = current, false) THEN date END) AS moved FROM (SELECT fighter, date, division, current, lag(division) OVER w AS prev, lead(division) OVER w AS next FROM s WINDOW w AS (PARTITION BY fighter ORDER BY date, bout_id)) GROUP BY fighter),
c AS (SELECT s.*, moved, gap, sum(CASE WHEN date <= gap THEN 1 ELSE 0 END) OVER (PARTITION BY fighter) >= 4 AS veteran FROM s JOIN g USING (fighter) JOIN m USING (fighter)),
i AS (SELECT *, CASE WHEN veteran OR gap IS NULL THEN moved WHEN moved IS NULL THEN gap ELSE greatest(moved, gap) END AS cutoff FROM c),
e AS (SELECT fighter, count(*) FILTER (WHERE cutoff IS NULL OR date > cutoff) AS fights, count(*) FILTER (WHERE (cutoff IS NULL OR date > cutoff) AND result = 'win') AS wins, count(*) FILTER (WHERE (cutoff IS NULL OR date > cutoff) AND date >= DATE '2001-01-01') AS recent, max(date) AS last_date FROM i GROUP BY fighter)"""


@query(f"{BOUTS_SQL}, {_ELIGIBLE_SQL} SELECT *, (fights >= 3 OR recent >= 2) AND wins >= 1 AND datediff('day', last_date, DATE '{AS_OF}') / CAST(30.44 AS DOUBLE) <= 18 AS eligible FROM e", dates=("last_date",))
def eligibility(spark, sf_dir):
    s = sides(spark, sf_dir)
    current = s.groupBy("fighter").agg(F.max_by("division", F.struct("date", "bout_id")).alias("current"))
    return rating.eligibility(s.join(current, "fighter"), F.lit(AS_OF).cast("date"), recent_from="2001-01-01")


@query(f"""{BOUTS_SQL}, r AS (SELECT fighter, CAST(1500 + 10 * (count(*) FILTER (WHERE result = 'win') - count(*) FILTER (WHERE result = 'loss')) AS DOUBLE) AS rating, max(date) AS last_date FROM sides WHERE date < DATE '2001-01-01' GROUP BY fighter)
SELECT fighter, rating, CASE WHEN floor(datediff('day', last_date, DATE '{AS_OF}') / 180.0) <= 0 THEN rating ELSE greatest(CAST(1400 AS DOUBLE), rating - floor(datediff('day', last_date, DATE '{AS_OF}') / 180.0) * 25) END AS shown FROM r""")
def decayed_ratings(spark, sf_dir):
    win, loss = F.count(F.when(F.col("result") == "win", 1)), F.count(F.when(F.col("result") == "loss", 1))
    r = sides(spark, sf_dir).where("date < '2001-01-01'").groupBy("fighter").agg((1500 + 10 * (win - loss)).cast("double").alias("rating"), F.max("date").alias("last_date"))
    idle = F.datediff(F.lit(AS_OF).cast("date"), F.col("last_date"))
    return r.select("fighter", "rating", scores.decayed(F.col("rating"), idle, 25.0).alias("shown"))


@query(f"""{BOUTS_SQL}, r AS (SELECT fighter, count(*) AS fights, count(*) FILTER (WHERE result = 'win') AS wins, count(*) FILTER (WHERE result = 'loss') AS losses, count(*) FILTER (WHERE org = 'org1') AS scoped FROM sides WHERE date < DATE '1996-01-01' GROUP BY fighter)
SELECT fighter, round(1500 + CASE WHEN fights >= 3 THEN greatest(CAST(-80 AS DOUBLE), least(CAST(80 AS DOUBLE), CAST(10 * (wins - losses) AS DOUBLE))) * (scoped / (scoped + CAST(5 AS DOUBLE))) ELSE 0 END, 6) AS seed FROM r""")
def seed_ratings(spark, sf_dir):
    count = lambda c: F.count(F.when(c, 1))
    r = sides(spark, sf_dir).where("date < '1996-01-01'").groupBy("fighter").agg(F.count("*").alias("fights"), count(F.col("result") == "win").alias("wins"), count(F.col("result") == "loss").alias("losses"), count(F.col("org") == "org1").alias("scoped"))
    return r.select("fighter", F.round(scores.seed_rating(F.col("fights"), F.col("wins"), F.col("losses"), F.col("scoped")), 6).alias("seed"))


def _trace(spark, sf_dir):
    played = bouts(spark, sf_dir).withColumn("key", F.lpad(F.col("bout_id").cast("string"), 20, "0"))
    return rating.trace(played, tasks=tasks_for(table(spark, sf_dir, "lineitem")))


@query(dates=("last_date",))
def elo_ratings(spark, sf_dir):
    """The rating of every fighter after all bouts; tested against a plain replay."""
    return rating.states(_trace(spark, sf_dir))


@query(dates=("date",))
def elo_trace(spark, sf_dir):
    return _trace(spark, sf_dir)


@query(f"""{BOUTS_SQL}, {ranks_sql("cur", "2001-06-01")}, {ranks_sql("prv", "2000-06-01")}, j AS (SELECT coalesce(p.division, c.division) AS division, coalesce(p.fighter, c.fighter) AS fighter, p.rank AS before, c.rank AS after FROM (SELECT * FROM prv WHERE rank <= 15) p FULL JOIN (SELECT * FROM cur WHERE rank <= 15) c ON p.division = c.division AND p.fighter = c.fighter)
SELECT division, fighter, coalesce(before, 0) AS before, coalesce(after, 0) AS after, CASE WHEN after = 1 AND (before IS NULL OR before <> 1) THEN 'champion' WHEN before = 1 AND after IS NULL THEN 'vacated' WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'dropped' WHEN after < before THEN 'up' ELSE 'down' END AS change FROM j WHERE before IS NULL OR after IS NULL OR before <> after""")
def ranking_diff(spark, sf_dir):
    return rating.snapshot_diff(wins_ranking(spark, sf_dir, "2000-06-01"), wins_ranking(spark, sf_dir, "2001-06-01"), ["division", "fighter"], 15).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("before", "after")})


@query(f"""{BOUTS_SQL}, p AS (SELECT fighter, CAST(count(*) AS DOUBLE) AS before FROM sides WHERE date < DATE '2001-06-01' GROUP BY 1), c AS (SELECT fighter, CAST(count(*) FILTER (WHERE date < DATE '2001-06-01') + count(*) FILTER (WHERE opener AND date < DATE '1998-01-01') AS DOUBLE) AS after FROM sides GROUP BY 1)
SELECT fighter, before, after FROM p JOIN c USING (fighter) WHERE abs(after - before) > 0.001 AND fighter NOT IN (SELECT fighter FROM sides WHERE date >= DATE '2001-06-01')""")
def ripple_audit(spark, sf_dir):
    s = sides(spark, sf_dir)
    early = F.col("date") < "2001-06-01"
    before = s.where(early).groupBy("fighter").agg(F.count("*").cast("double").alias("rating"))
    after = s.groupBy("fighter").agg((F.count(F.when(early, 1)) + F.count(F.when(F.col("opener") & (F.col("date") < "1998-01-01"), 1))).cast("double").alias("rating"))
    return rating.ripples(before, after, s.where(~early))


_NATIONS_SQL = """x AS (SELECT c_nationkey AS w, s_nationkey AS l FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'A' AND c_nationkey <> s_nationkey),
edges AS (SELECT DISTINCT w AS winner, l AS loser FROM x)"""


@query(f"WITH RECURSIVE {_NATIONS_SQL}, reach AS (SELECT winner, loser FROM edges UNION SELECT r.winner, e.loser FROM reach r JOIN edges e ON r.loser = e.winner) SELECT 'all' AS division, e.winner, e.loser FROM edges e WHERE EXISTS (SELECT 1 FROM reach r WHERE r.winner = e.loser AND r.loser = e.winner)")
def cyclic_edges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = lines.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = named.select(F.lit("all").alias("division"), F.col("c_nationkey").alias("winner"), F.col("s_nationkey").alias("loser")).where("winner <> loser").distinct()
    return headtohead.cyclic(e, ["division"])


def _latest(spark, sf_dir):
    e = edges(spark, sf_dir)
    best = F.row_number().over(Window.partitionBy("division", F.least("winner", "loser"), F.greatest("winner", "loser")).orderBy(F.desc("date"), "bout_id"))
    return e.withColumn("n", best).where("n = 1").select("division", "winner", "loser", "date")


@query()
def head_to_head_order(spark, sf_dir):
    """Each division by wins, moved to agree with who beat whom last; tested against an order of all edges."""
    return headtohead.reorder(wins_ranking(spark, sf_dir, "2002-01-01"), edges(spark, sf_dir), tie="bout_id")


@query(f"""{BOUTS_SQL}, {_EDGES}, l AS (SELECT division, winner, loser, date FROM (SELECT *, row_number() OVER (PARTITION BY division, least(winner, loser), greatest(winner, loser) ORDER BY date DESC, bout_id) AS p FROM edges) WHERE p = 1), {ranks_sql("top", "2002-01-01")}
SELECT l.division, winner, loser, l.date, w.rank AS winner_rank, x.rank AS loser_rank FROM l JOIN top w ON l.division = w.division AND winner = w.fighter JOIN top x ON l.division = x.division AND loser = x.fighter WHERE w.rank > x.rank""", dates=("date",))
def head_to_head_violations(spark, sf_dir):
    return headtohead.violations(wins_ranking(spark, sf_dir, "2002-01-01"), _latest(spark, sf_dir))
