"""Windows over bouts, and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rating
from ..operators import windows as ops
from ..operators.bouts import count_if
from .registry import query
from .testdata import BOUTS_SQL, bouts, sides, table

MONTH = 30.44


@query(f"""{BOUTS_SQL}, g AS (SELECT fighter, date, lag(date) OVER (PARTITION BY fighter ORDER BY date, bout_id) AS before FROM sides)
SELECT fighter, max(CASE WHEN datediff('day', before, date) > 60 THEN before END) AS cutoff FROM g GROUP BY fighter""", dates=("cutoff",))
def inactivity_cutoff(spark, sf_dir):
    return ops.last_before_gap(sides(spark, sf_dir), 60)


_CURRENT = "current_division AS (SELECT fighter, arg_max(division, (date, bout_id)) AS current FROM sides GROUP BY fighter)"


@query(f"""{BOUTS_SQL}, {_CURRENT}, k AS (SELECT s.fighter, date, division, current, lag(division) OVER w AS prev, lead(division) OVER w AS next FROM sides s JOIN current_division USING (fighter) WINDOW w AS (PARTITION BY s.fighter ORDER BY date, bout_id))
SELECT fighter, max(CASE WHEN division <> current AND NOT coalesce(prev = current AND next = current, false) THEN date END) AS cutoff FROM k GROUP BY fighter""", dates=("cutoff",))
def division_cutoff(spark, sf_dir):
    s = sides(spark, sf_dir)
    current = s.groupBy("fighter").agg(F.max_by("division", F.struct("date", "bout_id")).alias("current"))
    return ops.division_cutoff(s.join(current, "fighter"))


@query(f"""{BOUTS_SQL}, n AS (SELECT fighter, result, row_number() OVER (PARTITION BY fighter ORDER BY date DESC, bout_id DESC) AS nth FROM sides WHERE result <> 'nc')
SELECT fighter, string_agg(upper(substr(result, 1, 1)), '' ORDER BY nth) AS form FROM n WHERE nth <= 5 GROUP BY fighter""")
def last_five(spark, sf_dir):
    return ops.last_results(sides(spark, sf_dir), 5)


@query(f"""{BOUTS_SQL}, p AS (SELECT fighter, date, bout_id, org, lag(date) OVER w AS pd, lag(org) OVER w AS po FROM sides WINDOW w AS (PARTITION BY fighter ORDER BY date, bout_id))
SELECT fighter, min(date) AS date, arg_min(po, (date, bout_id)) AS before, arg_min(org, (date, bout_id)) AS after FROM p WHERE year(date) - year(pd) >= 1 AND org <> po GROUP BY fighter""", dates=("date",))
def long_gap_with_move(spark, sf_dir):
    return ops.first_long_gap(sides(spark, sf_dir), 1, "org")


_EDGES = "edges AS (SELECT division, fighter AS winner, opponent AS loser, date, bout_id FROM sides WHERE result = 'win')"


def edges(spark, sf_dir):
    won = lambda x, y: F.when(F.col("score_a") == 1, F.col(x)).otherwise(F.col(y))
    return bouts(spark, sf_dir).where("score_a in (0, 1)").select("division", won("a", "b").alias("winner"), won("b", "a").alias("loser"), "date", "bout_id")


@query(f"""{BOUTS_SQL}, {_EDGES}, w AS (SELECT fighter, max(date) AS last_win FROM sides WHERE result = 'win' GROUP BY fighter)
SELECT winner, loser, date, bout_id FROM edges LEFT JOIN w ON loser = fighter WHERE last_win IS NULL OR last_win <= date""", dates=("date",))
def unretired_edges(spark, sf_dir):
    e = edges(spark, sf_dir)
    return ops.unretired(e, sides(spark, sf_dir).where("result = 'win'")).select("winner", "loser", "date", "bout_id")


@query(f"""{BOUTS_SQL}, {_EDGES} SELECT winner, loser, date FROM (SELECT *, row_number() OVER (PARTITION BY least(winner, loser), greatest(winner, loser) ORDER BY date DESC, bout_id) AS p FROM edges) WHERE p = 1""", dates=("date",))
def latest_pair_result(spark, sf_dir):
    return ops.latest_pair(edges(spark, sf_dir), "bout_id")




def wins_ranking(spark, sf_dir, before: str):
    n = edges(spark, sf_dir).where(F.col("date") < before).groupBy("division", F.col("winner").alias("fighter")).agg(F.count("*").alias("n"))
    return ops.ranked(n, [F.desc("n"), F.asc("fighter")], "division").select("division", "fighter", "rank")


def ranks_sql(name: str, before: str) -> str:
    return f"""{name} AS (SELECT division, fighter, CAST(row_number() OVER (PARTITION BY division ORDER BY n DESC, fighter) AS INTEGER) AS rank FROM (SELECT division, fighter, count(*) AS n FROM sides WHERE result = 'win' AND date < DATE '{before}' GROUP BY division, fighter))"""


@query(f"""{BOUTS_SQL}, {ranks_sql("cur", "2001-06-01")}, {ranks_sql("prv", "2000-06-01")}
SELECT c.division, c.fighter, c.rank, coalesce(p.rank, 0) AS before, CASE WHEN p.rank IS NULL THEN 'new' WHEN p.rank > c.rank THEN 'up' WHEN p.rank < c.rank THEN 'down' ELSE 'same' END AS kind, abs(coalesce(p.rank - c.rank, 0)) AS places
FROM cur c LEFT JOIN (SELECT * FROM prv WHERE rank <= 15) p USING (division, fighter)""")
def rank_change(spark, sf_dir):
    return ops.rank_change(wins_ranking(spark, sf_dir, "2001-06-01"), wins_ranking(spark, sf_dir, "2000-06-01"), ["division", "fighter"]).withColumn("before", F.coalesce("before", F.lit(0)))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders), w AS (SELECT *, CASE WHEN month > lag(month) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) THEN 1 ELSE 0 END AS wrap FROM r)
SELECT o_custkey, o_orderkey, month, CAST(2001 - sum(wrap) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS year FROM w""")
def running_year(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.month("o_orderdate").alias("month"))
    return ops.running_year(rows, "month", "o_orderkey", 2001, "o_custkey")


@query(f"""{BOUTS_SQL}, r AS (SELECT division, fighter, CAST(1500 + 10 * (count(*) FILTER (WHERE result = 'win') - count(*) FILTER (WHERE result = 'loss')) AS DOUBLE) AS rating, count(*) FILTER (WHERE result = 'win' AND quantity >= 49) AS titles, count(*) AS n FROM sides GROUP BY division, fighter),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY division ORDER BY n DESC, fighter) AS INTEGER) AS position FROM r), s AS (SELECT *, rating + 15 * titles AS own_score FROM p),
q AS (SELECT *, max(own_score) OVER (PARTITION BY division ORDER BY position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS score FROM s)
SELECT division, fighter, position, own_score, score, CAST(row_number() OVER (ORDER BY score DESC, position, fighter, division) AS INTEGER) AS p4p_rank FROM q WHERE position <= 10""")
def pound_for_pound(spark, sf_dir):
    win = F.col("result") == "win"
    r = sides(spark, sf_dir).groupBy("division", "fighter").agg((1500 + 10 * (count_if(win) - count_if(F.col("result") == "loss"))).cast("double").alias("rating"), count_if(win & (F.col("quantity") >= 49)).cast("double").alias("title_value"), F.count("*").alias("n"))
    return rating.pound_for_pound(r, [F.desc("n"), F.asc("fighter")], top=10).select("division", "fighter", "position", "own_score", "score", "p4p_rank")


@query("SELECT event_id, event_type, CAST(place AS INTEGER) AS place FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS place FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) WHERE place <= 24")
def bucket_top(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("newest"))
    week = events.crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.col("newest") - F.expr("INTERVAL 7 DAYS"))
    return ops.top_per(week, "event_type", [F.desc("ts"), F.asc("event_id")], 24).select("event_id", "event_type", "place")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def third_page(spark, sf_dir):
    return ops.page(table(spark, sf_dir, "events").select("event_id", "ts"), [F.desc("ts"), F.asc("event_id")], 3, 20)


@query("SELECT p_partkey, p_name FROM part ORDER BY md5(p_partkey || ':30'), p_partkey LIMIT 30")
def seeded_sample(spark, sf_dir):
    return ops.seeded_sample(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", 30, 30)


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id) AS place, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-29 00:00:00') OVER () AS n FROM events)
SELECT event_id, ts, CAST(place AS INTEGER) AS place FROM n WHERE (n > 0 AND ts >= TIMESTAMP '2024-01-29 00:00:00' AND place <= 15) OR (n = 0 AND place <= 5)""")
def recent_or_newest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts")
    return ops.recent_or_newest(rows, "ts", "event_id", F.expr("TIMESTAMP_NTZ '2024-01-29 00:00:00'"), 5, 15)
