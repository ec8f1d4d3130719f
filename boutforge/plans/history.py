"""Records and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import bouts as ops
from .registry import query
from .testdata import AS_OF, BOUTS_SQL, bouts, sides, table

RECORD_SQL = """count(*) FILTER (WHERE result = 'win') AS wins, count(*) FILTER (WHERE result = 'loss') AS losses,
  count(*) FILTER (WHERE result = 'draw') AS draws, count(*) FILTER (WHERE result = 'nc') AS no_contests"""
KINDS_SQL = ", ".join(f"count(*) FILTER (WHERE result = 'win' AND kind = '{k}') AS {k}_wins" for k in ("ko", "sub", "decision"))


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN floor(CAST(100 AS DOUBLE) * ({part}) / ({whole}) + 0.5) END"


@query(f"""{BOUTS_SQL}, r AS (SELECT division, fighter, {RECORD_SQL}, {KINDS_SQL} FROM sides GROUP BY division, fighter),
s AS (SELECT *, CAST(1500 AS DOUBLE) + 10 * (wins - losses) - 70 / sqrt(CAST(greatest(wins + losses + draws, 2) AS DOUBLE)) AS score FROM r WHERE wins + losses + draws > 0)
SELECT division, fighter, wins, losses, draws, no_contests, {pct("wins", "wins + losses")} AS win_rate, {pct("ko_wins + sub_wins", "wins")} AS finish_rate, round(score, 6) AS score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY division ORDER BY score DESC, fighter) AS INTEGER) AS rank FROM s) WHERE rank <= 15""")
def ranking_snapshot(spark, sf_dir):
    """Records, rates and the top 15 of each division by a discounted score."""
    record = ops.records(sides(spark, sf_dir), "division", "fighter", kinds=F.col("kind")).withColumn("fights", F.col("wins") + F.col("losses") + F.col("draws")).where("fights > 0")
    rated = ops.with_rates(record.withColumn("finish_wins", F.col("ko_wins") + F.col("sub_wins"))).withColumn("score", scores.sigma_discount(scores.INITIAL_RATING + 10 * (F.col("wins") - F.col("losses")), F.col("fights")))
    from ..operators.windows import ranked

    top = ranked(rated, [F.desc("score"), F.asc("fighter")], "division").where("rank <= 15")
    return top.select("division", "fighter", "wins", "losses", "draws", "no_contests", "win_rate", "finish_rate", F.round("score", 6).alias("score"), "rank")


@query(f"{BOUTS_SQL} SELECT fighter, {RECORD_SQL}, {KINDS_SQL} FROM sides GROUP BY fighter")
def fighter_record(spark, sf_dir):
    return ops.records(sides(spark, sf_dir), "fighter", kinds=F.col("kind"))


@query(f"{BOUTS_SQL} SELECT org, fighter, {RECORD_SQL} FROM sides GROUP BY org, fighter")
def org_record(spark, sf_dir):
    return ops.records(sides(spark, sf_dir), "org", "fighter")


@query(f"""{BOUTS_SQL}, r AS (SELECT org, fighter, {RECORD_SQL} FROM sides GROUP BY org, fighter)
SELECT fighter, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(losses) AS BIGINT) AS losses, CAST(sum(draws) AS BIGINT) AS draws, CAST(sum(no_contests) AS BIGINT) AS no_contests, string_agg(org, ',' ORDER BY org) AS orgs FROM r GROUP BY fighter""")
def record_across_orgs(spark, sf_dir):
    return ops.across_orgs(ops.records(sides(spark, sf_dir), "org", "fighter"), ["org0", "org1", "org2", "org3"])


@query(f"""{BOUTS_SQL}, r AS (SELECT fighter, {RECORD_SQL}, {KINDS_SQL} FROM sides GROUP BY fighter)
SELECT fighter, wins, {", ".join(f"{pct(f'{k}_wins', 'greatest(wins, ko_wins + sub_wins + decision_wins)')} AS {k}_share" for k in ("ko", "sub", "decision"))} FROM r""")
def method_shares(spark, sf_dir):
    record = ops.records(sides(spark, sf_dir), "fighter", kinds=F.col("kind"))
    return ops.method_shares(record).select("fighter", "wins", "ko_share", "sub_share", "decision_share")


@query(f"""{BOUTS_SQL}, r AS (SELECT fighter, {RECORD_SQL}, {KINDS_SQL} FROM sides GROUP BY fighter)
SELECT fighter, {pct("wins", "wins + losses")} AS win_rate, {pct("ko_wins + sub_wins", "wins")} AS finish_rate FROM r""")
def win_and_finish_rates(spark, sf_dir):
    record = ops.records(sides(spark, sf_dir), "fighter", kinds=F.col("kind"))
    return ops.with_rates(record.withColumn("finish_wins", F.col("ko_wins") + F.col("sub_wins"))).select("fighter", "win_rate", "finish_rate")


@query(f"""{BOUTS_SQL}, starts AS (SELECT fighter, CAST(min(date) + INTERVAL 365 DAY AS DATE) AS start FROM sides WHERE fighter LIKE 'S%' GROUP BY fighter),
excluded AS (SELECT DISTINCT fighter, date, opponent FROM sides WHERE quantity >= 48)
SELECT s.fighter, {RECORD_SQL} FROM sides s LEFT JOIN starts t ON s.fighter = t.fighter
WHERE (t.start IS NULL OR s.date >= t.start) AND NOT EXISTS (SELECT 1 FROM excluded e WHERE e.fighter = s.fighter AND e.date = s.date AND e.opponent = s.opponent) GROUP BY s.fighter""")
def scoped_record(spark, sf_dir):
    both = sides(spark, sf_dir)
    starts = both.where("fighter like 'S%'").groupBy("fighter").agg(F.date_add(F.min("date"), 365).alias("start"))
    excluded = both.where("quantity >= 48").select("fighter", "date", "opponent").distinct()
    return ops.records(ops.scoped(both, starts, excluded), "fighter")


@query(f"""{BOUTS_SQL}, f AS (SELECT *, min(CASE WHEN org = 'org1' THEN date END) OVER (PARTITION BY fighter) AS first FROM sides)
SELECT fighter, {RECORD_SQL} FROM f WHERE date < first GROUP BY fighter""")
def record_before_debut(spark, sf_dir):
    return ops.records(ops.before_first(sides(spark, sf_dir), F.col("org") == "org1"), "fighter")


@query(f"""{BOUTS_SQL}, told AS (SELECT concat_ws('|', date, least(fighter, opponent), greatest(fighter, opponent)) AS key, bout_id, CASE WHEN fighter < opponent THEN result ELSE CASE result WHEN 'win' THEN 'loss' WHEN 'loss' THEN 'win' ELSE result END END AS result, finish FROM sides WHERE result <> 'nc'),
g AS (SELECT key, min(CASE result WHEN 'win' THEN 1.0::DOUBLE WHEN 'loss' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END) AS lo, max(CASE result WHEN 'win' THEN 1.0::DOUBLE WHEN 'loss' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END) AS hi, bool_and(finish) AS finish, min(bout_id) AS payload, count(*) AS n_rows FROM told GROUP BY key)
SELECT key, lo AS score_a, finish, payload, n_rows FROM g WHERE lo = hi""")
def reconciled_bouts(spark, sf_dir):
    """Both sides' tellings to one bout; contradictions are dropped."""
    s = sides(spark, sf_dir).where("result <> 'nc'")
    lower = F.col("fighter") < F.col("opponent")
    own = F.when(F.col("result") == "draw", 0.5).when((F.col("result") == "win") == lower, 1.0).otherwise(0.0)
    key = F.concat_ws("|", F.col("date").cast("string"), F.least("fighter", "opponent"), F.greatest("fighter", "opponent"))
    return ops.reconcile(s.select(key.alias("key"), F.col("bout_id").alias("ord"), own.alias("score_a"), "finish", F.col("bout_id").alias("payload")))


@query(f"""{BOUTS_SQL}, wall AS (SELECT * FROM sides WHERE org = 'org0'), known AS (SELECT * FROM sides WHERE org = 'org1')
SELECT w.fighter, w.opponent, w.bout_id FROM wall w WHERE NOT EXISTS (SELECT 1 FROM known k WHERE w.fighter = k.fighter AND w.date = k.date AND (w.kind = k.kind OR (w.result = k.result AND right(w.opponent, 1) = right(k.opponent, 1))))""")
def without_ghost_bouts(spark, sf_dir):
    s = sides(spark, sf_dir).withColumn("method", F.col("kind"))
    related = F.expr("right(w.opponent, 1) = right(k.opponent, 1)")
    return ops.without_ghosts(s.where("org = 'org0'"), s.where("org = 'org1'"), related).select("fighter", "opponent", "bout_id")


_TOTALS_SQL = f"totals AS (SELECT fighter, {RECORD_SQL} FROM sides WHERE quantity < 49 OR fighter LIKE 'C%' GROUP BY fighter), c AS (SELECT fighter, {RECORD_SQL} FROM sides WHERE NOT opener GROUP BY fighter)"


def _totals(s):
    return ops.records(s.where("quantity < 49 or fighter like 'C%'"), "fighter").drop("no_contests")


@query(f"""{BOUTS_SQL}, {_TOTALS_SQL}, d AS (SELECT t.fighter, coalesce(c.wins, 0) - t.wins AS wins_diff, coalesce(c.losses, 0) - t.losses AS losses_diff, coalesce(c.draws, 0) - t.draws AS draws_diff FROM totals t LEFT JOIN c USING (fighter))
SELECT *, CASE WHEN wins_diff > 0 OR losses_diff > 0 OR draws_diff > 0 THEN 'fatal' WHEN wins_diff < 0 OR losses_diff < 0 OR draws_diff < 0 THEN 'warn' ELSE 'ok' END AS level FROM d""")
def record_integrity(spark, sf_dir):
    s = sides(spark, sf_dir)
    return ops.integrity(s.where("not opener"), _totals(s))


@query(f"""{BOUTS_SQL}, {_TOTALS_SQL}, j AS (SELECT t.fighter, t.wins tw, t.losses tl, t.draws td, c.wins cw, c.losses cl, c.draws cd, c.wins IS NOT NULL AND (c.wins <> t.wins OR c.losses <> t.losses OR c.draws <> t.draws) AS repaired FROM totals t LEFT JOIN c USING (fighter))
SELECT fighter, CASE WHEN repaired THEN cw ELSE tw END AS wins, CASE WHEN repaired THEN cl ELSE tl END AS losses, CASE WHEN repaired THEN cd ELSE td END AS draws, repaired FROM j""")
def repaired_totals(spark, sf_dir):
    s = sides(spark, sf_dir)
    return ops.repaired_totals(s.where("not opener"), _totals(s))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS date FROM lineitem),
g AS (SELECT l_orderkey, CASE WHEN min(date) = max(date) THEN min(date) END AS only_date FROM e GROUP BY l_orderkey)
SELECT e.l_orderkey, e.l_linenumber, e.l_partkey, coalesce(e.date, g.only_date) AS date FROM e JOIN g USING (l_orderkey)""", dates=("date",))
def sibling_dates(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") % 2 != 0, F.col("l_shipdate").cast("date")).alias("date"))
    return ops.sole_sibling_date(items, "l_orderkey")


@query(f"""{BOUTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY fighter ORDER BY date DESC, bout_id DESC) AS nth FROM sides), c AS (SELECT fighter, org, count(*) AS n, min(nth) AS newest FROM r WHERE nth <= 3 GROUP BY fighter, org)
SELECT fighter, org, n FROM (SELECT *, row_number() OVER (PARTITION BY fighter ORDER BY n DESC, newest) AS p FROM c) WHERE p = 1""")
def recent_org(spark, sf_dir):
    return ops.recent_mode(sides(spark, sf_dir), "org", [F.desc("date"), F.desc("bout_id")], 3)


@query(f"""{BOUTS_SQL}, c AS (SELECT fighter, division, count(*) AS n, max(date) AS latest FROM sides WHERE date >= DATE '1999-12-31' GROUP BY fighter, division)
SELECT fighter, division, n, latest FROM (SELECT *, row_number() OVER (PARTITION BY fighter ORDER BY n DESC, latest DESC, division) AS p FROM c) WHERE p = 1""", dates=("latest",))
def division_vote(spark, sf_dir):
    """The division of most bouts in two years; ties by the latest bout, then the lightest."""
    return ops.vote(sides(spark, sf_dir).where("date >= '1999-12-31'"), "division", F.col("division"))


@query(f"""{BOUTS_SQL} SELECT fighter, round(sum(least(CAST(1 AS DOUBLE), pow(CAST(0.5 AS DOUBLE), datediff('day', date, DATE '{AS_OF}') / CAST(365.25 AS DOUBLE) / 2))), 6) AS title_value, count(*) AS titles, max(date) AS last_title FROM sides WHERE result = 'win' AND quantity >= 45 GROUP BY fighter""", dates=("last_title",))
def title_achievement(spark, sf_dir):
    won = ops.title_value(sides(spark, sf_dir).where("result = 'win' and quantity >= 45"), F.lit(AS_OF).cast("date"))
    return won.withColumn("title_value", F.round("title_value", 6))


@query(f"""{BOUTS_SQL}, r AS (SELECT fighter, {RECORD_SQL} FROM sides GROUP BY fighter), p AS (SELECT fighter, wins + losses + draws AS n, CAST(1500 + 10 * (wins - losses) AS DOUBLE) AS x FROM r WHERE wins + losses + draws > 0)
SELECT fighter, n, round((SELECT avg(x) FROM p) + (x - (SELECT avg(x) FROM p)) * (n / (n + CAST(4 AS DOUBLE))), 6) AS shrunk FROM p""")
def shrunk_ratings(spark, sf_dir):
    pool = ops.records(sides(spark, sf_dir), "fighter").withColumn("n", F.col("wins") + F.col("losses") + F.col("draws")).where("n > 0").withColumn("x", (1500 + 10 * (F.col("wins") - F.col("losses"))).cast("double"))
    mean = pool.agg(F.avg("x").alias("mean"))
    return pool.crossJoin(F.broadcast(mean)).select("fighter", "n", F.round(scores.shrunk(F.col("x"), F.col("mean"), F.col("n")), 6).alias("shrunk"))


@query(f"""{BOUTS_SQL} SELECT count(*) AS n_bouts, count(DISTINCT a) AS customers, count(DISTINCT b) AS suppliers, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (WHERE score_a IS NULL) AS no_contests FROM bouts""", dates=("first_date", "last_date",))
def global_stats(spark, sf_dir):
    b = bouts(spark, sf_dir)
    return b.agg(F.count("*").alias("n_bouts"), F.countDistinct("a").alias("customers"), F.countDistinct("b").alias("suppliers"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), ops.count_if(F.col("score_a").isNull()).alias("no_contests"))


@query(f"""{BOUTS_SQL}, c AS (SELECT fighter, count(*) FILTER (WHERE date >= DATE '2001-01-01') AS this_year, count(*) FILTER (WHERE date >= DATE '2000-01-01' AND date < DATE '2001-01-01') AS last_year, count(DISTINCT opponent) FILTER (WHERE date >= DATE '2000-01-01') AS opponents FROM sides GROUP BY fighter)
SELECT fighter, this_year, last_year, opponents, greatest(this_year, last_year) >= 2 AS active FROM c""")
def recent_activity(spark, sf_dir):
    this, last = F.col("date") >= "2001-01-01", (F.col("date") >= "2000-01-01") & (F.col("date") < "2001-01-01")
    c = sides(spark, sf_dir).groupBy("fighter").agg(ops.count_if(this).alias("this_year"), ops.count_if(last).alias("last_year"), F.countDistinct(F.when(F.col("date") >= "2000-01-01", F.col("opponent"))).alias("opponents"))
    return c.withColumn("active", F.greatest("this_year", "last_year") >= 2)


@query(f"""{BOUTS_SQL}, r AS (SELECT fighter, {RECORD_SQL} FROM sides WHERE date >= DATE '2001-03-01' GROUP BY fighter) SELECT fighter, wins FROM r WHERE losses = 0 AND wins + draws + no_contests >= 3""")
def undefeated(spark, sf_dir):
    return ops.records(sides(spark, sf_dir).where("date >= '2001-03-01'"), "fighter").where("losses = 0 and wins + draws + no_contests >= 3").select("fighter", "wins")
