"""Hand-kept corrections over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import overrides
from .registry import query
from .testdata import BOUTS_SQL, bouts, sides, table

_HISTORY = """h AS (SELECT DISTINCT 'C' || o_custkey AS fighter, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, 'o' || (o_orderkey % 50) AS opponent, o_orderstatus AS result, o_orderpriority AS method FROM orders)"""
#: (order, type, every n-th customer, opponent, new value)
_PATCHES = [(1, "remove", 7, "o1", None), (2, "patch-date", 5, "o2", "2000-01-01"), (3, "patch-result", 5, "o2", "W"), (4, "patch-method", 3, "o3", "KO"), (5, "patch-weight-class", 2, "o4", "フライ級"), (6, "add", 4, "o5", "A")]


@query(f"""WITH {_HISTORY}, p AS (SELECT *, CAST(substr(fighter, 2) AS INTEGER) AS n FROM h),
one AS (SELECT * FROM p WHERE NOT (n % 7 = 0 AND opponent = 'o1')),
two AS (SELECT fighter, n, CASE WHEN n % 5 = 0 AND opponent = 'o2' THEN '2000-01-01' ELSE date END AS date, opponent, result, method FROM one),
three AS (SELECT fighter, n, date, opponent, CASE WHEN n % 5 = 0 AND opponent = 'o2' AND date = '2000-01-01' THEN 'W' ELSE result END AS result, CASE WHEN n % 5 = 0 AND opponent = 'o2' AND date = '2000-01-01' THEN 'fixed' ELSE CASE WHEN n % 3 = 0 AND opponent = 'o3' THEN 'KO' ELSE method END END AS method, CASE WHEN n % 2 = 0 AND opponent = 'o4' THEN 'フライ級' END AS weight_class FROM two),
added AS (SELECT DISTINCT fighter, n, '1999-09-09' AS date, 'o5' AS opponent, 'A' AS result, 'new' AS method, NULL AS weight_class FROM p WHERE n % 4 = 0)
SELECT fighter, date, opponent, result, method, weight_class FROM three UNION ALL SELECT fighter, date, opponent, result, method, weight_class FROM added a WHERE NOT EXISTS (SELECT 1 FROM three t WHERE t.fighter = a.fighter AND t.date = a.date AND t.opponent = a.opponent)""")
def patched_histories(spark, sf_dir):
    """Each kind of patch, in order: the third finds rows by the date that the second gave them."""
    o = table(spark, sf_dir, "orders")
    h = o.select(F.concat(F.lit("C"), "o_custkey").alias("fighter"), F.col("o_orderdate").cast("date").cast("string").alias("date"), F.concat(F.lit("o"), F.col("o_orderkey") % 50).alias("opponent"), F.col("o_orderstatus").alias("result"), F.col("o_orderpriority").alias("method")).distinct()
    h = h.withColumns({c: F.lit(None).cast("string") for c in ("event", "round", "weight_class")})
    number = F.substr("fighter", F.lit(2)).cast("int")
    none = F.lit(None).cast("string")
    rows = None
    for order, kind, every, opponent, value in _PATCHES:
        if kind == "add":
            hit = h.where(number % every == 0).select("fighter").distinct().select("fighter", F.lit("1999-09-09").alias("date"))
        elif kind == "patch-result":
            hit = h.where(number % every == 0).select("fighter").distinct().select("fighter", F.lit("2000-01-01").alias("date"))
        else:
            hit = h.where((number % every == 0) & (F.col("opponent") == opponent)).select("fighter", "date").distinct()
        method = {"patch-result": "fixed", "patch-method": value, "add": "new"}.get(kind)
        made = hit.select(
            "fighter", F.lit(order).alias("ord"), F.lit(kind).alias("type"), "date", F.lit(opponent).alias("opponent"),
            (F.lit(value) if kind in ("patch-result", "add") else none).alias("result"), F.lit(method).cast("string").alias("method"), none.alias("event"), none.alias("round"),
            (F.lit(value) if kind == "patch-weight-class" else none).alias("weight_class"), (F.lit(value) if kind == "patch-date" else none).alias("new_date"),
        )
        rows = made if rows is None else rows.unionByName(made)
    return overrides.patched(h, rows).select("fighter", "date", "opponent", "result", "method", "weight_class")


@query(f"""{BOUTS_SQL}, r AS (SELECT DISTINCT fighter, date, opponent, CASE WHEN quantity < 25 THEN 'self' ELSE 'opponent' END AS missed_by FROM sides WHERE bout_id % 11 = 0 AND org = 'org2'), u AS (SELECT fighter, date, opponent, min(missed_by) AS missed_by FROM r GROUP BY ALL)
SELECT s.bout_id, s.fighter, CASE WHEN missed_by = 'opponent' AND result = 'loss' THEN 'nc' WHEN missed_by = 'self' AND result = 'win' THEN 'nc' ELSE result END AS result FROM sides s LEFT JOIN u USING (fighter, date, opponent) WHERE org = 'org2'""")
def weigh_in_rulings(spark, sf_dir):
    s = sides(spark, sf_dir).where("org = 'org2'")
    rulings = s.where("bout_id % 11 = 0").groupBy("fighter", "date", "opponent").agg(F.min(F.when(F.col("quantity") < 25, "self").otherwise("opponent")).alias("missed_by"))
    return overrides.ruled(s, rulings, ["fighter", "date", "opponent"]).select("bout_id", "fighter", "result")


@query(f"{BOUTS_SQL}, l AS (SELECT DISTINCT fighter, date FROM sides WHERE quantity = 50) SELECT bout_id, s.fighter, opener OR l.fighter IS NOT NULL AS opener FROM sides s LEFT JOIN l ON s.fighter = l.fighter AND s.date = l.date WHERE org = 'org3'")
def opener_overrides(spark, sf_dir):
    s = sides(spark, sf_dir)
    return overrides.flagged(s.where("org = 'org3'"), s.where("quantity = 50"), ["fighter", "date"], "opener").select("bout_id", "fighter", "opener")


@query(f"""{BOUTS_SQL}, cur AS (SELECT fighter, arg_max(division, (date, bout_id)) AS division FROM sides GROUP BY fighter), o AS (SELECT fighter, date, min(division) AS division FROM sides WHERE quantity = 1 GROUP BY ALL)
SELECT s.fighter, count(*) FILTER (WHERE coalesce(o.division, s.division) = c.division) AS fights FROM sides s JOIN cur c ON s.fighter = c.fighter LEFT JOIN o ON s.fighter = o.fighter AND s.date = o.date GROUP BY s.fighter""")
def scoped_fight_counts(spark, sf_dir):
    s = sides(spark, sf_dir)
    current = s.groupBy("fighter").agg(F.max_by("division", F.struct("date", "bout_id")).alias("division"))
    single = s.where("quantity = 1").groupBy("fighter", "date").agg(F.min("division").alias("division"))
    return overrides.scoped_fights(s, current, single)


@query(f"""{BOUTS_SQL}, f AS (SELECT DISTINCT fighter, division FROM sides) SELECT fighter, division FROM f WHERE fighter NOT IN (SELECT 'C' || c_custkey FROM customer WHERE c_acctbal < 0) AND fighter NOT IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal < 0) AND NOT EXISTS (SELECT 1 FROM sides s WHERE s.quantity > 48 AND s.fighter = f.fighter AND s.division = f.division)""")
def fact_exclusions(spark, sf_dir):
    s = sides(spark, sf_dir)
    poor = lambda t, k, b, p: table(spark, sf_dir, t).where(f"{b} < 0").select(F.concat(F.lit(p), k).alias("fighter"))
    left = overrides.excluded(s.select("fighter", "division").distinct(), [(poor("customer", "c_custkey", "c_acctbal", "C"), ["fighter"]), (poor("supplier", "s_suppkey", "s_acctbal", "S"), ["fighter"]), (s.where("quantity > 48"), ["fighter", "division"])])
    return left


@query("SELECT c_custkey, coalesce(o.seg, c_mktsegment) AS c_mktsegment FROM customer c LEFT JOIN (SELECT o_custkey, 'override' AS seg FROM orders GROUP BY o_custkey HAVING count(*) > 12) o ON c.c_custkey = o.o_custkey")
def overlay_lookups(spark, sf_dir):
    many = table(spark, sf_dir, "orders").groupBy("o_custkey").count().where("count > 12").select(F.col("o_custkey").alias("c_custkey"), F.lit("override").alias("c_mktsegment"))
    return overrides.overlaid(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), many, ["c_custkey"], "c_mktsegment")


_CARD = "SELECT o_custkey AS event, 'P' || (o_orderkey % 30) AS a, 'Q' || (o_orderkey % 17) AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F'"


@query(f"""WITH b AS ({_CARD}), e AS (SELECT DISTINCT o_custkey AS event, 'Q' || (o_orderkey % 17) AS a, 'P' || (o_orderkey % 30) AS b FROM orders WHERE o_orderstatus <> 'F'), h AS (SELECT event, least(a, b) AS lo, greatest(a, b) AS hi, place FROM b),
n AS (SELECT event, least(a, b) AS lo, greatest(a, b) AS hi FROM e WHERE event IN (SELECT event FROM b)), x AS (SELECT * FROM h UNION ALL SELECT event, lo, hi, NULL FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.event = n.event AND h.lo = n.lo AND h.hi = n.hi))
SELECT event, lo, hi, CAST(row_number() OVER (PARTITION BY event ORDER BY coalesce(place, -1), lo || '|' || hi) AS INTEGER) AS place FROM x""")
def supplemented_cards(spark, sf_dir):
    card = lambda o: o.select(F.col("o_custkey").alias("event"), F.concat(F.lit("P"), F.col("o_orderkey") % 30).alias("a"), F.concat(F.lit("Q"), F.col("o_orderkey") % 17).alias("b"), "o_orderkey")
    orders = table(spark, sf_dir, "orders")
    have = card(orders.where("o_orderstatus = 'F'")).withColumn("place", F.row_number().over(Window.partitionBy("event").orderBy("o_orderkey"))).drop("o_orderkey")
    extra = card(orders.where("o_orderstatus <> 'F'")).select("event", F.col("b").alias("a"), F.col("a").alias("b")).distinct()
    return overrides.supplemented(have, extra, ["event"]).select("event", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "place")


@query("SELECT DISTINCT o_custkey AS event FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)")
def homeless_supplements(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "event")
    return overrides.homeless(o.where("o_orderstatus = 'F' and o_totalprice > 200000"), o.where("o_orderstatus = 'P'"), ["event"])


@query(f"""WITH b AS ({_CARD}), x AS (SELECT event, a, CAST(place AS DOUBLE) AS place FROM b UNION ALL SELECT DISTINCT o_custkey, 'R' || o_custkey, 1.5 FROM orders WHERE o_orderstatus = 'P')
SELECT event, a, place, CAST(row_number() OVER (PARTITION BY event ORDER BY place DESC, a) AS INTEGER) AS shown FROM x""")
def fractional_cards(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    have = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("event"), F.concat(F.lit("P"), F.col("o_orderkey") % 30).alias("a"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("place"))
    extra = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("event"), F.concat(F.lit("R"), "o_custkey").alias("a"), F.lit(1.5).alias("place")).distinct()
    return overrides.with_fractional_places(have, extra, ["event"])


@query("""WITH p AS (SELECT o_custkey AS event, o_orderkey, o_orderkey % 9 = 0 AS bad, CASE WHEN o_orderkey % 4 = 1 THEN 'アマチュア' ELSE '第1試合' END AS heading FROM orders), t AS (SELECT *, count(*) FILTER (WHERE bad) OVER (PARTITION BY event) AS failed FROM p)
SELECT event, o_orderkey, failed, count(*) OVER (PARTITION BY event) - row_number() OVER (PARTITION BY event ORDER BY o_orderkey) + 1 AS place FROM t WHERE NOT bad AND heading <> 'アマチュア'""")
def assembled_cards(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    parsed = o.select(F.col("o_custkey").alias("event"), "o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.lit("a")).alias("a"), F.lit("b").alias("b"), F.when(F.col("o_orderkey") % 4 == 1, "アマチュア").otherwise("第1試合").alias("heading"))
    return overrides.assembled(parsed, ["event"], "o_orderkey").select("event", "o_orderkey", "failed", "place")


@query("""WITH b AS (SELECT o_orderkey, o_custkey AS fighter, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, o_orderpriority AS opponent, o_orderstatus AS result FROM orders),
f AS (SELECT DISTINCT fighter, date, opponent FROM b WHERE o_orderkey % 3 = 0), d AS (SELECT DISTINCT fighter, opponent FROM b WHERE fighter % 10 = 0 AND opponent LIKE '5%')
SELECT o_orderkey, CASE WHEN d.fighter IS NOT NULL THEN '1990-01-01' ELSE b.date END AS date, CASE WHEN f.fighter IS NOT NULL THEN 'fixed' ELSE result END AS result FROM b LEFT JOIN f ON b.fighter = f.fighter AND b.date = f.date AND b.opponent = f.opponent LEFT JOIN d ON b.fighter = d.fighter AND b.opponent = d.opponent""")
def corrected_bouts(spark, sf_dir):
    b = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("fighter"), F.col("o_orderdate").cast("date").cast("string").alias("date"), F.col("o_orderpriority").alias("opponent"), F.col("o_orderstatus").alias("result"))
    full = b.where("o_orderkey % 3 = 0").select("fighter", "date", "opponent", F.lit("result").alias("field"), F.lit("fixed").alias("value")).distinct()
    dates = b.where("fighter % 10 = 0 and opponent like '5%'").select("fighter", F.lit(None).cast("string").alias("date"), "opponent", F.lit("date").alias("field"), F.lit("1990-01-01").alias("value")).distinct()
    return overrides.corrected(b, full.unionByName(dates), ["date", "result"]).select("o_orderkey", "date", "result")


@query("SELECT c_custkey AS rule, count(o_orderkey) AS hits, count(o_orderkey) = 1 AS as_expected FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def rule_hits(spark, sf_dir):
    rules = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rule"), F.col("c_custkey").alias("o_custkey"))
    return overrides.rule_hits(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), rules, ["o_custkey"])


@query("""WITH p AS (SELECT c_nationkey AS org, c_mktsegment AS unit, c_custkey AS id FROM customer), f AS (SELECT * FROM p WHERE org % 3 = 0 OR (org % 3 = 1 AND unit = 'BUILDING')),
u AS (SELECT org, count(DISTINCT unit) AS n FROM p GROUP BY org), v AS (SELECT org, count(DISTINCT unit) AS n FROM f GROUP BY org), ok AS (SELECT v.org FROM v LEFT JOIN u ON u.org = v.org WHERE u.n IS NULL OR v.n >= u.n / 2.0)
SELECT org, unit, id, false AS kept_previous FROM f WHERE org IN (SELECT org FROM ok) UNION ALL SELECT org, unit, id, true FROM p WHERE org NOT IN (SELECT org FROM ok)""")
def guarded_rankings(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("org"), F.col("c_mktsegment").alias("unit"), F.col("c_custkey").alias("id"))
    return overrides.guarded(p, p.where("org % 3 = 0 or (org % 3 = 1 and unit = 'BUILDING')"), "org", "unit")


@query(f"""{BOUTS_SQL}, one AS (SELECT fighter AS key, count(*) FILTER (WHERE result = 'win') AS wins, count(*) FILTER (WHERE result = 'loss') AS losses, count(*) FILTER (WHERE result = 'draw') AS draws FROM sides WHERE org = 'org0' GROUP BY fighter), al AS (SELECT fighter AS key, count(*) FILTER (WHERE result = 'win') AS wins, count(*) FILTER (WHERE result = 'loss') AS losses, count(*) FILTER (WHERE result = 'draw') AS draws FROM sides GROUP BY fighter),
s AS (SELECT *, length(key) % 2 = 0 AS no_record, key LIKE '%3' AS needs_review, key LIKE 'S%' AS live, key LIKE '%5' AS from_results FROM one),
t AS (SELECT s.*, a.wins AS w, a.losses AS l, a.draws AS d, CASE WHEN no_record THEN true WHEN needs_review AND NOT live THEN a.wins + a.losses + a.draws > 0 WHEN NOT from_results THEN false ELSE a.wins + a.losses + a.draws > s.wins + s.losses + s.draws END AND a.wins + a.losses + a.draws > 0 AS rolled_up FROM s JOIN al a USING (key))
SELECT key, CASE WHEN rolled_up THEN w ELSE wins END AS wins, CASE WHEN rolled_up THEN l ELSE losses END AS losses, CASE WHEN rolled_up THEN d ELSE draws END AS draws, rolled_up FROM t""")
def rolled_up_records(spark, sf_dir):
    s = sides(spark, sf_dir).withColumnRenamed("fighter", "key")
    n = lambda r: F.count(F.when(F.col("result") == r, 1))
    record = lambda rows: rows.groupBy("key").agg(n("win").alias("wins"), n("loss").alias("losses"), n("draw").alias("draws"))
    key = F.col("key")
    shown = record(s.where("org = 'org0'")).withColumns({"no_record": F.char_length(key) % 2 == 0, "needs_review": key.endswith("3"), "live": key.startswith("S"), "from_results": key.endswith("5")})
    return overrides.prefer_rolled_up(shown, record(s))


@query(f"{BOUTS_SQL} SELECT bout_id, a, b, CASE WHEN o.v IS NULL THEN division ELSE 'other rules' END AS rule_type FROM bouts LEFT JOIN (SELECT DISTINCT org AS event, date AS d, least(a, b) AS lo, greatest(a, b) AS hi, 1 AS v FROM bouts WHERE quantity = 7) o ON bouts.org = o.event AND bouts.date = o.d AND least(a, b) = lo AND greatest(a, b) = hi")
def bout_rule_overrides(spark, sf_dir):
    b = bouts(spark, sf_dir).select("bout_id", "a", "b", F.col("org").alias("event"), "date", F.col("division").alias("rule_type"), "quantity")
    o = b.where("quantity = 7").select("event", "date", F.col("b").alias("a"), F.col("a").alias("b"), F.lit("other rules").alias("rule_type")).distinct()
    return overrides.rule_types(b, o).select("bout_id", "a", "b", "rule_type")
