"""Names, joins on more than equal keys, and differences between tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedupe, quality, resolve
from ..operators.bouts import two_sided
from .registry import query
from .testdata import BOUTS_SQL, bouts, dealt_sides, sides, table


@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def first_name_wins(spark, sf_dir):
    return resolve.first_wins(table(spark, sf_dir, "part"), "p_name", "p_partkey", "p_partkey")


@query("SELECT key, min(p_brand) AS p_brand FROM (SELECT p_name || '/' || p_size AS key, p_brand FROM part) GROUP BY key HAVING count(DISTINCT p_brand) = 1")
def unambiguous_name(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_name", F.col("p_size").cast("string")).alias("key"), "p_brand")
    return resolve.unique_only(part, "key", "p_brand")


@query("""WITH n AS (SELECT p_name, min(p_partkey) AS v FROM part GROUP BY p_name HAVING count(*) = 1), b AS (SELECT p_brand || p_size AS k, min(p_partkey) AS v FROM part GROUP BY 1 HAVING count(*) = 1), t AS (SELECT p_type AS k, min(p_partkey) AS v FROM part GROUP BY 1)
SELECT p.p_partkey, coalesce(n.v, b.v, t.v) AS resolved FROM part p LEFT JOIN n ON p.p_name = n.p_name LEFT JOIN b ON p.p_brand || p.p_size = b.k LEFT JOIN t ON p.p_type = t.k""")
def resolution_cascade(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("k", F.concat("p_brand", F.col("p_size").cast("string")))
    pick = lambda c, sole: part.groupBy(c).agg(F.min("p_partkey").alias("v"), F.count("*").alias("n")).where("n = 1" if sole else "true").select(c, "v")
    found = resolve.cascade(part, [("p_name", pick("p_name", True)), ("k", pick("k", True)), ("p_type", pick("p_type", False))], "v", "resolved")
    return found.select("p_partkey", "resolved")


@query(f"""{BOUTS_SQL}, h AS MATERIALIZED (SELECT bout_id, fighter, opponent, date, result FROM sides WHERE org = 'org1'),
o AS MATERIALIZED (SELECT fighter, date, opponent AS named, 'official ' || result AS told FROM sides WHERE org = 'org2' AND fighter LIKE 'C%'),
one AS MATERIALIZED (SELECT fighter, date, any_value(told) AS told FROM o GROUP BY fighter, date HAVING count(*) = 1), days AS MATERIALIZED (SELECT fighter, date FROM o GROUP BY fighter, date HAVING count(*) > 1),
many AS MATERIALIZED (SELECT o.* FROM o JOIN days ON o.fighter = days.fighter AND o.date = days.date)
SELECT h.bout_id, h.fighter, coalesce(one.told, many.told, h.result) AS result, coalesce(one.told, many.told) IS NOT NULL AS overridden FROM h LEFT JOIN one ON h.fighter = one.fighter AND h.date = one.date LEFT JOIN many ON h.fighter = many.fighter AND h.date = many.date AND h.opponent = many.named""")
def official_override(spark, sf_dir):
    s = sides(spark, sf_dir)
    official = s.where("org = 'org2' and fighter like 'C%'").select("fighter", "date", "opponent", F.concat(F.lit("official "), "result").alias("result"))
    return resolve.override_results(s.where("org = 'org1'"), official).select("bout_id", "fighter", "result", "overridden")


@query(f"""{BOUTS_SQL}, f AS (SELECT date, least(a, b) AS lo, greatest(a, b) AS hi, arg_min(division, bout_id) AS division FROM bouts WHERE org <> 'org3' GROUP BY ALL)
SELECT s.fighter, s.bout_id, f.division AS known_division FROM sides s LEFT JOIN f ON s.date = f.date AND least(s.fighter, s.opponent) = f.lo AND greatest(s.fighter, s.opponent) = f.hi WHERE s.org = 'org3'""")
def weight_class_lookup(spark, sf_dir):
    s = sides(spark, sf_dir).where("org = 'org3'").select("fighter", "opponent", "bout_id", "date")
    facts = bouts(spark, sf_dir).where("org <> 'org3'").select("date", "a", "b", "bout_id", F.col("division").alias("known_division"))
    return resolve.symmetric_enrich(s, facts, "known_division", "bout_id").select("fighter", "bout_id", "known_division")


@query(f"{BOUTS_SQL} SELECT fighter, opponent, count(*) AS bouts, count(*) FILTER (WHERE result = 'win') AS wins, max(date) AS latest FROM sides GROUP BY fighter, opponent HAVING count(*) > 1", dates=("latest",))
def head_to_head(spark, sf_dir):
    # partial counts of pairs that mostly meet once are as many as the rows: the rows are dealt first
    return dealt_sides(spark, sf_dir, "fighter", "opponent").groupBy("fighter", "opponent").agg(F.count("*").alias("bouts"), F.count(F.when(F.col("result") == "win", 1)).alias("wins"), F.max("date").alias("latest")).where("bouts > 1")


@query(f"""{BOUTS_SQL}, x AS (SELECT opponent, row_number() OVER (PARTITION BY opponent ORDER BY date, bout_id) AS nth, date AS date_a, result AS result_a FROM sides WHERE fighter = 'S1' AND opponent IN (SELECT opponent FROM sides WHERE fighter = 'S2')),
y AS (SELECT opponent, row_number() OVER (PARTITION BY opponent ORDER BY date, bout_id) AS nth, date AS date_b, result AS result_b FROM sides WHERE fighter = 'S2' AND opponent IN (SELECT opponent FROM sides WHERE fighter = 'S1'))
SELECT coalesce(x.opponent, y.opponent) AS opponent, CAST(coalesce(x.nth, y.nth) AS INTEGER) AS nth, date_a, result_a, date_b, result_b FROM x FULL JOIN y ON x.opponent = y.opponent AND x.nth = y.nth""", dates=("date_a", "date_b",))
def common_opponents(spark, sf_dir):
    s = sides(spark, sf_dir)
    return resolve.common_opponents(s.where("fighter = 'S1'"), s.where("fighter = 'S2'"))


@query(f"""{BOUTS_SQL}, m AS (SELECT x.bout_id, y.bout_id AS other_id, x.fighter, count(*) OVER (PARTITION BY x.bout_id) AS n FROM (SELECT * FROM sides WHERE org = 'org0') x JOIN (SELECT * FROM sides WHERE org = 'org1') y ON x.fighter = y.fighter AND abs(datediff('day', x.date, y.date)) <= 3)
SELECT bout_id, other_id, fighter FROM m WHERE n = 1""")
def reciprocal_within_days(spark, sf_dir):
    s = sides(spark, sf_dir)
    x = s.where("org = 'org0'").select("fighter", "bout_id", "date")
    y = s.where("org = 'org1'").select("fighter", F.col("bout_id").alias("other_id"), F.col("date").alias("other_date"))
    return resolve.sole_within_days(x, y, ["fighter"], 3, "date", "other_date", "bout_id").select("bout_id", "other_id", "fighter")


@query("""SELECT name, other, CAST(levenshtein(name, other) AS INTEGER) AS distance FROM (SELECT DISTINCT p_name AS name FROM part), (SELECT DISTINCT p_name AS other FROM part)
WHERE levenshtein(name, other) BETWEEN 1 AND 2 AND NOT (levenshtein(name, other) = 1 AND least(length(name), length(other)) <= 3)""")
def near_miss_names(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name")
    return resolve.near_names(names, names)


@query("""WITH a AS (SELECT o_custkey, o_orderdate, o_orderkey, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey, o_orderdate, o_orderkey AS other, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderdate, o_orderkey, other FROM a JOIN b USING (o_orderdate, n)""")
def schedule_pairs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    a = orders.where("o_orderstatus = 'F'").drop("o_orderstatus")
    b = orders.where("o_orderstatus = 'O'").drop("o_orderstatus").withColumnRenamed("o_orderkey", "other")
    return resolve.greedy_pairs(a, b.drop("o_custkey"), ["o_orderdate"], "o_orderkey", "other").select("o_orderdate", "o_orderkey", "other")


@query("SELECT event_id, coalesce(min(next_id), -1) AS next_purchase FROM (SELECT e.event_id, p.event_id AS next_id, p.ts, min(p.ts) OVER (PARTITION BY e.event_id) AS first FROM (SELECT * FROM events WHERE event_type = 'click') e LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND p.ts > e.ts) WHERE ts IS NULL OR ts = first GROUP BY event_id")
def next_purchase(spark, sf_dir):
    """For each click the user's next purchase: an as-of join forward."""
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    buys = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return resolve.next_event(clicks, buys, "user_id", "ts", "ts", F.col("event_id")).select("event_id", F.coalesce("next", F.lit(-1)).alias("next_purchase"))


@query("""WITH n AS (SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part), t AS (SELECT p_partkey, upper(p_name) || ' ' || p_type || ' ' || p_name AS title FROM part)
SELECT p_partkey, name, CAST(found AS INTEGER) AS found, CAST(place AS INTEGER) AS place FROM (SELECT p_partkey, name, instr(title, name) AS found, row_number() OVER (PARTITION BY p_partkey, title ORDER BY instr(title, name), name) AS place FROM t, n WHERE instr(title, name) > 0 AND length(name) >= 3) WHERE place <= 3""")
def related_chips(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_type").alias("name")).union(part.select(F.split("p_name", " ")[1])).distinct()
    titles = part.select("p_partkey", F.concat_ws(" ", F.upper("p_name"), "p_type", "p_name").alias("title"))
    return resolve.contained(titles, names, "title", "name", top=3).select("p_partkey", "name", F.col("at").alias("found"), "place")


@query(f"""{BOUTS_SQL}, w AS (SELECT fighter, opponent, bout_id, date FROM sides WHERE result = 'win')
SELECT w.bout_id, w.fighter, w.opponent, count(*) AS opponent_bouts, count(*) FILTER (WHERE s.result = 'win') AS opponent_wins FROM w JOIN sides s ON s.fighter = w.opponent AND s.date <= w.date GROUP BY ALL""")
def opponent_standing_as_of(spark, sf_dir):
    """The record that the opponent of each win had on the day: running counts in one window instead of a range join."""
    from pyspark.sql import Window

    s = dealt_sides(spark, sf_dir, "fighter").select("fighter", "opponent", "bout_id", "date", "result").where("fighter is not null and date is not null")
    # up to the day and all of it
    so_far = Window.partitionBy("fighter").orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    told = s.withColumns({"n": F.count("*").over(so_far), "w": F.count(F.when(F.col("result") == "win", 1)).over(so_far)})
    lost = told.where("result = 'loss'").select("bout_id", F.col("opponent").alias("fighter"), F.col("fighter").alias("opponent"), "n", "w")
    # lines told twice count twice, as in the SQL; their rows are in one task by now
    return lost.groupBy("bout_id", "fighter", "opponent").agg(F.sum("n").alias("opponent_bouts"), F.sum("w").alias("opponent_wins"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def unmatched_overrides(spark, sf_dir):
    """Registry rows that match nothing."""
    return quality.orphans(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), "c_custkey", "o_custkey")


@query("SELECT l_orderkey, least('P' || l_partkey, 'S' || l_suppkey) AS lo, greatest('P' || l_partkey, 'S' || l_suppkey) AS hi FROM lineitem GROUP BY ALL")
def unordered_pairs(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("P"), "l_partkey").alias("a"), F.concat(F.lit("S"), "l_suppkey").alias("b"))
    return dedupe.unordered_pairs(items, "a", "b", "l_orderkey")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR o.o_totalprice IS DISTINCT FROM n.o_totalprice""")
def key_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderdate < timestamp_ntz '2000-01-01'")
    new = orders.where("o_orderdate >= timestamp_ntz '1996-01-01'").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 50 == 0, "X").otherwise(F.col("o_orderstatus")))
    return dedupe.key_diff(old, new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("""WITH p AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer), f AS (SELECT c_custkey, c_acctbal * 2 AS c_acctbal, upper(c_mktsegment) AS c_mktsegment, c_acctbal < 0 AS bad FROM customer WHERE c_custkey % 10 <> 3)
SELECT p.c_custkey, CASE WHEN f.c_custkey IS NULL OR f.bad THEN p.c_acctbal ELSE f.c_acctbal END AS c_acctbal, CASE WHEN f.c_custkey IS NULL OR f.bad THEN p.c_mktsegment ELSE f.c_mktsegment END AS c_mktsegment, f.c_custkey IS NULL OR f.bad AS kept_previous FROM p LEFT JOIN f USING (c_custkey)""")
def keep_last_good(spark, sf_dir):
    old = table(spark, sf_dir, "customer")
    fresh = old.where("c_custkey % 10 <> 3").select("c_custkey", (F.col("c_acctbal") * 2).alias("c_acctbal"), F.upper("c_mktsegment").alias("c_mktsegment"), F.col("c_acctbal").alias("was"))
    return resolve.keep_last_good(old, fresh, "c_custkey", F.col("was") < 0, ["c_acctbal", "c_mktsegment"])


@query("""SELECT 'orders_without_customer' AS gate, count(*) AS violations, count(*) <= 0 AS passed FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'odd_priority', count(*), count(*) <= 0 FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z ]+$')
UNION ALL SELECT 'negative_balance', count(*), count(*) <= 10 FROM customer WHERE c_acctbal < 0""")
def quality_gates(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    gates = [
        quality.gate("orders_without_customer", quality.orphans(orders, customer, "o_custkey", "c_custkey")),
        quality.gate("odd_priority", quality.unaccepted(orders, "o_orderpriority", "^[1-5]-[A-Z ]+$")),
        quality.gate("negative_balance", customer.where("c_acctbal < 0"), 10),
    ]
    return gates[0].unionByName(gates[1]).unionByName(gates[2])


@query("SELECT 'missing_score' AS gate, round(avg(CASE WHEN l_tax > 0.075 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS ratio, avg(CASE WHEN l_tax > 0.075 THEN CAST(1 AS DOUBLE) ELSE 0 END) <= 0.2 AS passed FROM lineitem")
def null_ratio_gate(spark, sf_dir):
    return quality.ratio("missing_score", table(spark, sf_dir, "lineitem"), F.col("l_tax") > 0.075, 0.2)


@query("""WITH c AS (SELECT l_orderkey AS k, count(*) AS counted FROM lineitem GROUP BY 1), s AS (SELECT o_orderkey AS k, CAST(o_orderkey % 7 AS BIGINT) AS stated FROM orders)
SELECT coalesce(c.k, s.k) AS k, coalesce(stated, 0) AS stated, coalesce(counted, 0) AS counted FROM c FULL JOIN s ON c.k = s.k WHERE coalesce(stated, 0) <> coalesce(counted, 0)""")
def inconsistent_counts(spark, sf_dir):
    detail = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    stated = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 7).alias("stated"))
    return quality.inconsistent(detail, stated, "k", "stated").select("k", "stated", "counted")


@query("""WITH l AS (SELECT c_nationkey AS k, c_mktsegment AS v FROM customer), r AS (SELECT s_nationkey AS k, 'MACHINERY' AS v FROM supplier)
SELECT k, v, 'left' AS side FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT k, v, 'right' FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)""")
def mirror_difference(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("v"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("MACHINERY").alias("v"))
    return quality.differing(left, right)


@query("""WITH t AS (SELECT o_custkey AS k, count(*) AS theirs FROM orders GROUP BY 1), o AS (SELECT o_custkey AS k, count(*) AS ours FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT k, theirs, coalesce(ours, 0) AS ours, theirs - coalesce(ours, 0) AS missing FROM t LEFT JOIN o USING (k) WHERE theirs > coalesce(ours, 0)""")
def coverage_gap(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return quality.coverage(orders.where("o_orderstatus <> 'P'"), orders, "k")


@query(f"""{BOUTS_SQL}, d AS (SELECT CASE WHEN quantity = 13 THEN 'win' ELSE result END AS result, bout_id FROM sides)
SELECT bout_id, count(*) FILTER (WHERE result = 'win') AS wins, count(*) FILTER (WHERE result = 'loss') AS losses FROM d GROUP BY bout_id HAVING count(*) FILTER (WHERE result = 'win') > 1 OR count(*) FILTER (WHERE result = 'loss') > 1""")
def winner_contradictions(spark, sf_dir):
    s = two_sided(bouts(spark, sf_dir), "bout_id", "quantity")
    return quality.contradictions(s.withColumn("result", F.when(F.col("quantity") == 13, "win").otherwise(F.col("result"))))


@query("SELECT CAST(x.i AS BIGINT) AS missing_id FROM (SELECT unnest(range((SELECT min(l_orderkey) FROM lineitem), (SELECT max(l_orderkey) + 1 FROM lineitem))) AS i) x WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = x.i)")
def missing_ids(spark, sf_dir):
    """Numbers of a range that no row has: the range is generated where it is joined, not in one array."""
    items = table(spark, sf_dir, "lineitem")
    lo, hi = items.agg(F.min("l_orderkey"), F.max("l_orderkey")).first()
    return spark.range(lo, hi + 1).select(F.col("id").alias("missing_id")).join(items.select(F.col("l_orderkey").alias("missing_id")), "missing_id", "left_anti")
