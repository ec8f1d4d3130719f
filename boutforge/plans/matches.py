"""Linking names, events and cards, over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import linking
from .registry import query
from .testdata import BOUTS_SQL, bouts, sides, table, tasks_for

_PLAIN = "regexp_replace({}, '[\\s　・]', '', 'g')"


@query("""WITH roster AS (SELECT 'P' || p_partkey AS slug, p_name AS name, [p_brand || p_size] AS aliases, p_size = 50 AS hidden, p_partkey AS ord FROM part),
claims AS (SELECT slug, ord, hidden, replace(name, ' ', '') AS form, 0 AS pass FROM roster UNION ALL SELECT slug, ord, hidden, unnest(aliases), 1 FROM roster),
sole AS (SELECT form FROM claims GROUP BY form HAVING count(DISTINCT slug) = 1), known AS (SELECT * FROM claims WHERE NOT hidden AND form IN (SELECT form FROM sole)),
rows AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_brand || p_size ELSE p_type END AS name FROM part)
SELECT key, (SELECT arg_min(slug, (pass, ord)) FROM known WHERE known.form = replace(rows.name, ' ', '')) AS slug FROM rows""")
def names_or_aliases(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    alias = F.concat("p_brand", F.col("p_size").cast("string"))
    roster = part.select(F.concat(F.lit("P"), "p_partkey").alias("slug"), F.col("p_name").alias("name"), F.array(alias).alias("aliases"), (F.col("p_size") == 50).alias("hidden"), F.col("p_partkey").alias("ord"))
    wanted = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, alias).otherwise(F.col("p_type"))
    return linking.by_any_name(part.select(F.col("p_partkey").alias("key"), wanted.alias("name")), "key", "name", roster).select("key", "slug")


@query(f"""{BOUTS_SQL}, denied AS (SELECT fighter, date, lower(opponent) AS low FROM sides WHERE org = 'org2')
SELECT bout_id, fighter FROM sides s WHERE org = 'org1' AND NOT EXISTS (SELECT 1 FROM denied d WHERE d.fighter = s.fighter AND d.date = s.date AND d.low = lower(s.opponent))""")
def unsuppressed_links(spark, sf_dir):
    s = sides(spark, sf_dir)
    return linking.without_suppressed(s.where("org = 'org1'"), s.where("org = 'org2'").withColumn("opponent", F.lower("opponent"))).select("bout_id", "fighter")


@query("""WITH o AS (SELECT l_orderkey, least('P' || l_partkey, 'S' || l_suppkey) AS lo, greatest('P' || l_partkey, 'S' || l_suppkey) AS hi, 'special' AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
SELECT i.l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, coalesce(o.v, l_linestatus) AS rule_type FROM lineitem i LEFT JOIN o ON o.l_orderkey = i.l_orderkey AND o.lo = least('P' || l_partkey, 'S' || l_suppkey) AND o.hi = greatest('P' || l_partkey, 'S' || l_suppkey)""")
def rule_type_overrides(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.concat(F.lit("P"), "l_partkey").alias("a"), F.concat(F.lit("S"), "l_suppkey").alias("b"), F.col("l_linestatus").alias("rule_type"), "l_returnflag")
    special = items.where("l_returnflag = 'A'").select("l_orderkey", F.col("b").alias("a"), F.col("a").alias("b"), F.lit("special").alias("rule_type")).distinct()
    return linking.overridden_pairs(items, special, ["l_orderkey"], "a", "b", "rule_type").select("l_orderkey", "l_linenumber", "cents", "rule_type")


@query("""SELECT o_custkey, min(o_orderkey) AS first, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS statuses FROM orders GROUP BY o_custkey""")
def grouped_in_order(spark, sf_dir):
    found = linking.grouped_in_order(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", F.col("o_orderstatus"))
    return found.select("o_custkey", "first", F.array_join("values", "").alias("statuses"))


@query("""WITH b AS (SELECT o_orderkey, o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' AS own, CAST(o_custkey AS VARCHAR) AS identity, 'u' || (o_custkey % 7) || '/' || o_custkey AS url FROM orders),
r AS (SELECT CAST(c_custkey AS VARCHAR) AS identity, 'u' || (c_custkey % 7) || '/' || c_custkey AS url FROM customer WHERE c_custkey % 5 > 0)
SELECT o_orderkey, CASE WHEN own THEN (SELECT max(r.identity) FROM r WHERE r.identity = b.identity) ELSE (SELECT max(r.identity) FROM r WHERE r.url = b.url) END AS owner FROM b""")
def owners_of_bouts(spark, sf_dir):
    """Four in five customers are on the roster; the others' orders stay unmatched."""
    url = lambda c: F.concat(F.lit("u"), F.col(c) % 7, F.lit("/"), F.col(c))
    own = F.col("o_orderpriority").rlike("^[12]")
    b = table(spark, sf_dir, "orders").select("o_orderkey", F.when(own, "identity").otherwise("sourceUrl").alias("match_by"), F.col("o_custkey").cast("string").alias("identity"), url("o_custkey").alias("source_url"))
    roster = table(spark, sf_dir, "customer").where("c_custkey % 5 > 0").select(F.col("c_custkey").cast("string").alias("identity"), F.array(url("c_custkey")).alias("sources"))
    return linking.by_source_or_identity(b, roster.withColumnRenamed("identity", "identity")).select("o_orderkey", "owner")


@query("""WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS identity, CASE WHEN p_partkey % 4 = 0 THEN 's' || p_partkey END AS site_slug, p_type AS name, p_brand || ' gym' AS gym FROM part),
b AS (SELECT p_partkey AS bout_id, CASE WHEN p_partkey % 8 = 0 THEN 's' || p_partkey END AS site_slug, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_type || p_size END AS opponent, CASE WHEN p_partkey % 3 = 0 THEN 'フリー' ELSE p_brand END AS gym FROM part),
m AS (SELECT b.bout_id, b.gym <> 'フリー' AND (contains(lower(replace(r.gym, ' gym', '')), lower(b.gym)) OR contains(lower(b.gym), lower(replace(r.gym, ' gym', '')))) AS fits, r.identity FROM b JOIN r ON replace(b.opponent, ' ', '') = replace(r.name, ' ', '')),
f AS (SELECT bout_id, count(*) AS n, min(identity) AS first, count(*) FILTER (WHERE fits) AS fit, min(identity) FILTER (WHERE fits) AS fitting FROM m GROUP BY bout_id)
SELECT b.bout_id, coalesce(l.identity, CASE WHEN n = 1 THEN first WHEN fit = 1 THEN fitting END) AS resolved, l.identity IS NULL AND coalesce(n > 1 AND fit <> 1, false) AS ambiguous, CASE WHEN l.identity IS NULL AND n > 1 AND fit <> 1 THEN n ELSE 0 END AS candidates
FROM b LEFT JOIN r l ON b.site_slug = l.site_slug LEFT JOIN f ON b.bout_id = f.bout_id""")
def opponents_by_gym(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    slug = lambda n: F.when(key % n == 0, F.concat(F.lit("s"), key))
    roster = part.select(key.cast("string").alias("identity"), slug(4).alias("site_slug"), F.col("p_type").alias("name"), F.concat("p_brand", F.lit(" gym")).alias("gym"))
    b = part.select(key.alias("bout_id"), slug(8).alias("site_slug"), F.when(key % 2 == 0, F.col("p_type")).otherwise(F.concat("p_type", F.col("p_size").cast("string"))).alias("opponent"), F.when(key % 3 == 0, "フリー").otherwise(F.col("p_brand")).alias("gym"))
    return linking.opponents(b, roster).select("bout_id", "resolved", "ambiguous", F.col("n_candidates").alias("candidates"))


_EVENTS = """ev AS (SELECT DISTINCT 'e' || o_clerk_n || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS slug, 'CARD ' || o_clerk_n AS name, CAST(o_orderdate AS DATE) AS date FROM (SELECT *, o_custkey % 23 AS o_clerk_n FROM orders WHERE o_orderstatus = 'F'))"""


@query(f"""WITH {_EVENTS}, r AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'card' || (o_custkey % 23) ELSE 'MAIN CARD ' || (o_custkey % 23) || ' night' END AS event, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderstatus <> 'F'),
p AS (SELECT key, lower(replace(event, ' ', '')) AS target, date FROM r), e AS (SELECT slug, lower(replace(name, ' ', '')) AS name, date FROM ev),
m AS (SELECT key, slug, target = name AS exact FROM p JOIN e ON e.date BETWEEN p.date - 1 AND p.date + 1 WHERE target = name OR (contains(target, name) AND NOT regexp_matches(substr(target, instr(target, name) + length(name), 1), '^[0-9]$'))),
b AS (SELECT DISTINCT key, slug FROM (SELECT *, bool_or(exact) OVER (PARTITION BY key) AS any_exact FROM m) WHERE exact OR NOT any_exact)
SELECT r.key, (SELECT min(slug) FROM b WHERE b.key = r.key HAVING count(*) = 1) AS slug FROM r""")
def event_links(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("n", F.col("o_custkey") % 23).withColumn("date", F.col("o_orderdate").cast("date"))
    events = orders.where("o_orderstatus = 'F'").select(F.concat(F.lit("e"), "n", F.col("date").cast("string")).alias("slug"), F.concat(F.lit("CARD "), "n").alias("name"), "date").distinct()
    title = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("card"), "n")).otherwise(F.concat(F.lit("MAIN CARD "), "n", F.lit(" night")))
    return linking.event_links(orders.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("key"), title.alias("event"), "date"), events).select("key", "slug")


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderdate, o_custkey % 40 AS series FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_orderkey AS other, o_orderdate, o_custkey % 40 AS series FROM orders WHERE o_orderstatus = 'O'),
p1 AS (SELECT id, other FROM (SELECT *, row_number() OVER (PARTITION BY o_orderdate ORDER BY id) AS n FROM a) x JOIN (SELECT *, row_number() OVER (PARTITION BY o_orderdate ORDER BY other) AS n FROM b) y USING (o_orderdate, n)),
p2 AS (SELECT id, other FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY id) AS n FROM a WHERE id NOT IN (SELECT id FROM p1)) x JOIN (SELECT *, row_number() OVER (PARTITION BY series ORDER BY other) AS n FROM b WHERE other NOT IN (SELECT other FROM p1)) y USING (series, n))
SELECT * FROM p1 UNION ALL SELECT * FROM p2""")
def schedules_in_two_passes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 40).alias("series"), "o_orderstatus")
    a = orders.where("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "id")
    b = orders.where("o_orderstatus = 'O'").withColumnRenamed("o_orderkey", "other")
    return linking.two_pass_pairs(a, b, ["o_orderdate", "series"])


_CARDS = """mine AS (SELECT DISTINCT l_orderkey, least('P' || l_partkey, 'S' || l_suppkey) AS lo, greatest('P' || l_partkey, 'S' || l_suppkey) AS hi FROM lineitem), theirs AS (SELECT DISTINCT l_orderkey, least('P' || CASE WHEN l_linenumber % 3 = 0 THEN l_partkey + 1 ELSE l_partkey END, 'S' || l_suppkey) AS lo, greatest('P' || CASE WHEN l_linenumber % 3 = 0 THEN l_partkey + 1 ELSE l_partkey END, 'S' || l_suppkey) AS hi FROM lineitem WHERE l_linenumber <> 5)"""


@query(f"""WITH {_CARDS}, gone AS (SELECT l_orderkey, lo || '|' || hi AS old, lo, hi FROM mine EXCEPT SELECT l_orderkey, lo || '|' || hi, lo, hi FROM theirs), new AS (SELECT l_orderkey, lo || '|' || hi AS new, lo, hi FROM theirs EXCEPT SELECT l_orderkey, lo || '|' || hi, lo, hi FROM mine),
s AS (SELECT g.l_orderkey, old, min(new) AS new FROM gone g JOIN new n ON g.l_orderkey = n.l_orderkey AND (g.lo IN (n.lo, n.hi) OR g.hi IN (n.lo, n.hi)) GROUP BY ALL), f AS (SELECT l_orderkey, new, min(old) AS old FROM s GROUP BY ALL)
SELECT l_orderkey, old, new, 'changed' AS change FROM f UNION ALL SELECT l_orderkey, old, NULL, 'removed' FROM gone WHERE (l_orderkey, old) NOT IN (SELECT (l_orderkey, old) FROM f) UNION ALL SELECT l_orderkey, NULL, new, 'added' FROM new WHERE (l_orderkey, new) NOT IN (SELECT (l_orderkey, new) FROM f)""")
def card_changes(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    part = lambda c: F.concat(F.lit("P"), c)
    mine = items.select("l_orderkey", part(F.col("l_partkey")).alias("a"), F.concat(F.lit("S"), "l_suppkey").alias("b"))
    moved = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))
    theirs = items.where("l_linenumber <> 5").select("l_orderkey", part(moved).alias("a"), F.concat(F.lit("S"), "l_suppkey").alias("b"))
    return linking.card_changes(mine, theirs, ["l_orderkey"], tasks_for(items, 2)).select("l_orderkey", "old", "new", "change")


@query("""WITH c AS (SELECT o_custkey, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey) AS x, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderdate, o_orderkey) AS y FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT o_custkey FROM c WHERE x <> y""")
def reordered_cards(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").cast("string").alias("a"), F.lit("z").alias("b"), "o_orderkey", "o_orderdate")
    by = lambda *c: F.row_number().over(Window.partitionBy("o_custkey").orderBy(*c))
    return linking.order_changed(o.withColumn("place", by("o_orderkey")), o.withColumn("place", by("o_orderdate", "o_orderkey")), ["o_custkey"])


@query(f"""{BOUTS_SQL}, n AS (SELECT DISTINCT fighter, CASE WHEN quantity > 40 THEN NULL ELSE date END AS date, opponent FROM sides WHERE org = 'org0'), k AS (SELECT DISTINCT fighter, date, opponent FROM sides WHERE org IN ('org0', 'org1') AND quantity < 10),
l AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.fighter = n.fighter AND k.date = n.date AND k.opponent = n.opponent)),
x AS (SELECT fighter, date FROM n WHERE date IS NOT NULL GROUP BY ALL HAVING count(*) = 1), y AS (SELECT fighter, date FROM k GROUP BY ALL HAVING count(*) = 1)
SELECT fighter, date, opponent FROM l WHERE (date IS NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.fighter = l.fighter AND k.opponent = l.opponent)) OR (date IS NOT NULL AND NOT EXISTS (SELECT 1 FROM x JOIN y USING (fighter, date) WHERE x.fighter = l.fighter AND x.date = l.date))""", dates=("date",))
def new_against_official(spark, sf_dir):
    s = sides(spark, sf_dir)
    rows = s.where("org = 'org0'").select("fighter", F.when(F.col("quantity") <= 40, F.col("date")).alias("date"), "opponent").distinct()
    known = s.where("org in ('org0', 'org1') and quantity < 10").select("fighter", "date", "opponent").distinct()
    return linking.new_against(rows, known, ["fighter"]).select("fighter", "date", "opponent")


@query("""WITH a AS (SELECT 'u' || (user_id % 500) AS url, ts, event_id FROM events WHERE event_type = 'click')
SELECT e.event_id, CAST(CASE WHEN e.event_id % 4 = 0 THEN e.ts ELSE (SELECT arg_min(ts, event_id) FROM a WHERE a.url = 'u' || e.user_id) END AS VARCHAR) AS first_seen FROM events e WHERE event_type = 'view'""")
def first_seen_stamps(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    archive = events.where("event_type = 'click'").select(F.concat(F.lit("u"), F.col("user_id") % 500).alias("url"), F.col("ts").alias("first_seen"), F.col("event_id").alias("ord"))
    rows = events.where("event_type = 'view'").select("event_id", F.concat(F.lit("u"), "user_id").alias("url"), F.when(F.col("event_id") % 4 == 0, F.col("ts")).alias("first_seen"))
    return linking.first_seen(rows, archive).select("event_id", F.col("first_seen").cast("string").alias("first_seen"))


@query("""WITH r AS (SELECT c_nationkey AS division, c_custkey AS slug, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer), n AS (SELECT c_custkey AS slug, c_name AS name FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT division, slug, name, CAST(row_number() OVER (PARTITION BY division ORDER BY rank) AS INTEGER) AS shown_rank FROM r JOIN n USING (slug) QUALIFY row_number() OVER (PARTITION BY division ORDER BY rank) <= 15""")
def ranked_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    ranking = c.select(F.col("c_nationkey").alias("division"), F.col("c_custkey").alias("slug"), place.alias("rank"))
    roster = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("slug"), F.col("c_name").alias("name"))
    return linking.ranked_names(ranking, roster, "division", 15).select("division", "slug", "name", "shown_rank")


@query(f"{BOUTS_SQL} SELECT DISTINCT s.fighter AS key FROM sides s JOIN sides t ON s.fighter = t.fighter AND s.opponent = t.opponent AND s.org = 'org1' AND t.org = 'org1' AND s.date < DATE '1996-01-01' AND t.date >= DATE '1996-01-01'")
def shared_opponents(spark, sf_dir):
    s = sides(spark, sf_dir).where("org = 'org1'").withColumnRenamed("fighter", "key")
    return linking.shares_opponent(s.where("date < '1996-01-01'"), s.where("date >= '1996-01-01'"))


_RECORD = "SELECT fighter AS key, count(*) FILTER (WHERE result = 'win') AS wins, count(*) FILTER (WHERE result = 'loss') AS losses, count(*) FILTER (WHERE result = 'draw') AS draws FROM sides WHERE {} GROUP BY fighter"


@query(f"""{BOUTS_SQL}, ja AS ({_RECORD.format("org = 'org0' AND date < DATE '1994-01-01'")}), en AS ({_RECORD.format("org = 'org1'")}), g AS (SELECT DISTINCT fighter AS key, opponent FROM sides WHERE org = 'org1' AND quantity < 5),
ok AS (SELECT DISTINCT s.fighter AS key FROM sides s JOIN g ON g.key = s.fighter AND g.opponent = s.opponent WHERE org = 'org1'), f AS (SELECT DISTINCT fighter AS key FROM sides)
SELECT key, coalesce(j.wins, e.wins, 0) AS wins, coalesce(j.losses, e.losses, 0) AS losses, coalesce(j.draws, e.draws, 0) AS draws, CASE WHEN j.key IS NOT NULL THEN 'ja' WHEN e.key IS NOT NULL THEN 'en' END AS source, j.key IS NULL AND e.key IS NULL AS no_record
FROM f LEFT JOIN (SELECT * FROM ja WHERE wins + losses + draws > 0) j USING (key) LEFT JOIN (SELECT * FROM en WHERE wins + losses + draws > 0 AND key IN (SELECT key FROM ok)) e USING (key)""")
def preferred_records(spark, sf_dir):
    s = sides(spark, sf_dir).withColumnRenamed("fighter", "key")
    n = lambda r: F.count(F.when(F.col("result") == r, 1))
    record = lambda rows, *more: rows.groupBy("key").agg(n("win").alias("wins"), n("loss").alias("losses"), n("draw").alias("draws"), *more)
    ja = record(s.where("org = 'org0' and date < '1994-01-01'"))
    en = record(s.where("org = 'org1'"), F.collect_set("opponent").alias("opponents"))
    return linking.preferred_record(s.select("key").distinct(), [("ja", ja), ("en", en)], s.where("org = 'org1' and quantity < 5").select("key", "opponent"))


@query("""WITH e AS (SELECT CAST(o_orderdate AS DATE) AS date, 'C' || o_custkey AS a, 'S' || l_suppkey AS b, CASE l_returnflag WHEN 'A' THEN 'C' || o_custkey WHEN 'R' THEN 'S' || l_suppkey ELSE CASE WHEN l_linenumber = 1 THEN 'NC' WHEN l_linenumber = 2 THEN '引き分け' WHEN l_linenumber = 3 THEN '中止' END END AS winner, l_linestatus AS method FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
h AS (SELECT * FROM e WHERE winner IS NOT NULL AND winner <> '中止'), s AS (SELECT a AS name, b AS opponent, winner, date FROM h UNION ALL SELECT b, a, winner, date FROM h)
SELECT name, count(*) AS bouts, count(*) FILTER (WHERE winner = name) AS wins, count(*) FILTER (WHERE winner = 'NC') AS ncs, count(*) FILTER (WHERE winner = '引き分け') AS draws, max(date) AS latest FROM s GROUP BY name""", dates=("latest",))
def histories_from_results(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    a, b, line = F.concat(F.lit("C"), "o_custkey"), F.concat(F.lit("S"), "l_suppkey"), F.col("l_linenumber")
    winner = F.when(F.col("l_returnflag") == "A", a).when(F.col("l_returnflag") == "R", b).when(line == 1, "NC").when(line == 2, "引き分け").when(line == 3, "中止")
    events = items.select(F.col("o_orderdate").cast("date").alias("date"), a.alias("a"), b.alias("b"), winner.alias("winner"), F.col("l_linestatus").alias("method"))
    n = lambda r: F.count(F.when(F.col("result") == r, 1))
    return linking.history_of(events).groupBy("name").agg(F.count("*").alias("bouts"), n("win").alias("wins"), n("nc").alias("ncs"), n("draw").alias("draws"), F.max("date").alias("latest"))


@query("SELECT p_partkey AS slug, list_aggregate(list_sort(list_distinct([replace(p_name, ' ', ''), replace(p_type, ' ', '')])), 'string_agg', '/') AS forms FROM part")
def known_names(spark, sf_dir):
    roster = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("name"), F.array("p_type").alias("aliases"))
    return linking.known_names(roster).select("slug", F.array_join("forms", "/").alias("forms"))


@query(f"""{BOUTS_SQL}, c AS (SELECT bout_id AS key, opponent AS slug, date, fighter || 'x' AS name FROM sides WHERE org = 'org3' AND quantity < 20) SELECT DISTINCT key FROM c JOIN sides b ON c.slug = b.fighter AND c.date = b.date AND (contains(lower(c.name), lower(b.opponent)) OR contains(lower(b.opponent), lower(c.name)))""")
def confirmed_candidates(spark, sf_dir):
    s = sides(spark, sf_dir)
    wanted = s.where("org = 'org3' and quantity < 20").select(F.col("bout_id").alias("key"), F.col("opponent").alias("slug"), "date", F.concat("fighter", F.lit("x")).alias("name"))
    return linking.confirmed_by_opponent(wanted, s.select(F.col("fighter").alias("slug"), "date", "opponent"))


@query(f"""{BOUTS_SQL}, p AS (SELECT DISTINCT a AS fighter, date, b AS opponent FROM bouts WHERE org = 'org1'), f AS (SELECT DISTINCT a AS fighter, CASE WHEN quantity > 45 THEN date + 3 ELSE date END AS date, b AS opponent FROM bouts WHERE org = 'org1' AND quantity > 10), r AS (SELECT DISTINCT a AS fighter FROM bouts WHERE quantity > 25),
g AS (SELECT * FROM p EXCEPT SELECT * FROM f)
SELECT g.fighter, g.date, g.opponent, CASE WHEN g.fighter NOT IN (SELECT fighter FROM r) THEN 'off_roster' WHEN EXISTS (SELECT 1 FROM f WHERE f.fighter = g.fighter AND f.opponent = g.opponent AND abs(datediff('day', f.date, g.date)) <= 5) THEN 'moved' ELSE 'open' END AS kind FROM g""", dates=("date",))
def removed_rows(spark, sf_dir):
    b = bouts(spark, sf_dir).withColumnsRenamed({"a": "fighter", "b": "opponent"})
    one = b.where("org = 'org1'")
    moved = F.when(F.col("quantity") > 45, F.date_add("date", 3)).otherwise(F.col("date"))
    fresh = one.where("quantity > 10").select("fighter", moved.alias("date"), "opponent").distinct()
    return linking.removed_kinds(one.select("fighter", "date", "opponent").distinct(), fresh, b.where("quantity > 25").select("fighter")).select("fighter", "date", "opponent", "kind")


@query("""SELECT doc_id, CASE WHEN contains(text, 'password') THEN 'password' WHEN contains(text, 'token') THEN 'token' ELSE '@' END AS suspect FROM documents WHERE lang <> 'en' AND (contains(text, 'password') OR contains(text, 'token') OR contains(text, '@'))""")
def suspect_additions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return linking.suspects(docs.where("lang = 'en'"), docs, ["doc_id"], F.col("text"), ["password", "token", "@"]).select("doc_id", "suspect")


@query("""WITH t AS (SELECT DISTINCT replace(p_name, ' ', '') AS title FROM part WHERE p_size < 25 UNION SELECT p_type FROM part WHERE p_size > 45), p AS (SELECT p_partkey AS key, 0 AS n, 'name' AS how, p_name AS title FROM part UNION ALL SELECT p_partkey, 1, 'squeezed', replace(p_name, ' ', '') FROM part UNION ALL SELECT p_partkey, 2, 'alias', p_type FROM part)
SELECT key, arg_min(how, n) AS how, arg_min(title, n) AS title FROM p WHERE title IN (SELECT title FROM t) GROUP BY key""")
def existing_titles(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    titles = part.where("p_size < 25").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("title")).union(part.where("p_size > 45").select("p_type"))
    return linking.alternates(titles, part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.array("p_type").alias("aliases"))).select("key", "how", "title")


@query("""SELECT 'O' || o_orderkey AS fighter, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, o_orderpriority AS event, NULL AS opponent FROM orders UNION ALL SELECT 'E' || event_id, NULL, event_type, CAST(user_id AS VARCHAR) FROM events WHERE trim(event_type) <> ''""")
def flattened_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("fighter"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("event"))
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("E"), "event_id").alias("fighter"), F.col("event_type").alias("event"), F.col("user_id").alias("opponent"))
    return linking.flattened([o, e], ["fighter", "date", "event", "opponent"])
