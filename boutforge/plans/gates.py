"""Gates, set operations and further windows over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, names
from ..operators import bouts as bout_ops
from ..operators import dedupe, linking, quality, windows
from ..sources import pages
from .registry import query
from .testdata import table
from .texts import fields, worked

worked("flash_prefixes", [("result", "【速報】"), ("article", ""), ("weigh_in", "【速報】")], classify.flash_prefix)
worked("stated_records", [("20戦 15勝(8KO) 4敗 1分", "20|15|4|1"), ("3戦3勝0敗", "3|3|0|0"), ("なし", None)], lambda t: F.when(classify.stated_record(t).isNotNull(), fields(classify.stated_record(t), "total", "wins", "losses", "draws")))
worked("kick_keys", [("髙橋“王”ニコ", "高橋王二コ"), ("Ａ・Ｂ c", "abc"), ("齋 藤", "斉藤"), ("カエト", "力工卜")], names.kick_key)
worked("gym_keys", [("東京キックボクシングジム", "東京"), ("ジム", None), ("Team A-B", "ab")], names.gym_key)
worked("kana_readings", [("たろう", "タロウ"), ("ヤマダ・タロー", "ヤマダタロ"), ("山田", None), ("", None)], names.reading_of_kana)
worked("english_results", [("{{yes2}}Win", "win"), ("Loss", "loss"), ("Draw", "draw"), ("NC", "nc"), ("Cancelled", None), ("?", None)], pages.result_in_english)
worked("japanese_results", [("○#判定", "win"), ("✕#KO", "loss"), ("△#判定", "draw"), ("－#無効試合", "nc"), ("－#試合中止", None), ("#未定", None)], lambda t: pages.result_in_japanese(F.element_at(F.split(t, "#"), 1), F.element_at(F.split(t, "#"), 2)))
worked("english_methods", [("Submission (armbar)", "sub"), ("TKO (punches)", "ko"), ("Decision (split)", "decision"), ("DQ", "other")], classify.method_en)


@query("""WITH r AS (SELECT DISTINCT o_custkey, o_orderdate, 'o_orderstatus' AS field, 'F' AS value FROM orders WHERE o_orderkey % 3 = 0)
SELECT r.o_custkey, CAST(r.o_orderdate AS DATE) AS day, o.o_orderstatus AS now FROM r LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 10 > 0) o ON o.o_custkey = r.o_custkey AND o.o_orderdate = r.o_orderdate WHERE o.o_orderstatus IS DISTINCT FROM 'F'""", dates=("day",))
def manual_edit_drift(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    registry = o.where("o_orderkey % 3 = 0").select("o_custkey", "o_orderdate", F.lit("o_orderstatus").alias("field"), F.lit("F").alias("value")).distinct()
    rows = o.where("o_orderkey % 10 > 0").select("o_custkey", "o_orderdate", "o_orderstatus")
    return quality.drifted(registry, rows, ["o_custkey", "o_orderdate"]).select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), "now")


@query("SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END IS DISTINCT FROM CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END")
def stale_resolutions(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 7 != 0, F.col("o_custkey")).alias("stored"), F.when(key % 5 != 0, F.col("o_custkey")).alias("fresh"))
    return quality.stale(rows, "stored", "fresh").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_partkey % 2 = 0 AND p_size < 25")
def variant_names(spark, sf_dir):
    """Even parts are written with a variant character; small ones are known under the usual one."""
    part = table(spark, sf_dir, "part")
    name = lambda c: F.concat(F.lit(c), "p_partkey")
    rows = part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, name("髙")).otherwise(name("高")).alias("name"))
    return quality.unresolved_variants(rows, part.where("p_size < 25").select(name("高").alias("k")), "name", {"髙": "高"}).select("p_partkey")


@query("SELECT 'orders' AS gate, count(*) AS rows, count(*) BETWEEN 100 AND 1000000 AS passed FROM orders UNION ALL SELECT 'regions', count(*), count(*) BETWEEN 100 AND 1000 FROM region")
def scrape_volumes(spark, sf_dir):
    return quality.volume("orders", table(spark, sf_dir, "orders"), 100, 1_000_000).unionByName(quality.volume("regions", table(spark, sf_dir, "region"), 100, 1000))


@query("""WITH j AS (SELECT event_type AS name, CASE WHEN user_id % 2 = 0 THEN 'running' ELSE 'done' END AS state, ts AS started FROM events)
SELECT n AS job, r AS running, k > 0 AND r = 0 AS may_run FROM (SELECT 'click' AS n, count(*) AS k, count(*) FILTER (WHERE name = 'click' AND state = 'running' AND epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(started)) < 3600) AS r FROM j UNION ALL SELECT 'other', count(*), 0 FROM j) UNION ALL SELECT 'view', 0, false UNION ALL SELECT 'none', 0, false""")
def run_guards(spark, sf_dir):
    """A job with runs, one without, one while frozen, and one of which nothing is known."""
    e = table(spark, sf_dir, "events")
    jobs = e.select(F.col("event_type").alias("name"), F.when(F.col("user_id") % 2 == 0, "running").otherwise("done").alias("state"), F.col("ts").alias("started"))
    now = F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    guard = lambda rows, name, frozen=False: quality.may_run(rows, name, now, frozen=frozen)
    return guard(jobs, "click").unionByName(guard(jobs, "other")).unionByName(guard(jobs.where("name = 'click' and state = 'done'"), "view", True)).unionByName(guard(jobs.limit(0), "none"))


@query("SELECT 'cust' AS source, c_custkey AS key, c_nationkey AS nation, CAST(NULL AS VARCHAR) AS comment FROM customer UNION ALL SELECT 'supp', s_suppkey, s_nationkey, NULL FROM supplier")
def united_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    return dedupe.united({"cust": c, "supp": s}, ["key", "nation"]).withColumn("comment", F.lit(None).cast("string"))


@query("SELECT c_nationkey AS nation, 'either' AS kind FROM customer UNION SELECT s_nationkey, 'either' FROM supplier UNION ALL (SELECT c_nationkey, 'both' FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier)")
def nations_of_sources(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    return dedupe.keys_of_either(c, s, "nation").withColumn("kind", F.lit("either")).unionByName(dedupe.keys_of_both(c, s, "nation").withColumn("kind", F.lit("both")))


@query("SELECT l_partkey, l_suppkey, max(l_orderkey) AS article FROM lineitem GROUP BY ALL")
def cross_article_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("article"))
    return dedupe.latest_article(rows, ["l_partkey", "l_suppkey"], "article")


@query("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 30 OFFSET (SELECT ((count(*) - 1) // 30) * 30 FROM part)")
def last_page(spark, sf_dir):
    """Page 999 is the last one there is."""
    return windows.ranged_page(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", [], 1_000_000_000, 30)


@query("SELECT * FROM (VALUES ('b', CAST(1 AS INTEGER)), ('a', 2), ('c', 3), ('d', 4)) t(key, place)")
def readings_in_order(spark, sf_dir):
    rows = spark.createDataFrame([("a", "かとう", "加藤"), ("b", "あべ", "安部"), ("c", None, "阿部"), ("d", None, "和田")], "key string, kana string, name string")
    return windows.by_reading(rows, "kana", "name").select("key", "place")


@query("SELECT p_brand, quantile_cont(p_size, 0.25) AS low, quantile_cont(p_size, 0.5) AS middle, quantile_cont(p_size, 0.75) AS high FROM part GROUP BY p_brand")
def size_quartiles(spark, sf_dir):
    cuts = windows.quantiles(table(spark, sf_dir, "part"), "p_size", "p_brand")
    return cuts.select("p_brand", F.col("cuts")[0].alias("low"), F.col("cuts")[1].alias("middle"), F.col("cuts")[2].alias("high"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) RANGE BETWEEN 90 PRECEDING AND CURRENT ROW) AS n FROM orders")
def orders_in_90_days(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).alias("day"))
    return windows.within_range(o, "o_custkey", "day", 90).select("o_orderkey", "n")


@query("""WITH b AS (SELECT 'C' || o_custkey AS a, 'S' || l_suppkey AS b, 'c' || o_custkey AS na, 's' || l_suppkey AS nb, CASE WHEN l_returnflag = 'A' THEN 'c' || o_custkey WHEN l_linenumber = 5 THEN '?' ELSE 's' || l_suppkey END AS w, CASE WHEN l_linenumber = 6 THEN 'draw' WHEN l_linenumber = 7 THEN 'nc' ELSE 'decisive' END AS t, CASE WHEN l_quantity > 45 THEN 'グラップリング' ELSE 'MMA' END AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT a AS fighter, w = na AS won, w IN (na, nb) AS known, t, r FROM b UNION ALL SELECT b, w = nb, w IN (na, nb), t, r FROM b)
SELECT fighter, count(*) FILTER (WHERE r = 'MMA' AND t = 'decisive' AND known AND won) AS wins, count(*) FILTER (WHERE r = 'MMA' AND t = 'decisive' AND known AND NOT won) AS losses, count(*) FILTER (WHERE r = 'MMA' AND t = 'draw') AS draws, count(*) FILTER (WHERE r = 'MMA' AND t = 'nc') AS no_contests, count(*) FILTER (WHERE r <> 'MMA') AS excluded FROM s GROUP BY fighter""")
def records_by_winner_name(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    name_a, name_b, line = F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("s"), "l_suppkey"), F.col("l_linenumber")
    b = rows.select(
        F.concat(F.lit("C"), "o_custkey").alias("a"), F.concat(F.lit("S"), "l_suppkey").alias("b"), name_a.alias("name_a"), name_b.alias("name_b"),
        F.when(F.col("l_returnflag") == "A", name_a).when(line == 5, "?").otherwise(name_b).alias("winner_name"),
        F.when(line == 6, "draw").when(line == 7, "nc").otherwise("decisive").alias("result_type"), F.when(F.col("l_quantity") > 45, "グラップリング").otherwise("MMA").alias("rules"),
    )
    return bout_ops.records_by_winner_name(b)


@query("""WITH r AS (SELECT p_partkey AS slug, lower(replace(p_name, ' ', '')) AS k, lower(p_brand || p_size) AS al FROM part), pl AS (SELECT k, min(slug) AS slug FROM r GROUP BY k HAVING count(DISTINCT slug) = 1), al AS (SELECT al AS k, min(slug) AS slug FROM r GROUP BY 1 HAVING count(DISTINCT slug) = 1)
SELECT p.p_partkey, coalesce(CASE WHEN p_partkey % 50 = 0 THEN -1 END, al.slug, pl.slug, 0) AS slug FROM part p LEFT JOIN al ON al.k = CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand || p_size) END LEFT JOIN pl ON pl.k = CASE WHEN p_partkey % 3 > 0 THEN lower(replace(p_name, ' ', '')) END""")
def fuzzy_opponents(spark, sf_dir):
    """Aliases, names with a nickname in quotes and plain names; some are verified by hand."""
    part = table(spark, sf_dir, "part")
    alias = F.concat("p_brand", F.col("p_size").cast("string"))
    n = F.col("p_partkey") % 3
    rows = part.select("p_partkey", F.when(n == 0, F.upper(alias)).when(n == 1, F.concat(F.lit("“x”"), "p_name")).otherwise(F.col("p_name")).alias("opponent"))
    roster = part.select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("name"), F.array(alias).alias("aliases"))
    verified = part.where("p_partkey % 50 = 0").select("p_partkey", F.lit(-1).cast("long").alias("slug"))
    return linking.fuzzy(rows, "p_partkey", "opponent", roster, verified).select("p_partkey", F.coalesce("slug", F.lit(0)).alias("slug"))


@query("SELECT c_custkey, n_regionkey FROM customer JOIN nation ON n_nationkey = CASE WHEN c_nationkey = 3 THEN 7 ELSE c_nationkey END")
def venue_aliases(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("place"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("name"), "n_regionkey")
    return linking.by_alias(c, "place", {"3": "7"}, n, "name").select("c_custkey", "n_regionkey")
