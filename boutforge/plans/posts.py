"""Feed rows, posts and reports over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import classify, headlines
from ..operators import reports
from .registry import query
from .scalars import _TITLES, _pick, _pick_sql
from .testdata import table
from .texts import worked

worked("post_labels", [("甲がKO勝ち", "結果"), ("電撃参戦が決定", "速報"), ("コラム", None), ("秒殺で速報", "結果")], headlines.post_label)
worked("bare_titles", [("【速報】 甲「一言」", "甲"), ("甲『長い』乙", "甲乙"), (" 丙 ", "丙")], lambda t: headlines.without_quotes(headlines.without_label(t)))
worked(
    "summaries",
    [("【速報】甲が勝利", "甲が勝利"), ("甲が勝利した。" + "あ" * 60, "甲が勝利した"), ("甲が勝利、" + "い" * 60, "甲が勝利"), ("う" * 60, "う" * 54 + "…"), ("甲が勝利＝5月6日、会場", "甲が勝利"), ("a" * 100, "a" * 100)],
    headlines.summarised,
)
worked("places_of_names", [("井上直樹が勝利#直樹", 0), ("直樹が勝利#直樹", 1), ("ダイヤモンド#ダイヤ", 0), ("王者ダイヤが#ダイヤ", 3), ("abc ab#ab", 5), ("無関係#直樹", 0)], lambda t: headlines.place_of_name(F.element_at(F.split(t, "#"), 1), F.element_at(F.split(t, "#"), 2)))


@query("""SELECT CASE WHEN user_id % 5 = 0 THEN 'none' ELSE event_type END || '-' || event_id AS id, event_type || ' news' AS title, 'u/' || event_id AS url, CAST(CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE ts END AS VARCHAR) AS published
FROM events WHERE event_id % 4 > 0""")
def feed_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    items = e.select(
        F.when(F.col("user_id") % 5 == 0, "none").otherwise(F.col("event_type")).alias("source"),
        F.concat("event_type", F.lit(" news")).alias("title"),
        F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("u/"), "event_id")).alias("link"),
        F.when(F.col("event_id") % 3 == 0, F.lit("no date")).otherwise(F.col("ts").cast("string")).alias("date"),
        F.col("event_id").alias("ord"),
    )
    rows = reports.feed_rows(items, "origin", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return rows.select("id", "title", "url", F.col("published").cast("string").alias("published"))


@query(f"""WITH n AS (SELECT event_id, ts, {_pick_sql(_TITLES, "event_id")} AS t, {_pick_sql(["rizin", "blog", "deep"], "user_id")} AS source FROM events)
SELECT event_id, CASE WHEN source IN ('rizin', 'deep') THEN 'official' ELSE 'media' END AS kind, source IN ('rizin', 'deep') AND t IN ('計量結果', '出場予定選手が欠場', '一本勝ちで優勝', '対戦カード発表', '現役引退', '計量で欠場') AND CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-01-29 12:00:00' ELSE ts END > TIMESTAMP '2024-01-29 00:00:00' AS flash FROM n""")
def classified_feed(spark, sf_dir):
    n = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("published"), _pick(_TITLES, "event_id", 8).alias("title"), _pick(["rizin", "blog", "deep"], "user_id", 3).alias("source"))
    rows = n.withColumns({"first_seen": F.when(F.col("event_id") % 2 == 0, F.expr("TIMESTAMP_NTZ '2024-01-29 12:00:00'")), "override": F.lit(None).cast("string")})
    return reports.classified(rows, F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'")).select("event_id", "kind", "flash")


@query("SELECT event_id, 'official' AS source FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, 'media' FROM events WHERE event_type = 'click' AND event_id % 2 = 0")
def accepted_feeds(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("title", F.when(F.col("event_id") % 2 == 0, "RIZINの話題").otherwise("別の話題"))
    return reports.accepted({"official": e.where("event_type = 'view'"), "media": e.where("event_type = 'click'")}, {"media"}).select("event_id", "source")


@query("SELECT event_id, 'a' AS source FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, 'c' FROM events WHERE event_type = 'click'")
def tolerant_feeds(spark, sf_dir):
    """One of three sources can't be read."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    rows, failed = reports.tolerant_union({"a": e.where("event_type = 'view'"), "b": None, "c": e.where("event_type = 'click'")})
    if failed != ["b"]:
        raise ValueError(failed)
    return rows.select("event_id", "source")


@query("SELECT o_custkey, '・RIZIN ' || string_agg('o' || o_orderkey, chr(10) || '・RIZIN ' ORDER BY o_orderkey) || chr(10) || '#MMA #RIZIN' AS text FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 3 GROUP BY o_custkey")
def digest_posts(spark, sf_dir):
    """Three short topics fit; labels before them go."""
    o = table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("place <= 3")
    return reports.posts(o.select("o_custkey", F.concat(F.lit("【速報】RIZIN o"), "o_orderkey").alias("title"), F.lit("other").alias("source"), "place"), "o_custkey")


@query("SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def unposted_rows(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"))
    return reports.unposted(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), done, "key")


@query("SELECT CAST(1 AS INTEGER) AS n, '# Regions' AS line UNION ALL SELECT 2, '| r_regionkey | r_name |' UNION ALL SELECT 3, '| --- | --- |' UNION ALL SELECT CAST(row_number() OVER (ORDER BY r_name) + 3 AS INTEGER), '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region")
def markdown_report(spark, sf_dir):
    return reports.markdown(table(spark, sf_dir, "region"), "Regions", ["r_regionkey", "r_name"], ["r_name"])


@query("""WITH f AS (SELECT o_custkey, arg_min(struct_pack(k := o_orderkey, d := CAST(o_orderdate AS DATE), s := o_orderstatus), o_orderkey) AS x, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT 'E' || o_custkey AS event, 'E' || o_custkey || '（' || strftime(x.d, '%Y年%-m月%-d日') || '）' || CASE WHEN x.s = 'F' THEN 'メインイベントはAがKOでBに勝利。全' || n || '試合の結果を掲載。' ELSE '全' || n || '試合の結果を掲載。メインイベントはA vs B。' END AS line FROM f""")
def event_lines(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    rows = o.select(F.concat(F.lit("E"), "o_custkey").alias("event"), F.col("o_orderdate").cast("date").alias("day"), none.alias("venue"), F.col("o_orderkey").alias("place"), F.lit("A").alias("a"), F.lit("B").alias("b"), F.when(F.col("o_orderstatus") == "F", "A").otherwise("NC").alias("winner"), F.lit("KO").alias("method"))
    return reports.event_lines(rows)


@query("SELECT o_orderkey AS event FROM orders WHERE o_orderstatus IN ('O', 'P')")
def upcoming_events(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "upcoming").when(F.col("o_orderstatus") == "P", "live").otherwise("done")
    return reports.upcoming(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_orderdate").alias("date"), status.alias("status"))).select("event")


worked("non_pro_labels", [("キッズ大会", "non_mma_kids_shooto"), ("ネオブラッド・トーナメント アマ", None), ("アマチュア修斗", "not_pro_amateur"), ("第5試合", None)], classify.non_pro)
