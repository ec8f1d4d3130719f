"""Record pages, boxes and lists that Spark writes of all customers, orders and suppliers, read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import pages
from .registry import query
from .testdata import dealt, table


def _page(rows: DataFrame, key: str, order: list[str], line: Column, head: str, foot: str) -> DataFrame:
    """One text for each key: a line for each of its rows, in order, between a head and a foot."""
    parts = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("p"))  # the rows of one key
    return parts.select(F.col(key).alias("page"), F.concat(F.lit(head), F.array_join(F.transform("p", lambda x: x["line"]), ""), F.lit(foot)).alias("text"))


def _put(form: str, *columns) -> Column:
    return F.format_string(form, *(F.col(c) if isinstance(c, str) else c for c in columns))


def _day() -> list[Column]:
    return [F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")]


@query("""SELECT o_custkey AS page, CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' END AS result, 'O. ' || o_orderkey AS opponent, 'KO (' || o_orderpriority || ')' AS method, 'Show ' || o_orderkey AS event,
CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, 'R' || (1 + o_orderkey % 3) AS round FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def english_record_pages(spark, sf_dir):
    """A record table for each customer: a row for each order, those of another status cancelled; a table after its end is none."""
    result = F.when(F.col("o_orderstatus") == "F", "{{yes2}}Win").when(F.col("o_orderstatus") == "O", "{{no2}}Loss").otherwise("Cancelled")
    line = _put("|-\n| %s\n| align=center|1–0\n| [[Order %d|O. %d]]\n| KO (%s)<ref>source %d</ref>\n| ''[[Show %d]]''\n| {{dts|%d|%d|%d}}\n| align=center|%d\n", result, "o_orderkey", "o_orderkey", "o_orderpriority", "o_orderkey", "o_orderkey", *_day(), 1 + F.col("o_orderkey") % 3)
    made = _page(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], line, "Intro\n{{MMA record start}}\n", "|-\n| Win\n| short\n{{MMA record end}}\n|-\n| Win\n| x\n| Late\n| x\n| y\n| {{dts|2018|1|2}}\n")
    return pages.record_table(made, "text").drop("place")


@query("""SELECT o_custkey AS page, CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' ELSE 'nc' END AS result, '選手' || o_orderkey AS opponent, CASE WHEN o_orderstatus = 'P' THEN 'ノーコンテスト' ELSE (1 + o_orderkey % 3) || 'R 2:03 ' || o_orderpriority END AS method,
'大会' || o_orderkey AS event, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, CASE WHEN o_orderstatus = 'P' THEN '—' ELSE 'R' || (1 + o_orderkey % 3) END AS round FROM orders""")
def japanese_record_pages(spark, sf_dir):
    """Nested templates and links, an amateur section and a kick section that don't count."""
    o = dealt(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate"), "o_custkey")
    mark = F.when(F.col("o_orderstatus") == "F", "○").when(F.col("o_orderstatus") == "O", "×").otherwise("－")
    method = F.when(F.col("o_orderstatus") == "P", "ノーコンテスト").otherwise(_put("%dR 2:03 {{small|%s}}", 1 + F.col("o_orderkey") % 3, "o_orderpriority"))
    line = _put("{{Fight-cont|%s|[[項目%d|選手%d]]<ref>{{cite|x}}</ref>|%s|[[大会%d]]|%d年%d月 %d日}}\n", mark, "o_orderkey", "o_orderkey", method, "o_orderkey", *_day())
    foot = "{{Fight-end}}\n=== アマチュア総合格闘技 ===\n{{Fight-start}}\n{{Fight-cont|○|戊|KO|大会E|2018年3月5日}}\n{{Fight-end}}\n=== キックボクシング ===\n{{Fight-cont|○|己|KO|大会F|2018年3月6日}}\n"
    made = _page(o, "o_custkey", ["o_orderkey"], line, "== 経歴 ==\ntext\n== 戦績 ==\n=== 総合格闘技 ===\n{{Fight-start}}\n", foot)
    return pages.fight_rows(made, "text").drop("place")


@query("""SELECT c_custkey AS page, 'Nick ' || c_custkey AS nickname, 'City ' || c_nationkey || ', Japan' AS birth_place,
CAST(2024 - (1970 + c_custkey % 30) - CASE WHEN make_date(CAST(2024 AS INT), CAST(1 + c_custkey % 12 AS INT), CAST(1 + c_custkey % 28 AS INT)) > DATE '2024-06-14' THEN 1 ELSE 0 END AS INTEGER) AS age, CAST(c_custkey % 40 AS INTEGER) AS wins, CAST(c_custkey % 7 AS INTEGER) AS losses, CAST(0 AS INTEGER) AS draws, CAST(c_custkey % 5 AS INTEGER) AS ko FROM customer""")
def customer_boxes(spark, sf_dir):
    """An infobox for each customer: former names, links, dates in templates, totals under several names."""
    k = F.col("c_custkey")
    kind = lambda a, b: F.when(k % 2 == 0, a).otherwise(b)
    text = _put("{{Infobox\n| other_names = Old %d (former), Nick %d\n| birth_place = [[Town|City %d]], Japan\n| birth_date = {{birth date and age|%s%d|%d|%d}}\n| %s = %d\n| %s = %d\n| KO = %d\n}}", k, k, "c_nationkey", kind("df=yes|", ""), 1970 + k % 30, 1 + k % 12, 1 + k % 28, kind("wins", "win"), k % 40, kind("losses", "loss"), k % 7, k % 5)
    rows = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").select(k.alias("page"), text.alias("text"))
    return rows.select("page", pages.infobox(F.col("text"), F.lit("2024-06-14").cast("date")).alias("b"), pages.stated_totals(F.col("text")).alias("t")).select("page", "b.nickname", "b.birth_place", "b.age", "t.wins", "t.losses", "t.draws", "t.ko")


_LINES = """l AS (SELECT l_orderkey, 'P' || l_partkey AS a, 'S' || l_suppkey AS b, l_returnflag AS f, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey ORDER BY l_linenumber, l_extendedprice) AS k FROM lineitem)"""


@query(f"""WITH {_LINES} SELECT l_orderkey AS page, CASE f WHEN 'A' THEN '○' WHEN 'R' THEN '×' ELSE '△' END AS mark_a, a, CASE f WHEN 'A' THEN '×' WHEN 'R' THEN '○' ELSE '△' END AS mark_b, b, CASE WHEN f = 'N' THEN '' ELSE n || 'R KO' END AS method FROM l WHERE k = 1""")
def order_bout_lists(spark, sf_dir):
    """Running text with a bout to a line for each line item, a garbled line and a repeat of each order's first pair the other way round."""
    items = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    a, b = (F.when(flag == "A", x).when(flag == "R", y).otherwise("△") for x, y in (("○", "×"), ("×", "○")))
    line = F.concat(_put("%s P%d%s%sS%d", a, "l_partkey", F.when(F.col("l_partkey") % 2 == 0, " vs ").otherwise("　対　"), b, "l_suppkey"), F.when(flag == "N", "").otherwise(_put("（%dR KO）", "l_linenumber")), F.lit("\n"))
    made = _page(items, "l_orderkey", ["l_linenumber", "l_extendedprice"], line, "大会結果\n", "○" + "長" * 31 + " vs × 戊\n以上")
    return pages.listed_bouts(made, "text").select("page", "mark_a", "a", "mark_b", "b", "method")


_SUPPLIERS = """s AS (SELECT s_suppkey, s_nationkey, s_suppkey % 2 AS women, CASE s_suppkey % 3 WHEN 0 THEN 'フライ級' WHEN 1 THEN 'バンタム級' ELSE 'アトム級' END AS base FROM supplier),
b AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey, base, women ORDER BY s_suppkey) AS r, dense_rank() OVER (PARTITION BY s_nationkey, base ORDER BY women) AS list FROM s)"""


@query(f"""WITH {_SUPPLIERS} SELECT s_nationkey AS page, CASE WHEN list > 1 OR base = 'アトム級' THEN '女子' || base ELSE base END AS class, CASE WHEN r = 1 THEN '王者' ELSE CAST(r - 1 AS VARCHAR) END AS rank, '選手&' || s_suppkey AS name FROM b""")
def nation_rankings(spark, sf_dir):
    """A ranking page for each nation's suppliers: a list for each class and sex, the champion in a cell of another kind."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").withColumns({"women": k % 2, "base": F.when(k % 3 == 0, "フライ級").when(k % 3 == 1, "バンタム級").otherwise("アトム級")})
    lists = rows.groupBy("s_nationkey", "women", "base").agg(F.array_sort(F.collect_list("s_suppkey")).alias("keys"))  # of one nation, class and sex
    cell = lambda x, i: F.concat(F.when(i == 0, '<tr><td class="rankingnokop"><b>王者</b></td>').otherwise(F.concat(F.lit('<tr><td class="rankingno"> '), i.cast("string"), F.lit(" </td>"))), F.lit('<td><a href="x">選手&amp;'), x.cast("string"), F.lit("</a></td></tr>"))
    block = F.concat(F.lit("<h4>"), "base", F.lit("</h4><table>"), F.array_join(F.transform("keys", cell), "\n"), F.lit("</table>"))
    made = _page(lists, "s_nationkey", ["women", "base"], block, "<h3>順位</h3>", "<h4>他</h4>")
    return pages.ranking_page(made, "text").select("page", "class", "rank", "name")


@query("""SELECT o_custkey AS page, '/news/' || o_orderkey || '/' AS url, '【RIZIN】選手' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN 'が勝利を語った' ELSE 'が出るとのこと' END AS title, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' 10:00' AS published FROM orders WHERE o_orderstatus <> 'P'""")
def order_cards(spark, sf_dir):
    """Linked headlines for each order, those of one status about something else; prefix and wording are evened out."""
    k = F.col("o_orderkey")
    title = F.when(F.col("o_orderstatus") == "P", _put("別の話題%d", k)).when(k % 2 == 0, _put("【RIZIN】<b>選手%d</b>が勝利を明かした", k)).otherwise(_put("選手%dが　RIZINに出るという。", k))
    even = F.regexp_replace(title, "が　RIZINに", "が")
    told = F.when((k % 2 == 1) & (F.col("o_orderstatus") != "P"), F.concat(F.lit("【RIZIN】 "), even)).otherwise(title)
    line = _put('<a href="/news/%d/"><div class="inner"><h2 class="title">%s</h2><time class="date" datetime="%s 10:00"></time></a>\n', k, told, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return pages.card_page(_page(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], line, "<ul>", "</ul>"), "text", ["RIZIN"], "【RIZIN】").select("page", "url", "title", "published")
