"""Pages cut into blocks, and result pages that Spark makes of all line items, read back."""

from __future__ import annotations

import re

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..sources import sections
from .registry import query
from .testdata import table

_TAGS = sections.BLOCK_TAGS.replace(" ", "|")
_DECODED = "replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')"


@query(rf"""WITH b AS (SELECT page_id, string_split(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'), '(?is)<(/?)({_TAGS})(\s[^>]*)?>', chr(1) || '\1\2' || chr(2), 'g'), chr(1)) AS parts FROM pages),
r AS (SELECT page_id, unnest(range(1, len(parts) + 1)) AS k, unnest(parts) AS part FROM b),
t AS (SELECT page_id, k, string_split(part, chr(2))[1] AS tag, regexp_replace(regexp_replace(string_split(part, chr(2))[2], '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM r WHERE contains(part, chr(2))),
c AS (SELECT page_id, k, tag, trim(regexp_replace({_DECODED}, '[ \t\r\n\f]+', ' ', 'g')) AS text FROM t)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS BIGINT) AS place, tag, text, last_value(CASE WHEN tag ~ 'h[1-6]' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading
FROM c WHERE text <> '' AND regexp_full_match(tag, 'h[1-6]|p|li')""")
def page_blocks(spark, sf_dir):
    """Headings, paragraphs and list items of all pages, each with the heading above it."""
    rows = sections.blocks(table(spark, sf_dir, "pages"), "page_id", "html").where("opens and tag rlike '^(h[1-6]|p|li)$'")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("n")).cast("long")
    return rows.select("page_id", place.alias("place"), "tag", F.regexp_replace("text", "\\n", " ").alias("text"), F.try_element_at("headings", F.lit(-1)).alias("heading"))


def _lines(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return items.withColumns({"k": F.row_number().over(w), "late": F.count(F.when(F.col("l_linenumber") > 0, 1)).over(Window.partitionBy("l_orderkey")) - 4})


LINES_SQL = """l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) - 4 AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def result_pages(spark, sf_dir):
    """A result page for each order: a bout for each line, in the layout that its number gives, and loose paragraphs below."""
    rows = _lines(spark, sf_dir)
    a, b = F.concat(F.lit("C"), "o_custkey"), F.concat(F.lit("S"), "l_suppkey")
    flag = F.col("l_returnflag")
    mark_a, mark_b = F.when(flag == "A", "Win").when(flag == "R", "Lose").otherwise("Draw"), F.when(flag == "A", "Lose").when(flag == "R", "Win").otherwise("Draw")


    def put(form: str, *c) -> Column:
        """The form with columns in place of its marks; joined, which takes far less time than formatting."""
        texts = re.split("%[sd]", form)
        shown = [F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit("null")) for x in c]
        return F.concat(F.lit(texts[0]), *(part for x, t in zip(shown, texts[1:], strict=True) for part in (x, F.lit(t))))

    number = put("第%d試合", F.col("k"))
    heading = F.when(F.col("k") < 5, put('<h2 class="article-heading"><span>%s</span></h2>', number)).otherwise(F.concat(F.when(F.col("k") == 5, '<h2 class="article-heading">後半</h2>').otherwise(""), put('<h3 class="article-subheading">%s</h3>', number)))
    rule, method = F.col("o_orderpriority"), put("%s stop %d", F.col("l_linestatus"), F.col("l_linenumber"))
    full = lambda m: F.when(m == "Draw", "-").otherwise(F.upper(m))
    body = (
        F.when(F.col("k") % 4 == 0, put('<div class="raw-html"><p style="text-align:center;">企画</p><p style="text-align:center;">%s<br><span style="font-weight:bold">（%s）<a href="x">%s</a> vs. <a href="y">%s</a>（%s）</span><br>%s</p></div>', rule, full(mark_a), a, b, full(mark_b), method))
        .when(F.col("k") % 4 == 1, put('<p>［%s］</p><h3 class="article-subheading">[%s] %s （ %s ） %s [%s]</h3>', rule, mark_a, a, method, b, mark_b))
        .when(F.col("k") % 4 == 2, put('<div class="raw-html"><p style="text-align:center; font-weight: bold">(%s)<a>%s</a> vs. <a>%s</a>(%s)<br>%s</p></div>', mark_a, a, b, mark_b, method))
        .otherwise(put('<div class="raw-html"><p style="text-align:center;">［%s］</p></div><div class="raw-html"><p style="text-align:center; font-weight: bold">(%s)%s<br> (%s) <br>%s(%s)</p></div>', rule, mark_a, a, method, b, mark_b))
    )
    loose = F.concat(
        F.when(F.col("k") % 3 == 0, put('<p class="wp-block-paragraph">○ %s（ジム） vs × %s（<b>ジム</b>） 一本</p>', b, a)).otherwise(""),
        F.when(F.col("k") % 2 == 0, put('<p class="wp-block-paragraph">○ X%d（ジム） vs × Y%d（ジム）<br>%s 1R</p>', F.col("l_partkey"), F.col("l_suppkey"), method)).otherwise(""),
        F.lit('<p class="wp-block-paragraph">○ 第1試合（a） vs × 判定（b） 判定</p>'),
    )
    parts = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("k", F.concat(heading, body).alias("x"), loose.alias("y")))).alias("p"))  # the lines of one order
    text = lambda field: F.array_join(F.transform("p", lambda x: x[field]), "\n")
    return parts.select(F.col("l_orderkey").alias("page"), F.concat(F.lit("<html><body><p>導入</p>"), text("x"), F.lit("<footer>"), text("y"), F.lit("</footer></body></html>")).alias("html"))


@query(f"""WITH {LINES_SQL} SELECT l_orderkey AS page, CASE WHEN k >= 5 AND late = 1 THEN '後半' ELSE '第' || k || '試合' END AS heading, CASE k % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END AS layout,
CASE WHEN k % 4 = 2 THEN '' ELSE o_orderpriority END AS rule, 'C' || o_custkey AS a, 'S' || l_suppkey AS b,
CASE l_returnflag WHEN 'A' THEN 'WIN' WHEN 'R' THEN 'LOSE' ELSE CASE WHEN k % 4 = 0 THEN 'NC' END END AS mark_a, CASE l_returnflag WHEN 'A' THEN 'LOSE' WHEN 'R' THEN 'WIN' ELSE CASE WHEN k % 4 = 0 THEN 'NC' END END AS mark_b, l_linestatus || ' stop ' || l_linenumber AS method FROM l""")
def result_page_bouts(spark, sf_dir):
    """All line items written as result pages of four layouts, cut into sections and read back."""
    return sections.page_bouts(result_pages(spark, sf_dir), "page", "html").drop("part", "title")


@query(f"""WITH {LINES_SQL}, x AS (SELECT l_orderkey AS page, 'X' || l_partkey AS a, 'Y' || l_suppkey AS b, l_linestatus || ' stop ' || l_linenumber || ' 1R' AS method, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey ORDER BY k) AS n FROM l WHERE k % 2 = 0)
SELECT page, a, b, '○' AS mark_a, '×' AS mark_b, method FROM x WHERE n = 1""")
def recovered_bouts(spark, sf_dir):
    """Bouts that only loose paragraphs of the same pages show."""
    return sections.page_recovered(result_pages(spark, sf_dir), "page", "html")


@query("""SELECT o_orderpriority AS page, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, 'Show ' || o_orderkey AS title, CASE WHEN o_orderkey % 3 > 0 THEN 'Hall ' || o_custkey END AS venue FROM orders""")
def calendar_rows(spark, sf_dir):
    """Calendars of all orders, a page for each customer and priority, their lines dated in three ways."""
    day = F.col("o_orderdate")
    ways = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy年M月d日(E)")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "yyyy.MM.dd")).otherwise(F.date_format(day, "yyyy/M/d"))
    line = F.concat(F.lit("<li>"), ways, F.lit(" Show "), "o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit(" <b>@</b> Hall "), "o_custkey")).otherwise(""), F.lit("</li>"))
    pages = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.array_join(F.collect_list(line), "\n").alias("lines"))  # a customer's orders
    page = F.to_json(F.struct("o_custkey", F.col("o_orderpriority").alias("p")))
    rows = sections.blocks(pages.select(page.alias("page"), F.concat(F.lit("<h1>日程</h1><ul>"), "lines", F.lit("</ul>")).alias("html")), "page", "html", ["n", "text"])
    return sections.calendar(rows, "page").select(F.get_json_object("page", "$.p").alias("page"), F.date_format("date", "yyyy-MM-dd").alias("date"), "title", "venue")
