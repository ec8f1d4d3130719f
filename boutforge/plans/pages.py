"""Parsers on small pages written here; the rows that must come out are listed beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import feeds, pages
from .registry import query

_EN = """Intro
{{MMA record start}}
|-
| {{yes2}}Win
| align=center|2–0
| [[Ann Example|A. Example]]
| KO (punch)<ref>x</ref>
| ''[[Show 2]]''
| {{dts|2020|May|9}}
| align=center|2
|-
| {{no2}}Loss
| align=center|1–1
| Bob
| Decision
| Show 1
| {{dts|2019.12.31}}
| align=center|3
|-
| Cancelled
| 1-1
| Carl
| x
| y
| {{dts|2018|1|2}}
|-
| Win
| short
{{MMA record end}}
|-
| Win
| x
| Late
| x
| y
| {{dts|2018|1|2}}
"""
_JA = """== 経歴 ==
text
== 戦績 ==
=== 総合格闘技 ===
{{Fight-start}}
{{Fight-cont|○|[[甲野|甲]]|1R 2:03 KO|[[大会A]]|2020年5月9日}}
{{Fight-cont|×|乙|{{small|判定}}0-3|大会B<ref>z</ref>|2021年1月2日}}
{{Fight-cont|－|丙|ノーコンテスト|大会C|2019年3月4日}}
{{Fight-cont|－|丁|試合中止|大会D|2019年3月5日}}
{{Fight-end}}
=== アマチュア総合格闘技 ===
{{Fight-cont|○|戊|KO|大会E|2018年3月5日}}
"""
_BOX = """{{Infobox
| other_names = Old One (former), New One
| birth_place = [[Tokyo]], Japan
| birth_date = {{birth date and age|1990|6|15}}
| wins = 10
| losses = 3
| KO = 4
}}"""
_RANKS = """<h4>フライ級</h4><table><tr><td class="rankingnokop">王者</td><td><a href="x">甲 野</a></td></tr><tr><td class="rankingno"> 1 </td><td><a>乙&amp;丙</a></td></tr></table>
<h4>アトム級</h4><tr><td class="rankingno">1</td><td><a>丁</a></td></tr><h4>フライ級</h4><tr><td class="rankingno">1</td><td><a>戊</a></td></tr><h4>他</h4>"""
_CHAMPIONS = """<h4 id="世界フライ級"><table class="champion"><span class="chmp-name"> <a href="x">甲 / KO</a></span></table><table class="ranking table"><tr> <td>1</td><td><a class="fighter-mdl" href="y">乙 / O</a></td></tr><tr><td>2</td><td><a class="fighter-mdl">丙</a></td></tr></table>
<h4 id="環太平洋フライ級"><table class="ranking table"><tr><td>1</td><td><a class="fighter-mdl">丁</a></td></tr></table><h4 id="女子アトム級"><table class="ranking table"><tr><td>1</td><td><a class="fighter-mdl">戊</a></td></tr></table>"""
_CARDS = """<a href="/news/12/"><div class="inner"><h2 class="title">【RIZIN】<b>甲</b>が勝利を明かした</h2><time class="date" datetime="2024-05-06 10:00"></time></a>
<a href="/news/13/"><div class="inner"><h2 class="title">別の話題</h2><time class="date" datetime="2024-05-06 11:00"></time></a><a href="/news/14/"><div class="inner"><h2 class="title">RIZINに乙が出るという。</h2><time class="date" datetime="2024-05-07 09:00"></time></a>"""
_LINES = "大会結果\n○ 甲 vs × 乙（1R KO）\n△丙 対 △丁\n× 乙 VS ○ 甲\n○" + "長" * 31 + " vs × 戊\n以上"


def _page(spark, text: str):
    return spark.createDataFrame([(1, text)], "page int, text string")


@query("SELECT * FROM (VALUES (1, 'win', 'A. Example', 'KO (punch)', 'Show 2', '2020-05-09', 'R2'), (1, 'loss', 'Bob', 'Decision', 'Show 1', '2019-12-31', 'R3')) t(page, result, opponent, method, event, date, round)")
def english_record(spark, sf_dir):
    return pages.record_table(_page(spark, _EN), "text").drop("place")


@query("SELECT * FROM (VALUES (1, 'win', '甲', '1R 2:03 KO', '大会A', '2020-05-09', 'R1'), (1, 'loss', '乙', '判定0-3', '大会B', '2021-01-02', '—'), (1, 'nc', '丙', 'ノーコンテスト', '大会C', '2019-03-04', '—')) t(page, result, opponent, method, event, date, round)")
def japanese_record(spark, sf_dir):
    return pages.fight_rows(_page(spark, _JA), "text").drop("place")


@query("SELECT 1 AS page, 'New One' AS nickname, 'Tokyo, Japan' AS birth_place, CAST(33 AS INTEGER) AS age, CAST(10 AS INTEGER) AS wins, CAST(3 AS INTEGER) AS losses, CAST(0 AS INTEGER) AS draws, CAST(4 AS INTEGER) AS ko")
def infobox_fields(spark, sf_dir):
    box, totals = pages.infobox(F.col("text"), F.lit("2024-06-14").cast("date")), pages.stated_totals(F.col("text"))
    return _page(spark, _BOX).select("page", box.alias("b"), totals.alias("t")).select("page", "b.nickname", "b.birth_place", "b.age", "t.wins", "t.losses", "t.draws", "t.ko")


@query("SELECT * FROM (VALUES ('フライ級', '王者', '甲 野'), ('フライ級', '1', '乙&丙'), ('女子アトム級', '1', '丁'), ('女子フライ級', '1', '戊')) t(class, rank, name)")
def ranking_lists(spark, sf_dir):
    return pages.ranking_page(_page(spark, _RANKS), "text").select("class", "rank", "name")


@query("SELECT * FROM (VALUES ('フライ級', '王者', '甲'), ('フライ級', '1', '乙'), ('フライ級', '2', '丙'), ('女子アトム級', '1', '戊')) t(class, rank, name)")
def champion_lists(spark, sf_dir):
    return pages.champion_page(_page(spark, _CHAMPIONS), "text").select("class", "rank", "name")


@query("SELECT * FROM (VALUES ('/news/12/', '【RIZIN】甲が勝利を語った', '2024-05-06 10:00'), ('/news/14/', '【RIZIN】RIZINに乙が出るとのこと', '2024-05-07 09:00')) t(url, title, published)")
def tagged_cards(spark, sf_dir):
    """The page comes as bytes in Shift_JIS."""
    raw = spark.createDataFrame([(1, bytearray(_CARDS.encode("shift_jis")))], "page int, raw binary")
    return pages.card_page(raw.select("page", feeds.shift_jis("raw").alias("text")), "text", ["RIZIN"], "【RIZIN】").select("url", "title", "published")


@query("SELECT * FROM (VALUES ('○', '甲', '×', '乙', '1R KO'), ('△', '丙', '△', '丁', '')) t(mark_a, a, mark_b, b, method)")
def listed_bouts(spark, sf_dir):
    return pages.listed_bouts(_page(spark, _LINES), "text").select("mark_a", "a", "mark_b", "b", "method")
