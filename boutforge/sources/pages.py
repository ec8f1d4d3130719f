"""Record tables, infoboxes and ranking lists in wiki texts and pages, as rows.

Grammars that are regular are split by DataFrame functions; nested templates go through the balanced
scanner of ``feeds``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, dates
from ..functions.markup import decoded
from ..functions.results import once
from .feeds import templates

# Markup that goes, in this order.
WIKI_MARKUP = [
    (r"(?i)\{\{small\|([^}]*)\}\}", "$1"),
    (r"(?i)<ref[^>]*/>", ""),
    (r"(?is)<ref[^>]*>.*?</ref>", ""),
    (r"(?i)<br\s*/?>", " "),
    (r"\[\[([^|\]]+)\|([^\]]+)\]\]", "$2"),
    (r"\[\[([^\]]+)\]\]", "$1"),
    (r"\{\{仮リンク\|([^|{}]+)\|[^{}]*\}\}", "$1"),
    ("'''?", ""),
    (r"\{\{[^}]*\}\}", ""),
    (r"(?i)^align=center\|", ""),
    (r"\s+", " "),
]
INVISIBLE = "[\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\ufeff]"
WIN_MARKS, LOSS_MARKS, DRAW_MARKS, DASH_MARKS = ["○", "〇"], ["×", "✕", "✗"], ["△"], ["－", "-", "―", "ー"]
TOTALS = {"wins": ["wins", "win"], "losses": ["losses", "loss"], "draws": ["draws", "draw"], "ko": ["KOwins", "KO", "wins_ko"], "sub": ["subwins", "wins_submission"], "decision": ["decwins", "wins_decision"]}


def wiki_plain(text: Column) -> Column:
    """Wiki text without invisible characters and markup."""
    return F.trim(reduce(lambda t, step: F.regexp_replace(t, *step), WIKI_MARKUP, F.regexp_replace(text, INVISIBLE, "")))


def result_in_english(cell: Column) -> Column:
    c = F.lower(cell)
    return F.when(c.contains("win"), "win").when(c.contains("loss"), "loss").when(c.contains("draw"), "draw").when(c.rlike("cancel|unfought"), F.lit(None)).when(c.contains("nc"), "nc")


def result_in_japanese(mark: Column, method: Column) -> Column:
    m = F.trim(mark)
    none = F.lit(None).cast("string")
    return (
        F.when(m.isin(WIN_MARKS), "win")
        .when(m.isin(LOSS_MARKS), "loss")
        .when(m.isin(DRAW_MARKS), "draw")
        .when(m.isin(DASH_MARKS) & method.rlike("試合中止|不成立"), none)
        .when(m.isin(DASH_MARKS) & method.rlike("ノーコンテスト|無効|NC"), "nc")
    )


def record_table(pages: DataFrame, text: str) -> DataFrame:
    """The rows of English record tables: result, opponent, method, event, date and round, by their place.

    The table runs from its start mark to the nearer of its end mark and the next heading.
    """
    keep = [c for c in pages.columns if c != text]
    after = F.regexp_extract(F.col(text), r"(?is)\{\{MMA record start\}\}.*", 0)
    region = F.regexp_extract(after, r"(?is)^(.*?)(?:\{\{(?:MMA record end|end)\}\}|\n==[^=]|$)", 1)
    blocks = pages.select(*keep, F.posexplode(F.slice(F.split(F.when(after != "", region).otherwise(""), r"\n\|-"), 2, 1 << 30)).alias("place", "__block"))
    lines = F.transform(F.filter(F.transform(F.split("__block", "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") & ~x.startswith("|}")), lambda x: F.trim(F.substr(x, F.lit(2))))
    cells = blocks.select(*keep, "place", lines.alias("c")).where(F.size("c") >= 6)
    cell = lambda n: wiki_plain(F.try_element_at("c", F.lit(n)))
    round_ = F.coalesce(F.nullif(wiki_plain(F.coalesce(F.try_element_at("c", F.lit(7)), F.lit(""))), F.lit("")), F.lit(""))
    rows = cells.select(
        *keep,
        "place",
        result_in_english(F.try_element_at("c", F.lit(1))).alias("result"),
        cell(3).alias("opponent"),
        F.coalesce(F.nullif(cell(4), F.lit("")), F.lit("—")).alias("method"),
        F.coalesce(F.nullif(cell(5), F.lit("")), F.lit("—")).alias("event"),
        dates.template_date(F.try_element_at("c", F.lit(6))).alias("date"),
        F.when(round_ != "", F.concat(F.lit("R"), round_)).otherwise("—").alias("round"),
    )
    return rows.where("result is not null and opponent <> '' and date <> ''")


def without_amateur_sections(text: Column) -> Column:
    """Without what stands under headings for amateurs, up to the next heading or, under bold ones, the table's end."""
    headed = F.regexp_replace(text, r"(?s)={2,4}[^=\n]*アマチュア[^=\n]*={2,4}.*?(?=={2,4}[^=\n]+={2,4}|$)", "")
    return F.regexp_replace(headed, r"(?s)'''[^'\n]*アマチュア[^'\n]*'''.*?(?:\{\{Fight-end\}\}|$)", "")


def mma_section(text: Column) -> Column:
    """The first section for mixed martial arts that holds a record, else all of it; without amateur sections."""
    sections = F.regexp_extract_all(text, F.lit(r"(?s)={2,4}(?![^=\n]*アマチュア)[^=\n]*総合格闘技[^=\n]*={2,4}(.*?)(?=={2,4}[^=\n]+={2,4}|$)"), 1)
    first = F.try_element_at(F.filter(sections, lambda s: s.contains("{{Fight-cont")), F.lit(1))
    return without_amateur_sections(F.coalesce(first, text))


def fight_rows(pages: DataFrame, text: str) -> DataFrame:
    """The bouts of Japanese record templates: result, opponent, method, event, date and round, newest first."""
    keep = [c for c in pages.columns if c != text]
    sections = pages.select(*keep, mma_section(F.col(text)).alias(text))
    # the template's name is its first part
    parts = templates(sections, text, "{{Fight-cont", [r"(?i)<ref[^>]*/>", r"(?is)<ref[^>]*>.*?</ref>", INVISIBLE]).where(F.size("p") >= 6)
    raw = lambda n: F.try_element_at("p", F.lit(n + 1))
    plain = F.struct(*(F.get("c", F.lit(k)).alias(c) for k, c in enumerate(("opponent", "method", "event", "day"))))
    # exploded, so that what follows names texts that are found once
    found = parts.select(*keep, "place", result_in_japanese(raw(1), raw(3)).alias("result"), F.explode(F.array(F.transform(F.slice("p", 3, 4), wiki_plain))).alias("c"))
    cells = found.where("result is not null").select(*keep, "place", "result", plain.alias("x")).select(*keep, "place", "result", "x.*")
    round_ = F.regexp_extract("method", r"(\d+)R", 1)
    rows = cells.select(
        *keep,
        "place",
        "result",
        "opponent",
        F.coalesce(F.nullif("method", F.lit("")), F.lit("—")).alias("method"),
        F.coalesce(F.nullif("event", F.lit("")), F.lit("—")).alias("event"),
        dates.japanese_date(F.col("day")).alias("date"),
        F.when(round_ != "", F.concat(F.lit("R"), round_)).otherwise("—").alias("round"),
    )
    return rows.where("opponent <> '' and date <> ''")


def field(text: Column, name: str) -> Column:
    """A template's field to the end of its line, plain; null where it is empty or missing."""
    raw = F.regexp_extract(text, rf"(?i)\|[ \t]*{name}[ \t]*=[ \t]*([^\n]*)", 1)
    return once(raw, lambda x: F.when(x != "", F.nullif(wiki_plain(x), F.lit(""))))


def stated_totals(text: Column) -> Column:
    """A struct of the totals that a record box states; null without wins and losses."""
    number = lambda scope, names: F.coalesce(*(F.regexp_extract(field(scope, n), r"^(\d+)$", 1).try_cast("int") for n in names))
    found = lambda scope: F.struct(*(number(scope, v).alias(k) for k, v in TOTALS.items()))
    told = lambda t: F.struct(*((t[k] if k in ("wins", "losses") else F.coalesce(t[k], F.lit(0))).alias(k) for k in TOTALS))
    return once(once(mma_section(text), found), lambda t: F.when(t["wins"].isNotNull() & t["losses"].isNotNull(), told(t)))


def infobox(text: Column, at: Column) -> Column:
    """A struct of nickname, birth place and age on a day, from English or Japanese infoboxes."""
    current = F.filter(F.transform(F.split(field(text, "other_names"), ","), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"(?i)\(former\)"))
    nickname = F.coalesce(F.try_element_at(current, F.lit(1)), F.nullif(F.trim(F.element_at(F.split(F.regexp_extract(text, r"(?i)\|[ \t]*nickname[ \t]*=[ \t]*([^\n]*)", 1), r"(?i)<br\s*/?>"), 1)), F.lit("")))
    born = lambda p: F.try_to_date(F.concat_ws("-", *(F.regexp_extract(text, p, n) for n in (1, 2, 3))), "yyyy-M-d")
    day = F.coalesce(born(r"(?i)\{\{birth date and age\|(?:df=\w+\|)?(\d{4})\|(\d{1,2})\|(\d{1,2})"), born(r"\{\{生年月日と年齢\|(\d{4})\|(\d{1,2})\|(\d{1,2})"))
    return F.struct(nickname.alias("nickname"), F.coalesce(field(text, "birth_place"), field(text, "place")).alias("birth_place"), dates.age(day, at).alias("age"))


def ranking_page(pages: DataFrame, html: str) -> DataFrame:
    """Classes and ranks of a ranking page with headings: a class's second list is the women's."""
    keep = [c for c in pages.columns if c != html]
    blocks = pages.select(*keep, F.posexplode(F.slice(F.split(F.col(html), "<h4>"), 2, 1 << 30)).alias("block", "__b"))
    base = F.regexp_extract(F.element_at(F.split("__b", "</h4>"), 1), f"({'|'.join(classify.CLASS_KG)}|アトム級)", 1)
    named = blocks.withColumn("base", base).where("base <> ''")
    again = F.row_number().over(Window.partitionBy(*keep, "base").orderBy("block")) > 1
    told = named.withColumn("class", F.when(again | (F.col("base") == "アトム級"), F.concat(F.lit("女子"), "base")).otherwise(F.col("base")))
    row = r'(?s)<td class="(?:rankingno|rankingnokop)">(.*?)</td>.*?<a[^>]*>([^<]+)</a>'
    entries = told.select(*keep, "block", "class", F.posexplode(F.regexp_extract_all("__b", F.lit(row), 0)).alias("place", "__e"))
    rank = F.regexp_replace(F.regexp_replace(F.regexp_extract("__e", row, 1), "<[^>]+>", " "), r"\s", "")
    name = F.trim(F.regexp_replace(F.regexp_extract("__e", row, 2), r"\s+", " "))
    return entries.select(*keep, "class", "place", rank.alias("rank"), decoded(name).alias("name")).where("rank <> '' and name <> ''")


def champion_page(pages: DataFrame, html: str) -> DataFrame:
    """Classes, champions and ranks of a page whose lists have a table each for champion and ranking; regional lists are left out."""
    keep = [c for c in pages.columns if c != html]
    blocks = pages.select(*keep, F.posexplode(F.slice(F.split(F.col(html), '<h4 id="'), 2, 1 << 30)).alias("block", "__b"))
    head = F.element_at(F.split("__b", ">"), 1)
    base = F.regexp_extract(head, f"({'|'.join(classify.CLASS_KG)}|アトム級)", 1)
    told = blocks.where(~head.contains("環太平洋") & (base != "")).withColumn("class", F.when(head.contains("女子"), F.concat(F.lit("女子"), base)).otherwise(base))
    champion = F.regexp_extract("__b", r'(?s)<table class="champion">.*?<span class="chmp-name">\s*<a[^>]*>([^<]+)</a>', 1)
    table = F.regexp_extract("__b", r'(?s)<table class="ranking table".*?</table>', 0)
    row = r'(?s)<tr>\s*<td>(\d+)</td>.*?<a[^>]*class="fighter-mdl"[^>]*>([^<]+?)</a>'
    clean = lambda n: F.trim(F.regexp_replace(F.element_at(F.split(n, "/"), 1), r"\s+", " "))
    first = F.when(champion != "", F.array(F.struct(F.lit("王者").alias("rank"), clean(champion).alias("name")))).otherwise(F.array().cast("array<struct<rank:string,name:string>>"))
    rest = F.transform(F.regexp_extract_all(table, F.lit(row), 0), lambda e: F.struct(F.regexp_extract(e, row, 1).alias("rank"), clean(F.regexp_extract(e, row, 2)).alias("name")))
    return told.select(*keep, "class", F.posexplode(F.concat(first, rest)).alias("place", "e")).select(*keep, "class", "place", "e.rank", "e.name").where("name <> ''")


def card_page(pages: DataFrame, html: str, words: list[str], prefix: str) -> DataFrame:
    """Linked headlines with a date (url, title, published) that have one of the words; their wording is evened out."""
    keep = [c for c in pages.columns if c != html]
    card = r'(?s)<a href="(/news/\d+/)"><div class="inner">.*?<h2 class="title">(.*?)</h2>.*?<time class="date" datetime="([^"]+)"'
    cards = pages.select(*keep, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(card), 0)).alias("place", "__c"))
    part = lambda n: F.regexp_extract("__c", card, n)
    raw = F.trim(F.regexp_replace(part(2), "<[^>]+>", ""))
    steps = [(r"\s+", " "), (rf"^{prefix}\s*", ""), ("という。?$", "とのこと"), ("明かした", "語った"), ("コメントした", "話した")]
    even = reduce(lambda t, step: F.regexp_replace(t, *step), steps, raw)
    rows = cards.select(*keep, "place", part(1).alias("url"), raw.alias("__raw"), F.concat(F.lit(prefix), F.trim(even)).alias("title"), part(3).alias("published"))
    return rows.where((F.col("__raw") != "") & F.col("__raw").rlike("|".join(words))).drop("__raw")


def listed_bouts(pages: DataFrame, text: str, mark: str = r"[○×△ー-]") -> DataFrame:
    """Bouts in running text, one to a line: a mark and name on either side of ``vs``, and the way it ended in brackets.

    Lines of one pair count once, and names of more than 30 characters are garble.
    """
    keep = [c for c in pages.columns if c != text]
    gap = r"[\s　]*"  # white space of full width too
    line = rf"({mark}){gap}([^\n（(]+?){gap}(?:vs\.?|VS|対){gap}({mark}){gap}([^\n（(]+?){gap}(?:[（(]([^）)\n]*)[）)])?{gap}(?=\n|$)"
    found = pages.select(*keep, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(line), 0)).alias("place", "__l"))
    part = lambda n: F.trim(F.regexp_extract("__l", line, n))
    rows = found.select(*keep, "place", part(1).alias("mark_a"), part(2).alias("a"), part(3).alias("mark_b"), part(4).alias("b"), part(5).alias("method"))
    clean = rows.where((F.char_length("a") <= 30) & (F.char_length("b") <= 30))
    first = F.row_number().over(Window.partitionBy(*keep, F.least("a", "b"), F.greatest("a", "b")).orderBy("place"))
    return clean.withColumn("__n", first).where("__n = 1").drop("__n")
