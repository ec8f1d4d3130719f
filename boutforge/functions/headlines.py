"""Headlines and lines of posts: labels, shortening, hashtags and lengths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import display_width
from .names import to_hiragana, to_katakana

# Words that make a headline a result or a piece of news, and hashtags by promotion.
RESULT_WORDS = ["KO勝", "TKO勝", "一本勝", "判定勝", "撃破", "下し", "破り", "破って", "制し", "優勝", "王座奪取", "新王者", "防衛成功", "一本で", "秒殺"]
BREAKING_WORDS = ["速報", "電撃", "緊急", "決定", "参戦", "欠場", "移籍", "引退", "対戦", "決戦", "タイトルマッチ", "挑戦", "調印", "契約"]
HASHTAGS = [("#RIZIN", "rizin", ["RIZIN", "ライジン"]), ("#DEEP", "deep", ["DEEP"]), ("#パンクラス", "pancrase", ["パンクラス", "PANCRASE"]), ("#修斗", "shooto", ["修斗", "SHOOTO"])]
SCRIPTS = [("kanji", "一-鿿"), ("hiragana", "぀-ゟ"), ("katakana", "゠-ヿー"), ("latin", "A-Za-z0-9")]


def post_label(title: Column) -> Column:
    """結果 or 速報 by the words of a headline; null for neither."""
    return F.when(title.rlike("|".join(RESULT_WORDS)), "結果").when(title.rlike("|".join(BREAKING_WORDS)), "速報")


def without_label(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(title), r"^【[^】]*】\s*", ""))


def without_quotes(title: Column) -> Column:
    return F.regexp_replace(title, "「[^」]*」|『[^』]*』", "")


def _prefix_that_fits(text: Column, width: float) -> Column:
    """The longest beginning of at most that display width, from one pass over the first characters that may fit."""
    first = F.split(F.substr(text, F.lit(1), F.lit(int(2 * width) + 1)), "")
    size = lambda c: F.when(c <= "\u00ff", 0.5).otherwise(1.0)
    step = lambda s, c: F.struct((s["w"] + size(c)).alias("w"), (s["n"] + F.when(s["w"] + size(c) <= width, 1).otherwise(0)).alias("n"))
    return F.substr(text, F.lit(1), F.aggregate(first, F.struct(F.lit(0.0).alias("w"), F.lit(0).alias("n")), step)["n"])


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def summarised(title: Column, width: float = 55) -> Column:
    """A headline cut to a width: at its last full stop, else at its last comma that fits, else within a word.

    Labels before it and dates behind an equals sign go first.
    """
    whole = F.trim(F.regexp_replace(F.regexp_replace(without_label(title), r"\s*＝[^＝]*\d+月\d+日.*$", ""), r"\s+", " "))

    def shortened(plain: Column, fitting: Column) -> Column:
        stop = F.regexp_extract(fitting, "(?s)^(.*[。！!？?])", 1)
        # a comma may stand just beyond what fits
        comma = F.regexp_extract(F.substr(plain, F.lit(1), F.char_length(fitting) + 1), "(?s)^(.*)、", 1)
        cut = F.when(stop != "", stop).when(comma != "", comma)
        short = F.trim(F.regexp_replace(cut, "[、。]$", ""))
        return F.coalesce(short, F.concat(F.trim(_prefix_that_fits(plain, width - 1)), F.lit("…")))

    return _once(whole, lambda plain: F.when(display_width(plain) <= width, plain).otherwise(_once(_prefix_that_fits(plain, width), lambda fitting: shortened(plain, fitting))))


def hashtags(titles: Column, sources: Column, most: int = 3) -> Column:
    """#MMA and the tags of promotions that any headline or source names, at most so many."""
    named = lambda words: F.exists(titles, lambda t: t.rlike("|".join(words)))
    tags = [F.when(named(words) | F.array_contains(sources, org), F.lit(tag)) for tag, org, words in HASHTAGS]
    return F.slice(F.array_compact(F.array(F.lit("#MMA"), *tags)), 1, most)


def lines_that_fit(lines: Column, tags: Column, most: int, link: int = 23) -> Column:
    """The text of a post: as many of the lines as fit with the tags and a link; each character beyond U+10FF counts twice."""
    weight = lambda s: F.char_length(s) + F.char_length(F.regexp_replace(s, "[\\u0000-\\u10ff]", ""))
    tail = F.array_join(tags, " ")
    text = lambda n: F.array_join(F.slice(lines, 1, n), "\n")
    fits = F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), lambda n: weight(text(n)) + weight(tail) + 2 + link <= most)
    return F.concat(text(F.coalesce(F.array_max(fits), F.lit(1))), F.lit("\n"), tail)


def event_summary(name: Column, day: Column, venue: Column, bouts: Column, a: Column, b: Column, winner: Column, method: Column) -> Column:
    """A line about an event from its main bout; without a winner only who met."""
    head = F.concat(name, F.lit("（"), F.date_format(day, "yyyy年M月d日"), F.when(venue.isNotNull(), F.concat(F.lit("・"), venue)).otherwise(""), F.lit("）"))
    n = bouts.cast("string")
    none = F.coalesce(winner, F.lit("")).isin("", "引き分け", "中止", "NC")
    loser = F.when(winner == a, b).otherwise(a)
    open_ = F.concat(head, F.lit("全"), n, F.lit("試合の結果を掲載。メインイベントは"), a, F.lit(" vs "), b, F.lit("。"))
    return F.when(none, open_).otherwise(F.concat(head, F.lit("メインイベントは"), winner, F.lit("が"), method, F.lit("で"), loser, F.lit("に勝利。全"), n, F.lit("試合の結果を掲載。")))


def _script(character: Column) -> Column:
    chain = F.lit("other")
    for name, signs in reversed(SCRIPTS):
        chain = F.when(character.rlike(f"^[{signs}]$"), name).otherwise(chain)
    return chain


def place_of_name(text: Column, name: Column) -> Column:
    """Where a name stands in a text with no sign of its own script next to it; 0 where it doesn't."""
    n = F.char_length(name)
    last = F.char_length(text) - n + 1
    places = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, n) == name)
    at = lambda i: F.substr(text, i, F.lit(1))
    apart = lambda inner, outer: (_script(inner) == "other") | (_script(inner) != _script(outer))
    free = F.filter(places, lambda i: ((i == 1) | apart(at(i), at(i - 1))) & ((i == last) | apart(at(i + n - 1), at(i + n))))
    return F.coalesce(F.array_min(free), F.lit(0))


def search_forms(name: Column) -> Column:
    """A name as it may be typed: as it is, in katakana, in hiragana, in lower case."""
    return F.array_distinct(F.array(name, to_katakana(name), to_hiragana(name), F.lower(name)))
