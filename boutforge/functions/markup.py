"""Markup, links and lengths of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track; the ampersand entity is undone last.
TRACKING = "^(utm_[^=]*|fbclid|gclid)(=|$)"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def without_tracking(url: Column) -> Column:
    """The link without tracking parameters; other parameters keep their order."""
    base = F.regexp_extract(url, "^[^?#]*", 0)
    fragment = F.regexp_extract(url, "#.*$", 0)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    return F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), fragment)


def decoded(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def plain_text(html: Column) -> Column:
    """Text of a page: without scripts, styles, comments and tags; entities decoded; white space single."""
    bare = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</\\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(bare, "<[^>]*>", " ")), r"[ \t\r\n]+", " "))


def title(html: Column) -> Column:
    return F.trim(decoded(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('(?i)<a[^>]*href="([^"]*)"'), 1)


def display_width(text: Column) -> Column:
    """Half a cell for each character up to U+00FF, one for any other."""
    narrow = F.char_length(F.regexp_replace(text, "[^\\u0000-\\u00ff]", ""))
    return F.char_length(text) - narrow * 0.5


def post_length(text: Column, link_length: int = 23) -> Column:
    """Length of a post: links count alike, wide characters twice."""
    n_links = F.size(F.regexp_extract_all(text, F.lit(r"https?://\S+"), 0))
    rest = F.regexp_replace(text, r"https?://\S+", "")
    wide = F.char_length(F.regexp_replace(rest, "[\\u0000-\\u10ff\\u2000-\\u200d\\u2010-\\u201f\\u2032-\\u2037]", ""))
    return F.char_length(rest) + wide + n_links * link_length
