"""Pages as blocks of text under their headings, and the bouts that blocks show in one of several layouts.

``blocks`` cuts a page at block-level tags with a stack of open ones, tag soup included. What follows is
DataFrame work over its rows: sections are running counts of headings, a layout is a column that is null where
it doesn't fit, and the layouts of a section are tried in order by ``coalesce``. A second pass looks at loose
paragraphs and gives only pairs that the first one hasn't found. ``page_bouts`` and ``page_recovered`` give the
same rows from whole pages: a page is read where it is cut, and only its bouts leave the worker.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import ENTITIES

# What cuts text into blocks, what a tag closes without saying so, and names that are none.
BLOCK_TAGS = "html head title body header footer main nav section article aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th blockquote form hr"
CLOSED_BY = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"]}
SECTION_HEADING, TITLE_HEADING, LOOSE_PARAGRAPH = "article-heading", "article-subheading", "wp-block-paragraph"
MARKS = "●○〇△◯×⚪⚫"
METHOD_WORDS = "判定|反則|ノーコンテスト|棄権|降参|失格|不戦"
MAX_LOOSE = 200
LAYOUTS = "abcd"
SPACE = "[\\s\\u3000]"
OLD = r"^[\[［](\w+)[\]］]\s*(.+?)\s*（([\s\S]*?)）\s*(.+?)\s*[\[［](\w+)[\]］]".replace(r"\s", SPACE)
PLAIN = r"^(?:\((\w+)\))?\s*(.+?)\s*\(([\s\S]*?)\)\s*(.+?)\s*(?:\((\w+)\))?$".replace(r"\s", SPACE)
BRACKETED, BEHIND = r"^\s*［([\s\S]*?)］\s*$", r"^\(?(\w+)\)?"
LOOSE = rf"^([{MARKS}]?)\s*([^（(]+?)\s*[（(][^）)]{{0,40}}[）)]\s*(?:vs\.?|VS\.?|対|ー)?\s*([{MARKS}]?)\s*([^（(]+?)\s*[（(][^）)]{{0,40}}[）)]\s*(.*)$".replace(r"\s", SPACE)
JUNK = rf"^[{MARKS}]+$|^[\[【]|{METHOD_WORDS}|第\s*\d+試合|メインイベント|セミファイナル"
TOLD = f"{METHOD_WORDS}|KO|一本|R"
ROWS = 4096  # of an Arrow batch

_BLOCK = frozenset(BLOCK_TAGS.split())
_TOKEN = re.compile(r"(?is)(<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|</?[a-z][a-z0-9]*\b[^>]*>)")
_TAG = re.compile(r"(?i)<(/?)([a-z][a-z0-9]*)\b([^>]*)>")
_BLANKS, _SPACES, _AROUND_BREAKS = re.compile(r"[ \t\r\n\f]+"), re.compile(" +"), re.compile(" *\n *")
_UNEVEN = re.compile(r"[\t\r\n\f]|  ")
_UNCLEAN = ("&", "\t", "\r", "\f", "  ", " \n", "\n ", "\n\n")
_HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
_CLASS, _BOLD = re.compile(r"""(?i)\bclass\s*=\s*["']?([^"'>]*)"""), re.compile(r"(?i)font-weight:\s*bold")
BLOCKS = "n int, tag string, opens boolean, path string, headings array<string>, css string, bold boolean, pieces array<struct<kind:string,bold:boolean,text:string>>, text string"
_TYPES = [pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_(), None, pa.string()]  # pieces: see _nested


def _clean(text: str) -> str:
    if "&" in text:
        for entity, char in ENTITIES:
            text = text.replace(entity, char)
    return _BLANKS.sub(" ", text) if _UNEVEN.search(text) else text


def _nested(pieces: list[list[tuple[str, bool, str]]]) -> pa.Array:
    ends = [0, *itertools.accumulate(map(len, pieces))]
    kinds, bolds, texts = zip(*itertools.chain.from_iterable(pieces), strict=True)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(bolds, pa.bool_()), pa.array(texts, pa.string())], names=["kind", "bold", "text"]))


_INLINE = frozenset(["a", "b", "strong", "i", "em", "span", "u", "font"])
_KNOWN: dict[str, tuple | None] = {}  # tags as they were written, and what they are
MAX_KNOWN = 4096


def _tag(token: str) -> tuple | None:
    """Name, whether it closes, is a block, its class, whether its style is bold, whether it makes text bold, and what it closes unsaid; None for what is no tag."""
    found = None
    if m := _TAG.fullmatch(token):
        name, attributes = m[2].lower(), m[3]
        css, bold = _CLASS.search(attributes), _BOLD.search(attributes) is not None
        found = (name, bool(m[1]), name in _BLOCK, css[1].strip() if css else "", bold, bold or name in ("b", "strong"), ("p", *CLOSED_BY.get(name, ())))
    if len(_KNOWN) >= MAX_KNOWN:
        _KNOWN.clear()
    _KNOWN[token] = found
    return found


def page_rows(html: str, above: bool = True) -> list[tuple]:
    """The blocks of one page, as rows of BLOCKS; without paths and headings where what is above isn't wanted."""
    rows: list[tuple] = []
    stack: list[tuple[str, str, bool]] = []  # tag, class, bold
    inline: list[tuple[str, bool]] = []
    pieces: list[tuple[str, bool, str]] = []
    headings: list[tuple[int, str]] = []
    opens = False
    kind, strong = "text", False  # of text where we are
    even = not any([x in html for x in _UNCLEAN])  # white space is single blanks or breaks, nothing is escaped
    parts = _TOKEN.split(html)
    parts.append("<hr>")  # ends the last block
    for k in range(0, len(parts), 2):
        if raw := parts[k]:
            if not even:
                raw = _clean(raw)
            elif "\n" in raw:
                raw = raw.replace("\n", " ")
            pieces.append((kind, strong, raw))
        token = parts[k + 1]
        tag = _KNOWN[token] if token in _KNOWN else _tag(token)
        if tag is None:
            continue
        name, closes, is_block, css, bold, makes_bold, unsaid = tag
        if not is_block:
            if name == "br":
                pieces.append(("break", False, "\n"))
                continue
            if closes:
                known = [n for n, (t, _) in enumerate(inline) if t == name]
                if known:
                    del inline[known[-1]]
                kind, strong = "text", False
                for t, b in inline:
                    kind, strong = "link" if t == "a" else kind, b or strong
            elif name in _INLINE:
                inline.append((name, makes_bold))
                kind, strong = "link" if name == "a" else kind, makes_bold or strong
            continue
        if inline:
            inline, kind, strong = [], "text", False
        if pieces:
            text = pieces[0][2] if len(pieces) == 1 else "".join([t for _, _, t in pieces])
            if "  " in text:
                text = _SPACES.sub(" ", text)
            if "\n" in text:
                text = _AROUND_BREAKS.sub("\n", text)
            text = text.strip(" \n")
            if text:
                of, of_css, of_bold = stack[-1] if stack else ("", "", False)
                rows.append((len(rows), of, opens, "/".join([t for t, _, _ in stack]) if above else None, [h for _, h in headings] if above else None, of_css, of_bold, pieces, text))
                if above and of in _HEADINGS:
                    level = int(of[1])
                    headings = [(n, h) for n, h in headings if n < level] + [(level, text)]
            pieces = []
        opens = not closes
        if closes:
            if stack and stack[-1][0] == name:
                stack.pop()
            elif known := [n for n, (t, _, _) in enumerate(stack) if t == name]:
                del stack[known[-1] :]
            continue
        while stack and stack[-1][0] in unsaid:
            stack.pop()
        if name != "hr":
            stack.append((name, css, bold))
    return rows


def blocks(pages: DataFrame, key: str, html: str, only: list[str] | None = None) -> DataFrame:
    """key and the blocks of each page in their order; headings are those above a block, outermost first.

    only names the columns of BLOCKS that are wanted; no others are handed over by the workers.
    """
    kind = pages.schema[key].dataType.simpleString()
    fields = [f.strip() for f in re.split(r", (?=\w+ )", BLOCKS)]
    taken = [k for k, f in enumerate(fields) if only is None or f.split()[0] in only]
    names = [key, *(fields[k].split()[0] for k in taken)]
    above = "path" in names or "headings" in names

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats: list[int] = []
            rows: list[tuple] = []
            for at in range(batch.num_rows):
                found = page_rows(batch.column(1)[at].as_py() or "", above)
                ats += [at] * len(found)
                rows += found
                if rows and (len(rows) >= ROWS or at == batch.num_rows - 1):
                    columns = [([r[k] for r in rows], _TYPES[k]) for k in taken]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ats)), *(_nested(c) if t is None else pa.array(c, t) for c, t in columns)], names=names)
                    ats, rows = [], []

    return pages.select(key, F.col(html).cast("string")).mapInArrow(cut, ", ".join([f"{key} {kind}", *(fields[k] for k in taken)]))


def sections(rows: DataFrame, key: str) -> DataFrame:
    """Blocks with their section and its heading: from a section heading to the next, or from title to title where one holds several.

    A page without section headings is one section; what comes before the first one belongs to none.
    """
    page = Window.partitionBy(key)
    so_far = page.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    is_h2 = (F.col("tag") == "h2") & F.col("css").contains(SECTION_HEADING)
    is_title = (F.col("tag") == "h3") & F.col("css").contains(TITLE_HEADING) & ~F.col("text").startswith("[")
    rows = rows.withColumns({"part": F.sum(is_h2.cast("int")).over(so_far), "parts": F.sum(is_h2.cast("int")).over(page)}).where("part > 0 or parts = 0")
    own = Window.partitionBy(key, "part")
    rows = rows.withColumns({"title": F.sum(is_title.cast("int")).over(own.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)), "titles": F.sum(is_title.cast("int")).over(own)})
    rows = rows.where("titles <= 1 or title > 0").withColumn("title", F.when(F.col("titles") > 1, F.col("title")).otherwise(0))
    inner = Window.partitionBy(key, "part", "title")
    first = lambda c: F.min_by(F.when(c, F.col("text")), F.when(c, F.col("n"))).over(inner)
    heading = F.coalesce(first(is_h2), first((F.col("tag") == "h3") & F.col("css").contains(TITLE_HEADING)), F.lit(""))
    return rows.withColumn("heading", heading).drop("parts", "titles")


def _mark(text: Column) -> Column:
    up = F.upper(text)
    return F.when(up.contains("WIN"), "WIN").when(up.contains("LOSE"), "LOSE").when(text.contains("-"), "NC")


def _bout(rule: Column, a: Column, b: Column, mark_a: Column, mark_b: Column, method: Column, fits: Column) -> Column:
    parts = {"rule": rule, "a": F.trim(a), "b": F.trim(b), "mark_a": mark_a, "mark_b": mark_b, "method": F.trim(method)}
    return F.when(fits & (parts["a"] != "") & (parts["b"] != ""), F.struct(*(v.alias(k) for k, v in parts.items())))


def _with_layouts(rows: DataFrame) -> DataFrame:
    """Blocks with what they show in each layout: names linked within bold text (a); a subtitle in brackets (b); a bold paragraph with links (c); one without (d).

    Each place and text is a column that later ones name, so that it is found once for a block.
    """
    kinds, bolds, texts, n = F.col("pieces.kind"), F.col("pieces.bold"), F.col("pieces.text"), F.size("pieces")
    place = lambda array, x: F.array_position(array, F.lit(x)).cast("int")
    one, two, low, high = (F.col(c) for c in ("__one", "__two", "__low", "__high"))  # from 1: links, first and last bold piece
    rows = rows.withColumns({"__one": place(kinds, "link"), "__low": place(bolds, True), "__high": n + 1 - place(F.reverse(bolds), True)})
    rows = rows.withColumn("__next", F.when(one > 0, place(F.slice(kinds, one + 1, n), "link")).otherwise(0))
    rows = rows.withColumn("__two", F.when(F.col("__next") > 0, one + F.col("__next")))
    rows = rows.withColumn("__linked", F.coalesce((F.col("tag") == "p") & (place(F.slice(kinds, two + 1, n), "link") == 0), F.lit(False)))
    # the pieces between two of them
    between = lambda a, b: F.trim(F.regexp_replace(F.array_join(F.slice(texts, a + 1, F.greatest(b - a - 1, F.lit(0))), ""), "[ \\n]+", " "))
    start, end, none = F.lit(0), n + 1, F.lit(None).cast("string")
    found = lambda fits, **parts: F.when(fits, F.struct(*(v.alias(k) for k, v in parts.items())))
    text = lambda k: F.element_at(texts, k)
    line = F.regexp_replace("text", "\\n", " ")
    of_old, of_plain = (lambda k: F.regexp_extract("text", OLD, k)), (lambda k: F.regexp_extract(line, PLAIN, k))
    linked, bold = F.col("__linked"), F.col("bold")
    rows = rows.withColumns(
        {
            "__a": found(linked & ~bold & F.element_at(bolds, one) & F.element_at(bolds, two), rule=between(start, low), a=text(one), b=text(two), mark_a=between(low - 1, one), mark_b=between(two, high + 1), method=between(high, end)),
            "__b": found((F.col("tag") == "h3") & F.col("css").contains(TITLE_HEADING) & F.col("text").rlike(OLD), rule=none, a=of_old(2), b=of_old(4), mark_a=of_old(1), mark_b=of_old(5), method=of_old(3)),
            "__c": found(linked & bold, rule=F.lit(""), a=text(one), b=text(two), mark_a=between(start, one), mark_b=none, method=between(two, end)),
            "__d": found((F.col("tag") == "p") & bold & (one == 0) & line.rlike(PLAIN), rule=none, a=of_plain(2), b=of_plain(4), mark_a=F.nullif(of_plain(1), F.lit("")), mark_b=F.nullif(of_plain(5), F.lit("")), method=of_plain(3)),
        }
    )
    behind = F.col("__c.method")
    of_c = {"mark_b": F.nullif(F.regexp_extract(behind, BEHIND, 1), F.lit("")), "method": F.regexp_replace(behind, BEHIND, "")}
    shown = {}
    for k in LAYOUTS:
        x = F.col(f"__{k}")
        parts = {c: x[c] for c in ("rule", "a", "b", "mark_a", "mark_b", "method")} | (of_c if k == "c" else {})
        shown[f"layout_{k}"] = _bout(parts["rule"], parts["a"], parts["b"], _mark(parts["mark_a"]), _mark(parts["mark_b"]), parts["method"], x.isNotNull())
    return rows.withColumns(shown)


def bouts(rows: DataFrame, key: str) -> DataFrame:
    """The bout of each section: the first block that fits layout a, else b, c or d; a rule in brackets may stand in a block of its own."""
    # headings, and paragraphs that can be a bout or a rule; what they show is told before rows move, without their pieces
    is_heading = F.col("tag").isin("h2", "h3") & (F.col("css").contains(SECTION_HEADING) | F.col("css").contains(TITLE_HEADING))
    may_show = (F.col("tag") == "p") & (F.col("bold") | F.col("text").contains("［") | F.exists("pieces", lambda p: p["kind"] == "link"))
    rule = F.when(F.col("tag") == "p", F.nullif(F.regexp_extract("text", BRACKETED, 1), F.lit("")))
    slim = _with_layouts(rows.where(is_heading | may_show)).select(key, "n", "tag", "css", F.when(is_heading, F.col("text")).alias("text"), *(f"layout_{k}" for k in LAYOUTS), rule.alias("rule"))
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("n")))
    found = sections(slim, key).groupBy(key, "part", "title", "heading").agg(*(first(f"layout_{k}").alias(k) for k in LAYOUTS), first("rule").alias("bracketed"))
    bout, layout = F.coalesce(*LAYOUTS), F.coalesce(*(F.when(F.col(k).isNotNull(), k) for k in LAYOUTS))
    found = found.select(key, "part", "title", "heading", "bracketed", bout.alias("x"), layout.alias("layout")).where("x is not null")
    return found.select(key, "part", "title", "heading", "layout", F.coalesce("x.rule", "bracketed", F.lit("")).alias("rule"), "x.a", "x.b", "x.mark_a", "x.mark_b", "x.method")


# The same in Python, with what Java takes for a letter, a space, a line's character and an end.
_ANY, _END = "[^\\n\\r\\x85\\u2028\\u2029]", "(?=(?:\\r\\n|[\\n\\r\\x85\\u2028\\u2029])?\\Z)"


def _java(form: str) -> re.Pattern:
    form = form.replace(rf"[{SPACE}\S]", r"[\s\S]")  # Java has sets within sets
    return re.compile(re.sub(r"(?<!\\)\.", lambda _: _ANY, form).replace("$", _END), re.ASCII)


_OLD, _PLAIN = _java(OLD), _java(PLAIN)
_BRACKETED, _BEHIND = _java(BRACKETED), _java(BEHIND)
_BREAKS = re.compile("[ \\n]+")


def _marked(text: str | None) -> str | None:
    if text is None:
        return None
    up = text.upper()
    return "WIN" if "WIN" in up else "LOSE" if "LOSE" in up else "NC" if "-" in text else None


def _layout(tag: str, css: str, bold: bool, pieces: list[tuple[str, bool, str]], text: str, links: list[int]) -> tuple | None:
    """Layout, rule, sides, marks and method of a block, as in _with_layouts; no block fits two layouts."""
    mark_b: str | None
    if tag == "h3":
        m = _OLD.match(text) if TITLE_HEADING in css else None
        if not m:
            return None
        layout, rule, (mark_a, a, method, b, mark_b) = "b", None, m.groups()
    elif len(links) == 2:
        one, two = links
        texts = [t for _, _, t in pieces]
        between = lambda low, high: _BREAKS.sub(" ", "".join(texts[low:high])).strip(" ")
        a, b = texts[one], texts[two]
        if bold:
            behind = between(two + 1, None)
            m = _BEHIND.match(behind)
            layout, rule, mark_a, mark_b, method = "c", "", between(0, one), m[1] if m else None, behind[m.end() :] if m else behind
        elif pieces[one][1] and pieces[two][1]:
            strong = [k for k, p in enumerate(pieces) if p[1]]
            low, high = strong[0], strong[-1] + 1
            layout, rule, mark_a, mark_b, method = "a", between(0, low), between(low, one), between(two + 1, high), between(high, None)
        else:
            return None
    elif bold and not links:
        m = _PLAIN.match(text.replace("\n", " "))
        if not m:
            return None
        layout, rule, (mark_a, a, method, b, mark_b) = "d", None, m.groups()
    else:
        return None
    a, b = a.strip(" "), b.strip(" ")
    return (layout, rule, a, b, _marked(mark_a), _marked(mark_b), method.strip(" ")) if a and b else None


def bouts_of(rows: list[tuple]) -> list[tuple]:
    """The bouts of one page's blocks: part, title, heading, layout, rule, sides, marks and method."""
    # heading, title and section marks, bracketed rule and bout of each block that counts
    slim = []
    parts = 0
    titles: dict[int, int] = {}
    for _, tag, _, _, _, css, bold, pieces, text in rows:
        rule = is_h2 = is_h3 = is_title = None
        if tag == "p":
            links = [k for k, p in enumerate(pieces) if p[0] == "link"] if len(pieces) > 1 or pieces[0][0] == "link" else []
            bracket = "［" in text
            if not (bold or links or bracket):
                continue
            m = _BRACKETED.match(text) if bracket else None
            rule = m[1] or None if m else None
        elif tag in ("h2", "h3") and (SECTION_HEADING in css or TITLE_HEADING in css):
            links = []
            is_h2, is_h3 = tag == "h2" and SECTION_HEADING in css, tag == "h3" and TITLE_HEADING in css
            is_title = is_h3 and not text.startswith("[")
        else:
            continue
        parts += bool(is_h2)
        titles[parts] = titles.get(parts, 0) + bool(is_title)
        slim.append((parts, titles[parts], text, is_h2, is_h3, rule, _layout(tag, css, bold, pieces, text, links) if tag != "h2" else None))
    found: dict[tuple[int, int], dict] = {}
    for part, title, text, is_h2, is_h3, rule, bout in slim:
        if (part == 0 and parts) or (titles[part] > 1 and title == 0):
            continue
        first = found.setdefault((part, title if titles[part] > 1 else 0), {})
        if is_h2:
            first.setdefault("h2", text)
        if is_h3:
            first.setdefault("h3", text)
        if rule is not None:
            first.setdefault("rule", rule)
        if bout:
            first.setdefault(bout[0], bout)
    out = []
    for (part, title), first in found.items():
        if bout := next((first[k] for k in LAYOUTS if k in first), None):
            layout, rule, *rest = bout
            out.append((part, title, first.get("h2", first.get("h3", "")), layout, rule if rule is not None else first.get("rule", ""), *rest))
    return out


_LOOSE, _JUNK, _TOLD = _java(LOOSE), _java(JUNK), re.compile(TOLD)


def recovered_of(rows: list[tuple]) -> list[tuple]:
    """Bouts that only loose paragraphs of a page show, as in recovered: sides, marks and method."""
    seen = {tuple(sorted(x[5:7])) for x in bouts_of(rows)}
    out = []
    for _, tag, _, _, _, css, _, _, text in rows:
        if tag == "p" and LOOSE_PARAGRAPH in css and len(text) <= MAX_LOOSE and (m := _LOOSE.match(text.replace("\n", " "))):
            mark_a, a, mark_b, b, method = m[1], m[2].strip(" "), m[3], m[4].strip(" "), m[5].strip(" ")
            if _JUNK.search(a) or _JUNK.search(b) or not (mark_a or mark_b or _TOLD.search(method)):
                continue
            pair = (a, b) if a <= b else (b, a)
            if pair not in seen:
                seen.add(pair)
                out.append((a, b, mark_a, mark_b, method))
    return out


def _of_pages(pages: DataFrame, key: str, html: str, of, schema: str) -> DataFrame:
    """What a function tells of each page's blocks, under the page's key."""
    kind = pages.schema[key].dataType.simpleString()
    names = [key, *(f.split()[0] for f in schema.split(", "))]
    types = [pa.int64() if f.endswith(" long") else pa.string() for f in schema.split(", ")]

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats: list[int] = []
            rows: list[tuple] = []
            for at in range(batch.num_rows):
                found = of(page_rows(batch.column(1)[at].as_py() or "", False))
                ats += [at] * len(found)
                rows += found
                if rows and (len(rows) >= ROWS or at == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ats)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)
                    ats, rows = [], []

    return pages.select(key, F.col(html).cast("string")).mapInArrow(tell, f"`{key}` {kind}, {schema}")


def page_bouts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The bouts of pages, each a row with its own key: bouts of blocks of it, with nothing moved."""
    return _of_pages(pages, key, html, bouts_of, "part long, title long, heading string, layout string, rule string, a string, b string, mark_a string, mark_b string, method string")


def page_recovered(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The bouts that recovered gives of pages' blocks and bouts, with nothing moved."""
    return _of_pages(pages, key, html, recovered_of, "a string, b string, mark_a string, mark_b string, method string")


def _pair(a: str, b: str) -> Column:
    return F.array_sort(F.array(a, b))


def recovered(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Bouts in loose paragraphs, ``○ A（gym）vs × B（gym） method``, whose pair is not known on that page.

    Left out as junk: long paragraphs, names that are a mark, a heading, a bracket or a method, and lines with neither mark nor method.
    """
    line = F.regexp_replace("text", "\\n", " ")
    part = lambda k: F.regexp_extract(line, LOOSE, k)
    loose = rows.where((F.col("tag") == "p") & F.col("css").contains(LOOSE_PARAGRAPH) & (F.char_length("text") <= MAX_LOOSE) & line.rlike(LOOSE))
    found = loose.select(key, "n", part(1).alias("mark_a"), F.trim(part(2)).alias("a"), part(3).alias("mark_b"), F.trim(part(4)).alias("b"), F.trim(part(5)).alias("method"))
    told = (F.col("mark_a") != "") | (F.col("mark_b") != "") | F.col("method").rlike(TOLD)
    good = found.where(~F.col("a").rlike(JUNK) & ~F.col("b").rlike(JUNK) & told).withColumn("pair", _pair("a", "b"))
    once = good.withColumn("k", F.row_number().over(Window.partitionBy(key, "pair").orderBy("n"))).where("k = 1")
    return once.join(known.select(key, _pair("a", "b").alias("pair")), [key, "pair"], "left_anti").select(key, "a", "b", "mark_a", "mark_b", "method")


def calendar(rows: DataFrame, key: str) -> DataFrame:
    """Dated lines of a calendar, ``2024年5月6日(月) title @ venue`` or with dots, slashes or dashes: date, title and venue of each."""
    form = r"^\s*(\d{4}\s*[年./-]\s*\d{1,2}\s*[月./-]\s*\d{1,2})日?\s*(?:[（(][^）)]{1,6}[）)])?\s*(.+?)\s*(?:[@＠]\s*(.+?)\s*)?$".replace(r"\s", SPACE)
    part = lambda k: F.regexp_extract("text", form, k)
    # a line's parts and its date are exploded, so that what follows names what is found once
    explode = lambda *c: F.explode(F.array(F.struct(*c))).alias("x")
    lines = rows.where(F.col("text").rlike(rf"^{SPACE}*\d{{4}}")).select(key, "n", F.translate("text", "\n", " ").alias("text"))
    told = lines.select(key, "n", explode(part(1).alias("day"), part(2).alias("title"), part(3).alias("venue"))).select(key, "n", "x.*").where("day <> ''")
    dated = told.select(key, "n", explode(F.regexp_replace("day", r"\D+", "-").try_cast("date").alias("date")), "title", "venue")
    return dated.select(key, "n", "x.date", "title", F.nullif("venue", F.lit("")).alias("venue")).where("date is not null")
