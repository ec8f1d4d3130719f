"""RSS and Atom documents, HTML tables and JSON files as rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions.markup import decoded

ROWS = 4096  # of an Arrow batch
_BRACES, _BRACKETS_OR_BAR = re.compile(r"\{\{|\}\}"), re.compile(r"\{\{|\[\[|\}\}|\]\]|\|")


def _inner(item: Column, tag: str) -> Column:
    raw = F.regexp_extract(item, f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>", 1)
    return F.trim(decoded(F.regexp_replace(F.regexp_replace(raw, "(?s)^\\s*<!\\[CDATA\\[(.*)\\]\\]>\\s*$", "$1"), "<[^>]*>", "")))


def _times(text: Column) -> Column:
    """Times of the feeds' usual forms; null for any other."""
    plain = F.regexp_replace(text, "^[A-Za-z]{3},\\s*", "")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(text), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss z")))


def rss(documents: DataFrame, xml: str) -> DataFrame:
    """The items of RSS 2.0 documents with their place in the document."""
    items = documents.select(*[c for c in documents.columns if c != xml], F.posexplode(F.regexp_extract_all(F.col(xml), F.lit("(?is)<item[\\s>].*?</item>"), 0)).alias("place", "__item"))
    item = F.col("__item")
    return items.withColumns({"title": _inner(item, "title"), "link": _inner(item, "link"), "published": _times(F.coalesce(F.nullif(_inner(item, "pubDate"), F.lit("")), _inner(item, "dc:date"))), "summary": _inner(item, "description")}).drop("__item")


def atom(documents: DataFrame, xml: str) -> DataFrame:
    """The entries of Atom documents; the alternate link is preferred, then published, issued or updated."""
    items = documents.select(*[c for c in documents.columns if c != xml], F.posexplode(F.regexp_extract_all(F.col(xml), F.lit("(?is)<entry[\\s>].*?</entry>"), 0)).alias("place", "__item"))
    item = F.col("__item")
    tags = F.regexp_extract_all(item, F.lit("(?is)<link\\s[^>]*>"), 0)
    href = lambda t: F.regexp_extract(t, '(?i)href="([^"]*)"', 1)
    alternate = F.filter(tags, lambda t: t.rlike('(?i)rel="alternate"'))
    link = F.coalesce(F.try_element_at(F.transform(alternate, href), F.lit(1)), F.try_element_at(F.transform(tags, href), F.lit(1)))
    at = F.coalesce(*(F.nullif(_inner(item, t), F.lit("")) for t in ("published", "issued", "updated")))
    return items.withColumns({"title": _inner(item, "title"), "link": link, "published": _times(at), "summary": _inner(item, "summary")}).drop("__item")


def table_rows(pages: DataFrame, html: str) -> DataFrame:
    """Cells of the rows of all tables in pages, with their places; a table may carry attributes."""
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(F.regexp_extract_all(F.col(html), F.lit("(?is)<tr[\\s>].*?</tr>"), 0)).alias("row", "__row"))
    cells = F.transform(F.regexp_extract_all("__row", F.lit("(?is)<t[dh](?:\\s[^>]*)?>(.*?)</t[dh]>"), 1), lambda c: F.trim(decoded(F.regexp_replace(c, "<[^>]*>", ""))))
    return rows.withColumn("cells", cells).drop("__row")


def balanced_blocks_of(text: str, opening: str) -> list[str]:
    """The blocks ``{{name ...}}`` of a wiki text, with what is nested in them."""
    out, at = [], text.find(opening)
    while at >= 0:
        depth, i = 0, len(text)
        for brace in _BRACES.finditer(text, at):
            depth += 1 if brace[0] == "{{" else -1
            if depth == 0:
                i = brace.end()
                break
        out.append(text[at:i])
        at = text.find(opening, i)
    return out


def balanced_blocks(text: Column, opening: str) -> Column:
    @F.pandas_udf(ArrayType(StringType()))
    def find(s: pd.Series) -> pd.Series:
        return s.map(lambda x: balanced_blocks_of(x, opening), na_action="ignore")

    return find(text)


def params_of(block: str) -> list[str]:
    """A template's parameters: split at bars outside nested templates and links."""
    out, depth, last = [], 0, 0
    body = block[2:-2] if block.startswith("{{") else block
    for mark in _BRACKETS_OR_BAR.finditer(body):
        if mark[0] != "|":
            depth += 1 if mark[0] in ("{{", "[[") else -1
        elif depth == 0:
            out.append(body[last : mark.start()].strip())
            last = mark.end()
    return [*out, body[last:].strip()]


def templates(pages: DataFrame, text: str, opening: str, without: list[str]) -> DataFrame:
    """The blocks ``{{name ...}}`` of each text with their place and parameters p; what fits one of without goes first.

    Texts are gone through once, by one worker for a task, which holds an Arrow batch and the blocks of some thousand
    rows.
    """
    keep = [c for c in pages.columns if c != text]
    gone = [re.compile(w) for w in without]
    kinds = [*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep), "place int", "p array<string>"]

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, texts = batch.select(keep), batch.column(len(keep))
            rows: list[int] = []
            places: list[int] = []
            params: list[list[str]] = []
            for at in range(batch.num_rows):
                for place, block in enumerate(balanced_blocks_of(texts[at].as_py() or "", opening)):
                    rows.append(at)
                    places.append(place)
                    params.append(params_of(reduce(lambda t, w: w.sub("", t), gone, block)))
                if rows and (len(rows) >= ROWS or at == batch.num_rows - 1):
                    own = known.take(pa.array(rows)).columns
                    yield pa.RecordBatch.from_arrays([*own, pa.array(places, pa.int32()), pa.array(params, pa.list_(pa.string()))], names=[*keep, "place", "p"])
                    rows, places, params = [], [], []

    return pages.select(*keep, F.col(text).cast("string")).mapInArrow(find, ", ".join(kinds))


@F.pandas_udf(StringType())
def shift_jis(s: pd.Series) -> pd.Series:
    """Bytes in Shift_JIS as text, which Spark's decode() doesn't offer."""
    return s.map(lambda b: bytes(b).decode("shift_jis", "replace"), na_action="ignore")


def json_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON file's rows; an empty table where it is missing or broken."""
    try:
        rows = spark.read.schema(StructType([*schema.fields])).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
        rows.limit(1).count()
        return rows
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def csv_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV file's rows; ragged ones are dropped."""
    return spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(path)
