"""Feed rows, posts and reports, and sinks that act once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import classify, headlines
from ..functions.dates import parsed_or_now


def feed_rows(items: DataFrame, origin: str, now: Column) -> DataFrame:
    """items (source, title, link, date, ord) as feed rows; what lacks a title or link goes, and a date that is none counts as now."""
    good = items.where("coalesce(title, '') <> '' and coalesce(link, '') <> ''")
    return good.select(F.concat(F.col("source"), F.lit("-"), F.col("ord").cast("string")).alias("id"), "source", "title", F.lit(origin).alias("origin"), F.col("link").alias("url"), parsed_or_now(F.col("date"), now).alias("published"))


def classified(rows: DataFrame, now: Column) -> DataFrame:
    """Feed rows (title, source, published, first_seen, override) with kind, news type and whether they are flash news."""
    kind = classify.article_kind(F.col("source"))
    typed = rows.withColumns({"kind": kind, "news_type": classify.news_type(F.col("title"))})
    return typed.withColumn("flash", classify.is_flash(F.col("kind"), F.col("news_type"), F.coalesce("first_seen", "published"), F.col("override"), now))


def accepted(sources: dict[str, DataFrame], filtered: set[str]) -> DataFrame:
    """Rows of several feeds with their source's name; those named in filtered pass only headlines about the sport."""
    out = None
    for name, rows in sources.items():
        own = rows.where(classify.is_mma(F.col("title"))) if name in filtered else rows
        own = own.withColumn("source", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def tolerant_union(sources: dict[str, DataFrame | None]) -> tuple[DataFrame, list[str]]:
    """The union of the sources that could be read, and the names of those that couldn't."""
    failed = sorted(name for name, rows in sources.items() if rows is None)
    found = [rows.withColumn("source", F.lit(name)) for name, rows in sources.items() if rows is not None]
    if not found:
        raise ValueError("no source could be read")
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows, allowMissingColumns=True)
    return out, failed


def posts(topics: DataFrame, by: str, most: int = 138) -> DataFrame:
    """One post for each group of topics (by, title, source, place): shortened lines in order, with hashtags, cut to fit."""
    rows = F.array_sort(F.collect_list(F.struct("place", "title", "source")))
    grouped = topics.groupBy(by).agg(rows.alias("t"))
    titles, sources = F.transform("t", lambda x: x["title"]), F.transform("t", lambda x: x["source"])
    lines = F.transform(titles, lambda t: F.concat(F.lit("・"), headlines.without_label(t)))
    return grouped.select(by, headlines.lines_that_fit(lines, headlines.hashtags(titles, sources), most).alias("text"))


def unposted(rows: DataFrame, posted: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been posted, one of each."""
    return rows.join(posted.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def post_once(rows: DataFrame, path: str, key: str, send: Callable[[Row], None]) -> int:
    """Write rows whose key no batch under path has as a new batch, then send that batch; a repeated run sends nothing again.

    The batch is written before its rows are sent, so after a run that failed between the two a row may not have
    been sent. A task that Spark repeats sends its rows again, so send should take a key it has had as sent.
    """
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    before = spark.read.schema(rows.schema).parquet(f"{path}/*") if there else spark.createDataFrame([], rows.schema)
    batch = f"{path}/{uuid.uuid4().hex}"
    unposted(rows, before, key).write.parquet(batch)
    new = spark.read.schema(rows.schema).parquet(batch)
    new.foreachPartition(lambda part: [send(r) for r in part])
    return new.count()


def markdown(rows: DataFrame, title: str, columns: list[str], order: list[str]) -> DataFrame:
    """A table in Markdown as lines with their numbers: a heading, the columns, a line for each row in order."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns]
    body = rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"), *order)
    numbered = body.select((F.row_number().over(Window.orderBy(*order)) + 3).alias("n"), "line")  # a report is short
    head = [(1, f"# {title}"), (2, "| " + " | ".join(columns) + " |"), (3, "|" + " --- |" * len(columns))]
    return rows.sparkSession.createDataFrame(head, "n int, line string").unionByName(numbered)


def event_lines(events: DataFrame) -> DataFrame:
    """events (event, day, venue, place, a, b, winner, method) as one line for each, from the first bout on its list."""
    w = Window.partitionBy("event")
    first = events.withColumn("__n", F.count("*").over(w)).withColumn("__p", F.row_number().over(w.orderBy("place"))).where("__p = 1")
    return first.select("event", headlines.event_summary(F.col("event"), F.col("day"), F.col("venue"), F.col("__n"), F.col("a"), F.col("b"), F.col("winner"), F.col("method")).alias("line"))


def upcoming(events: DataFrame) -> DataFrame:
    """Events to come or under way, soonest first."""
    return events.where(F.col("status").isin("upcoming", "live")).orderBy("date", "event")
