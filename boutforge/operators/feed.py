"""News: dedupe by link, scores, clusters, limits and the archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by_link(rows: DataFrame, link: str, order: list[Column]) -> DataFrame:
    """One row for each link: the first in order, such as live ones before archived ones."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(link).orderBy(*order))).where("__n = 1").drop("__n")


def impact(text: Column, weights: dict[str, float], length: Column | None = None) -> Column:
    """The sum of the weights of all patterns that a title matches."""
    total = F.lit(0.0)
    for pattern, weight in weights.items():
        total = total + F.when(text.rlike(pattern), weight).otherwise(0.0)
    return total if length is None else total - F.when(length > 60, 1.0).otherwise(0.0)


def clusters(rows: DataFrame, tag: str, score: str, title: str, key: str, bonus: float = 1.0) -> DataFrame:
    """One topic for each tag: its best row, with a bonus for each further row."""
    best = F.max_by(F.struct(F.col(key), F.col(title)), F.struct(F.col(score), F.char_length(title), -F.col(key)))
    return rows.groupBy(tag).agg(best.alias("best"), F.max(score).alias("top"), F.count("*").alias("size")).select(tag, "best.*", "size", (F.col("top") + bonus * (F.col("size") - 1)).alias("score"))


def digest(topics: DataFrame, order: list[Column], *, good: float, least: float, enough: int, cap: int) -> DataFrame:
    """Topics of a good score, filled up with lesser ones where they are fewer than enough, at most cap."""
    best = topics.where(F.col("score") >= least).orderBy(F.desc("score"), *order).limit(cap)
    w = Window.orderBy(F.desc("score"), *order)
    n = F.sum(F.when(F.col("score") >= good, 1).otherwise(0)).over(Window.partitionBy())
    return best.withColumns({"place": F.row_number().over(w), "__good": n}).where((F.col("score") >= good) | ((F.col("__good") < enough) & (F.col("place") <= enough))).drop("__good")


def archived(archive: DataFrame, fresh: DataFrame, link: str, at: str, now: Column, cap: int) -> DataFrame:
    """The archive with new links stamped as first seen now, newest first, at most cap."""
    new = fresh.join(archive, link, "left_anti").withColumn("first_seen", now)
    return archive.unionByName(new, allowMissingColumns=True).orderBy(F.desc(at), link).limit(cap)


def nearest(rows: DataFrame, days: Column, tie: str) -> DataFrame:
    """The row nearest to today; of one past and one to come as near, the one to come."""
    return rows.withColumn("days", days).orderBy(F.abs("days"), F.desc("days"), tie).limit(1)
