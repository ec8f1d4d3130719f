"""The supplied tables seen as bouts, titles and news.

A line item is a bout between the customer of its order and its supplier; the order's priority is the
division. ``SQL`` has the same views for other engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bouts import two_sided

AS_OF = "2001-12-31"

BOUTS_SQL = """WITH bouts AS (
  SELECT (l_orderkey * 8 + l_linenumber) * 10000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS bout_id, CAST(l_shipdate AS DATE) AS date,
    'C' || o_custkey AS a, 'S' || l_suppkey AS b,
    CASE WHEN l_tax > 0.075 THEN NULL WHEN l_returnflag = 'A' THEN CAST(1 AS DOUBLE) WHEN l_returnflag = 'R' THEN CAST(0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS score_a,
    l_linestatus = 'F' AS finish, o_orderpriority AS division, 'org' || (l_suppkey % 4) AS org,
    CASE WHEN l_linestatus = 'F' AND l_quantity < 25 THEN 'ko' WHEN l_linestatus = 'F' THEN 'sub' ELSE 'decision' END AS kind,
    l_linenumber = 7 AS opener, l_quantity AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sides AS (
  SELECT a AS fighter, b AS opponent, CASE WHEN score_a = 1 THEN 'win' WHEN score_a = 0 THEN 'loss' WHEN score_a = 0.5 THEN 'draw' ELSE 'nc' END AS result, bout_id, date, division, org, kind, opener, quantity, finish FROM bouts
  UNION ALL
  SELECT b, a, CASE WHEN score_a = 0 THEN 'win' WHEN score_a = 1 THEN 'loss' WHEN score_a = 0.5 THEN 'draw' ELSE 'nc' END, bout_id, date, division, org, kind, opener, quantity, finish FROM bouts)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS = 400_000  # of a task, about


def tasks_for(rows: DataFrame, times: int = 1) -> int:
    """A number of tasks that grows with the rows (times as many as a table's files hold): at least what the cluster runs at once."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * times // ROWS))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """A table's rows brought together by keys, in tasks none of which holds many."""
    return rows.repartition(tasks_for(rows), *keys)


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    score = F.when(F.col("l_tax") > 0.075, F.lit(None).cast("double")).when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "R", 0.0).otherwise(0.5)
    finish = F.col("l_linestatus") == "F"
    return items.select(
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10000000000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("bout_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.concat(F.lit("C"), "o_custkey").alias("a"),
        F.concat(F.lit("S"), "l_suppkey").alias("b"),
        score.alias("score_a"),
        finish.alias("finish"),
        F.col("o_orderpriority").alias("division"),
        F.concat(F.lit("org"), F.col("l_suppkey") % 4).alias("org"),
        F.when(finish & (F.col("l_quantity") < 25), "ko").when(finish, "sub").otherwise("decision").alias("kind"),
        (F.col("l_linenumber") == 7).alias("opener"),
        F.col("l_quantity").alias("quantity"),
    )


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_sided(bouts(spark, sf_dir), "bout_id", "date", "division", "org", "kind", "opener", "quantity", "finish")


def dealt_sides(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Sides brought together by keys, in tasks none of which holds many."""
    return sides(spark, sf_dir).repartition(tasks_for(table(spark, sf_dir, "lineitem"), 2), *keys)
