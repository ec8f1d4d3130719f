"""Gates over tables: each gives the rows or the figures that speak against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(name: str, rows: DataFrame, most: int = 0) -> DataFrame:
    """One row: how many violations there are and whether that is at most the baseline."""
    return rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("gate"), "violations", (F.col("violations") <= most).alias("passed"))


def ratio(name: str, rows: DataFrame, bad: Column, most: float) -> DataFrame:
    share = F.avg(bad.cast("double"))
    return rows.agg(F.round(share, 6).alias("ratio")).select(F.lit(name).alias("gate"), "ratio", (F.coalesce("ratio", F.lit(0.0)) <= most).alias("passed"))


def orphans(rows: DataFrame, dimension: DataFrame, key: str, other: str) -> DataFrame:
    """Rows whose key the dimension lacks; a null key refers to nothing."""
    keys = dimension.select(F.col(other).alias("__k")).distinct()
    return rows.where(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("__k"), "left_anti")


def unaccepted(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull() & ~F.col(column).rlike(pattern))


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two tables of the same columns has, as often as it has them more."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def inconsistent(detail: DataFrame, stated: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose stated value isn't the detail's count."""
    counted = detail.groupBy(key).agg(F.count("*").alias("counted"))
    return stated.join(counted, key, "full").withColumns({"counted": F.coalesce("counted", F.lit(0)), value: F.coalesce(value, F.lit(0))}).where(F.col("counted") != F.col(value))


def contradictions(sides: DataFrame) -> DataFrame:
    """Bouts that both sides won, or both lost."""
    return sides.groupBy("bout_id").agg(F.count(F.when(F.col("result") == "win", 1)).alias("wins"), F.count(F.when(F.col("result") == "loss", 1)).alias("losses")).where("wins > 1 or losses > 1")


def coverage(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Keys of which another source has more than we do, and by how many."""
    o = ours.groupBy(key).agg(F.count("*").alias("ours"))
    t = theirs.groupBy(key).agg(F.count("*").alias("theirs"))
    return t.join(o, key, "left").withColumn("ours", F.coalesce("ours", F.lit(0))).where("theirs > ours").withColumn("missing", F.col("theirs") - F.col("ours"))


def drifted(registry: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Registered manual edits (keys, field, value) that the rows (keys, and a column for each field) no longer show.

    The value that is there now is beside it; null where the row is gone.
    """
    fields = [c for c in rows.columns if c not in keys]
    told = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("now")) for c in fields))).alias("f")).select(*keys, "f.*")
    return registry.join(told, [*keys, "field"], "left").where(~F.col("value").eqNullSafe(F.col("now")))


def stale(rows: DataFrame, resolved: str, fresh: str) -> DataFrame:
    """Rows whose stored resolution is not what resolving them now gives."""
    return rows.where(~F.col(resolved).eqNullSafe(F.col(fresh)))


def unresolved_variants(rows: DataFrame, known: DataFrame, name: str, variants: dict[str, str]) -> DataFrame:
    """Names that no key matches as written, but one does once variant characters are unified."""
    plain = lambda c: F.translate(c, "".join(variants), "".join(variants.values()))
    keys = known.select(F.col(known.columns[0]).alias("__k")).distinct()
    open_ = rows.join(keys, F.col(name) == F.col("__k"), "left_anti")
    return open_.join(keys.select(plain(F.col("__k")).alias("__p")).distinct(), plain(F.col(name)) == F.col("__p"), "left_semi")


def volume(name: str, rows: DataFrame, least: int, most: int) -> DataFrame:
    """One row: whether a scrape brought a plausible number of rows."""
    return rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("gate"), "rows", F.col("rows").between(least, most).alias("passed"))


def may_run(jobs: DataFrame, name: str, now: Column, *, frozen: bool, lease_minutes: int = 60) -> DataFrame:
    """One row: whether a job may start. Not while frozen, nor while a run of the same name holds its lease, nor
    where the register of runs (name, state, started) is empty, which says nothing is known."""
    held = (F.col("name") == name) & (F.col("state") == "running") & (F.unix_timestamp(now) - F.unix_timestamp("started") < lease_minutes * 60)
    told = jobs.agg(F.count("*").alias("known"), F.count(F.when(held, 1)).alias("running"))
    return told.select(F.lit(name).alias("job"), "running", (~F.lit(frozen) & (F.col("known") > 0) & (F.col("running") == 0)).alias("may_run"))
