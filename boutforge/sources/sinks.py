"""Snapshots, guarded promotion and change stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Versions, stamp  # noqa: F401


def write_snapshot(rows: DataFrame, folder: str, date: str, changed: bool) -> None:
    """A new version of the snapshot, kept as that date's where something changed; earlier ones stay readable."""
    Versions(rows.sparkSession, folder).write(rows, day=date if changed else None)


def promote(fresh: DataFrame, folder: str, least: float = 0.5) -> bool:
    """A new version of fresh rows unless they are at most half of the last version's."""
    return Versions(fresh.sparkSession, folder).promote(fresh, least)


def serve_by_key(rows: DataFrame, key: str, folder: str, buckets: int = 64) -> None:
    """Rows laid out for look-ups by key: a hash bucket is a folder, so the number of files stays bounded."""
    rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition(buckets, "bucket").sortWithinPartitions(key).write.mode("overwrite").partitionBy("bucket").parquet(folder)


def served(spark: SparkSession, folder: str, key: str, value, buckets: int = 64) -> DataFrame:
    rows = spark.read.parquet(folder)
    wanted = F.pmod(F.xxhash64(F.lit(value).cast(rows.schema[key].dataType)), F.lit(buckets)).cast("int")
    bucket = spark.range(1).select(wanted.alias("b")).first()[0]
    return rows.where((F.col("bucket") == bucket) & (F.col(key) == value))
