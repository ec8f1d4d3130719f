"""Streams of rows with event time: dedupe, windows, first sightings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.lineage import shared_folder


def source(spark: SparkSession, folder: str, files: str, schema: StructType) -> DataFrame:
    """Parquet files of a folder as a stream, some at a time."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", 8).parquet(folder)


def deduped(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, at: str, late: str, width: str, *by: str, shift: str = "0 seconds") -> DataFrame:
    """Counts per window and group, each given out once the watermark has passed the window's end."""
    windowed = stream.withWatermark(at, late).groupBy(F.window(at, width, startTime=shift).alias("w"), *by)
    return windowed.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def first_seen(stream: DataFrame, key: str, at: str) -> DataFrame:
    """When each key was first seen; for update or complete output."""
    return stream.groupBy(key).agg(F.min(at).alias("first_seen"), F.count("*").alias("times"))


def sliding(stream: DataFrame, at: str, late: str, width: str, step: str, *by: str) -> DataFrame:
    """Counts per overlapping window and group."""
    windowed = stream.withWatermark(at, late).groupBy(F.window(at, width, step).alias("w"), *by)
    return windowed.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def joined(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, late: str, within: str) -> DataFrame:
    """Rows of two streams with one key, the right one's time in the interval after the left one's; state ends with the watermarks."""
    a = left.withWatermark(left_at, late)
    b = right.withWatermark(right_at, late).withColumnRenamed(key, f"right_{key}")
    close = (F.col(right_at) >= F.col(left_at)) & (F.col(right_at) <= F.col(left_at) + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(key) == F.col(f"right_{key}")) & close).drop(f"right_{key}")


def split_late(rows: DataFrame, at: str, now) -> tuple[DataFrame, DataFrame]:
    """Rows up to now, and those without a time or with one to come."""
    good = F.col(at).isNotNull() & (F.col(at) <= now)
    return rows.where(good), rows.where(~good | good.isNull())


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Run what there is to append-only Parquet in the shared folder, and read that."""
    spark = stream.sparkSession
    out = shared_folder(spark, name)
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_complete(stream: DataFrame, name: str, each: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Run what there is; every batch's whole result replaces the one before."""
    spark = stream.sparkSession
    out = shared_folder(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{out}/{number}")
        last.append(number)

    last: list[int] = []
    stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/{last[-1]}")
