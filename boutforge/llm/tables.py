"""Shared helpers: the input tables, the shared folder, and tables that cut lineage."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings while a stored table is made: shuffle files go with their job, and a batch that goes to a
#: Python worker holds few rows, as texts and sets may be long.
WHILE_STORED = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares; without that setting (tests), one under the warehouse."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def local_path(uri: str) -> str:
    """The path under which workers open a shared folder; it has to be mounted on every machine."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri}: memory-mapped tables need a shared folder that is mounted as a file system")
    return str(Path(uri))


def stored(df: DataFrame, *, folder: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: short lineage that outlives any executor."""
    spark = df.sparkSession
    path = folder or shared_dir(spark)
    with shuffle_files_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffle_files_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs in this block give back their shuffle files when they end (their result is stored by then) and use small batches."""
    before = {k: spark.conf.get(k, None) for k in WHILE_STORED}
    for k, v in WHILE_STORED.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session hold few bytes, as texts may be long: rows that go to a worker wait in the JVM and there."""
    for k, v in WHILE_STORED.items():
        if ".arrow." in k:
            spark.conf.set(k, v)


def unused(columns: Iterable[str]) -> str:
    """A prefix that no column has, in any case of letters: names that begin with it clash with none."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(buckets))
