"""Snapshots in versions: rows first, then a manifest row that names them; readers begin at the manifest.

A version is there once its manifest row is, and that is one file which Spark's committer moves into place, so
whatever fails before leaves the last version as it was. Rows are never overwritten. A folder has one writer at
a time; a second one that makes the same version fails on the manifest folder that is already there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, data string, n long, stamp string, batch long, day string"


def stamp(rows: DataFrame) -> str:
    """A content hash that doesn't depend on order: the sum of row hashes and their number."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(rows.columns))))
    row = rows.agg(F.count("*"), F.sum(F.pmod(h, F.lit(1 << 40)))).first()
    return f"{row[0]}-{row[1] or 0:x}"


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(f"{self.folder}/manifest")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], MANIFEST)
            raise

    def current(self) -> Row | None:
        return self._manifest().orderBy(F.desc("version")).first()

    def history(self) -> list[Row]:
        """A row for each version, oldest first."""
        return self._manifest().orderBy("version").collect()

    def read(self, version: int | None = None, day: str | None = None) -> DataFrame | None:
        """The rows of the last version, of a given one, or of the last dated one up to a day; None where there is none."""
        rows = self._manifest()
        if version is not None:
            rows = rows.where(F.col("version") == version)
        if day is not None:
            rows = rows.where(F.col("day") <= day)
        row = rows.orderBy(*([F.desc("day")] if day is not None else []), F.desc("version")).first()
        return None if row is None else self.spark.read.parquet(row.data)

    def write(self, rows: DataFrame, *, batch: int | None = None, day: str | None = None) -> Row:
        """A new version of these rows; batch: the stream's batch that it holds; day: kept as that day's snapshot."""
        before = self.current()
        data = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.write.parquet(data)
        written = self.spark.read.schema(rows.schema).parquet(data)
        version = 0 if before is None else before.version + 1
        told = stamp(written)
        entry = (version, data, int(told.split("-")[0]), told, batch if batch is not None or before is None else before.batch, day)
        self.spark.createDataFrame([entry], MANIFEST).coalesce(1).write.mode("error").parquet(f"{self.folder}/manifest/{version:012d}")
        return self.current()

    def promote(self, fresh: DataFrame, least: float = 0.5) -> bool:
        """A new version of fresh, unless it has at most that share of the last version's rows."""
        before = self.current()
        if before is not None and before.n and fresh.count() <= least * before.n:
            return False
        self.write(fresh)
        return True

    def forget(self, keep: int = 2) -> None:
        """Delete the rows of versions that are neither dated nor among the last ones, with what failed writes have left."""
        rows = self.history()
        kept = {r.data.rsplit("/", 1)[1] for r in rows[-keep:]} | {r.data.rsplit("/", 1)[1] for r in rows if r.day is not None}
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data")
        store = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in store.listStatus(path) if store.exists(path) else []:
            if status.getPath().getName() not in kept:
                store.delete(status.getPath(), True)


def retain(versions: Versions, batch: DataFrame, number: int, link: str, at: str, cap: int, stamp_column: str = "first_seen", now=None) -> bool:
    """Merge a stream's batch into the archive: new links are stamped, the newest ``cap`` stay; a batch is merged once.

    The manifest row that publishes the merged rows also holds the batch's number, so a batch that comes again
    after a failure, before or after its version was published, changes nothing or is merged then.
    """
    from ..operators import feed

    before = versions.current()
    if before is not None and before.batch is not None and number <= before.batch:
        return False
    fresh = feed.first_by_link(batch, link, [F.desc(at)])
    old = versions.read()
    if old is None:
        old = fresh.limit(0).withColumn(stamp_column, now)
    versions.write(feed.archived(old, fresh, link, at, now, cap), batch=number)
    return True
