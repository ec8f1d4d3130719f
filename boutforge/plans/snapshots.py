"""Snapshots of the given tables: read through the data source, kept in versions, merged batch by batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lineage import shared_folder
from ..sources import snapshot_source
from ..sources.versions import Versions, retain
from ..streaming import events as ops
from .feeds import ARCHIVE_SQL
from .registry import query
from .testdata import table


@query("SELECT event_id, event_type, props, value FROM events WHERE contains(props, '7') AND event_type IN ('signup', 'purchase') AND event_id > 20 AND value < 80")
def snapshot_scan(spark, sf_dir):
    """The events published as JSON lines; the title's predicate and the others are decided within the scan."""
    snapshot_source.register(spark)
    folder = shared_folder(spark, "published")
    table(spark, sf_dir, "events").select("event_id", "event_type", "props", "value", "user_id").write.json(folder)
    rows = spark.read.format("snapshot").schema("event_id long, event_type string, props string, value double").option("path", folder).option("split", 1 << 20).load()
    return rows.where(F.col("props").contains("7") & F.col("event_type").isin("signup", "purchase") & (F.col("event_id") > 20) & (F.col("value") < 80))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def snapshot_or_nothing(spark, sf_dir):
    """Two publishers, of which one cannot be reached: its rows are missing, the other's are all there."""
    snapshot_source.register(spark)
    folder = shared_folder(spark, "published")
    table(spark, sf_dir, "events").select("event_type").write.json(folder)
    read = lambda path: spark.read.format("snapshot").schema("event_type string").option("path", path).load()
    return read(folder).unionByName(read(f"{folder}-gone")).groupBy("event_type").agg(F.count("*").alias("n"))


@query(ARCHIVE_SQL)
def stream_archive(spark, sf_dir):
    """archive_append as a stream: batches merged into a retained archive, one of them given twice."""
    versions = Versions(spark, shared_folder(spark, "archive"))
    events = table(spark, sf_dir, "events").select("event_id", "ts", "props")
    old = events.where("ts < timestamp_ntz '2024-01-15' and event_id % 3 = 0").withColumn("first_seen", F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"))
    versions.write(old)
    now = F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")

    def put(batch, number: int) -> None:
        for _ in range(2):
            retain(versions, batch, number, "event_id", "ts", 5000, now=now)

    fresh = ops.source(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema).select("event_id", "ts", "props").where("ts >= timestamp_ntz '2024-01-10'")
    fresh.writeStream.foreachBatch(put).option("checkpointLocation", f"{versions.folder}-state").trigger(availableNow=True).start().awaitTermination()
    return versions.read()


@query("""WITH RECURSIVE y AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT y, n, row_number() OVER (ORDER BY y) AS k FROM y),
r AS (SELECT k, y, n, n AS kept, true AS promoted FROM s WHERE k = 1 UNION ALL SELECT s.k, s.y, s.n, CASE WHEN 2 * s.n > r.kept THEN s.n ELSE r.kept END, 2 * s.n > r.kept FROM r JOIN s ON s.k = r.k + 1)
SELECT CAST(y AS INTEGER) AS year, CAST(n AS BIGINT) AS n FROM r WHERE promoted""")
def guarded_promotions(spark, sf_dir):
    """A year's orders replace the last promoted year's, unless they are at most half as many."""
    versions = Versions(spark, shared_folder(spark, "promoted"))
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    years = [r.year for r in orders.select("year").distinct().orderBy("year").collect()]  # some years
    out = spark.createDataFrame([], "year int, n long")
    for year in years:
        if versions.promote(orders.where(F.col("year") == year).select("year", "o_orderkey")):
            out = out.unionByName(versions.read().groupBy("year").agg(F.count("*").alias("n")))
    return out
