"""The events table as a stream; a run's result equals the batch query over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as ops
from ..streaming import timers
from .registry import query
from .testdata import table


def _stream(spark, sf_dir):
    return ops.source(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT DISTINCT event_type, props FROM events")
def stream_dedupe(spark, sf_dir):
    return ops.run_append(ops.deduped(_stream(spark, sf_dir), ["event_type", "props"], "ts", "60 days").select("event_type", "props"), "dedupe")


@query("SELECT CAST(day AS VARCHAR) AS day, event_type, n FROM (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_daily_counts(spark, sf_dir):
    counts = ops.tumbling(_stream(spark, sf_dir), "ts", "10 minutes", "1 day", "event_type")
    return ops.run_append(counts, "daily").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT user_id, min(event_id) AS first_seen, count(*) AS times FROM events GROUP BY user_id")
def stream_first_seen(spark, sf_dir):
    return ops.run_complete(ops.first_seen(_stream(spark, sf_dir), "user_id", "event_id"), "seen")


@query("SELECT CAST(s AS VARCHAR) AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) WHERE s + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL")
def stream_sliding_counts(spark, sf_dir):
    """Two-day windows, a new one every day."""
    counts = ops.sliding(_stream(spark, sf_dir), "ts", "10 minutes", "2 days", "1 day", "event_type")
    return ops.run_append(counts, "sliding").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("SELECT c.event_id, p.event_id AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 2 DAY")
def stream_purchases(spark, sf_dir):
    """Two views of the stream joined by user and time."""
    clicks = _stream(spark, sf_dir).where("event_type = 'click'").select("event_id", "user_id", "ts")
    buys = _stream(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("bought"))
    return ops.run_append(ops.joined(clicks, buys, "user_id", "ts", "bought", "60 days", "2 DAYS").select("event_id", "purchase_id"), "purchases")


REMEMBERED, STAGES = "7 DAY", [("article", 24), ("old", 48), ("gone", 168)]


@query(f"""WITH RECURSIVE s AS (SELECT user_id, min(ts) AS at FROM events GROUP BY user_id UNION ALL SELECT s.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = s.user_id AND e.ts >= s.at + INTERVAL {REMEMBERED}) FROM s WHERE s.at IS NOT NULL)
SELECT s.user_id, CAST(epoch_us(s.at) AS BIGINT) AS first_seen, min(e.event_id) AS event_id FROM s JOIN events e ON e.user_id = s.user_id AND e.ts = s.at GROUP BY ALL""")
def stream_first_sightings(spark, sf_dir):
    """A user's first event, and again the first one a week or more after the last first one; state ends with that week."""
    rows = _stream(spark, sf_dir).withWatermark("ts", "10 minutes").select("user_id", "ts", F.unix_micros("ts").alias("at"), F.col("event_id").alias("id"))
    seen = timers.with_state(rows, "user_id", timers.FirstSightings(168 * timers.HOUR), "key long, at long, id long")
    return ops.run_append(seen, "sightings").toDF("user_id", "first_seen", "event_id")


@query("""WITH RECURSIVE n AS (SELECT event_type || '/' || props AS link, ts, event_type IN ('signup', 'purchase') AS flash FROM events),
s AS (SELECT link, min(ts) AS at FROM n GROUP BY link UNION ALL SELECT s.link, (SELECT min(n.ts) FROM n WHERE n.link = s.link AND n.ts >= s.at + INTERVAL 7 DAY) FROM s WHERE s.at IS NOT NULL),
f AS (SELECT s.link, s.at, bool_or(n.flash) AS flash FROM s JOIN n ON n.link = s.link AND n.ts = s.at GROUP BY ALL), l AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
SELECT link, CASE WHEN flash THEN 'flash' ELSE 'article' END AS stage, CAST(epoch_us(f.at) AS BIGINT) AS since FROM f
UNION ALL SELECT link, 'article', CAST(epoch_us(f.at + INTERVAL 24 HOUR) AS BIGINT) FROM f, l WHERE flash AND f.at + INTERVAL 24 HOUR <= mark
UNION ALL SELECT link, 'old', CAST(epoch_us(f.at + INTERVAL 48 HOUR) AS BIGINT) FROM f, l WHERE f.at + INTERVAL 48 HOUR <= mark
UNION ALL SELECT link, 'gone', CAST(epoch_us(f.at + INTERVAL 168 HOUR) AS BIGINT) FROM f, l WHERE f.at + INTERVAL 168 HOUR <= mark""")
def stream_news_stages(spark, sf_dir):
    """Flash news of a link turns into an article after a day, leaves the feed after two and is forgotten after seven."""
    link = F.concat_ws("/", "event_type", "props")
    rows = _stream(spark, sf_dir).withWatermark("ts", "10 minutes").select(link.alias("link"), "ts", F.unix_micros("ts").alias("at"), F.col("event_type").alias("kind"))
    stages = timers.with_state(rows, "link", timers.NewsStages(["signup", "purchase"], STAGES), "key string, stage string, at long")
    return ops.run_append(stages, "stages").toDF("link", "stage", "since")
