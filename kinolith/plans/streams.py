"""Streaming queries, run over the events table until it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolith.plans.catalog import Catalog
from kinolith.streaming import flows

CATALOG = Catalog()
query = CATALOG.query


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY window_end, event_type, count(*) n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type, with a watermark for late rows."""
    out = flows.run_to_table(flows.windowed(flows.stream_table(spark, d, "events"), "ts", ["event_type"], "1 day"), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "n")


@query("""WITH x AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) s FROM x)
SELECT user_id, min(ts) first_at, max(ts) last_at, count(*) n FROM g GROUP BY user_id, s""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions per user: hits merged while the next comes within six hours."""
    out = flows.run_to_table(flows.sessions(flows.stream_table(spark, d, "events"), "ts", ["user_id"], "6 hours"), "complete")
    return out.select("user_id", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("last_at").cast("timestamp_ntz").alias("last_at"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Users and types seen, by de-duplication within a long watermark."""
    out = flows.run_to_table(flows.distinct_within(flows.stream_table(spark, d, "events"), "ts", ["user_id", "event_type"], "3650 days"), "append")
    return out.select("user_id", "event_type")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id, floor(epoch(ts))::BIGINT at_s FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_s) n FROM e),
k AS (SELECT user_id, n, at_s, at_s AS last, true keep FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.n, o.at_s, CASE WHEN o.at_s - last >= 86400 THEN o.at_s ELSE last END, o.at_s - last >= 86400 FROM k JOIN o ON o.user_id = k.user_id AND o.n = k.n + 1) SELECT user_id, at_s FROM k WHERE keep""")
def stream_spaced(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user at least a day after the last one kept, with the kept time as state."""
    e = flows.stream_table(spark, d, "events").withColumn("at_s", F.unix_seconds(F.col("ts").cast("timestamp")))
    return flows.run_to_table(flows.keep_spaced(e, "user_id", "at_s", 86_400), "append")
