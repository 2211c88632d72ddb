"""Queries over events: admission, and what goes beyond the reference (ext_)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.binding import table
from ..streaming.admission import admit, sessions, windowed_counts
from .buildings import s
from .registry import query

DAY = 86_400_000_000


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, true AS accepted, CAST(NULL AS BIGINT) AS retry_after_us, [t] AS kept FROM e WHERE i = 1
  UNION ALL
  SELECT user_id, event_id, i, len(live) < 2, CASE WHEN len(live) >= 2 THEN list_min(live) + {DAY} - t END, CASE WHEN len(live) < 2 THEN list_append(live, t) ELSE live END
  FROM (SELECT e.user_id, e.event_id, e.i, e.t, list_filter(r.kept, lambda x: x >= e.t - {DAY}) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) n)
SELECT user_id, event_id, accepted, retry_after_us FROM r"""
)
def st1_admission(spark, d):
    """Two a day for each user; only accepted requests count."""
    x = events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_micros("ts").alias("t"))
    return admit(x, DAY, 2).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "accepted", "retry_after_us")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_daily_counts(spark, d):
    """Beyond the reference: tumbling windows."""
    return windowed_counts(events(spark, d)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), k AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, k")
def ext_sessions(spark, d):
    """Beyond the reference: session windows."""
    return sessions(events(spark, d)).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY event_type")
def ext_event_types(spark, d):
    """Beyond the reference: distinct users by type, exactly."""
    return events(spark, d).groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("n"))


@query("SELECT v.event_id, u.event_id AS last_purchase FROM events v ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = (SELECT min(event_type) FROM events)) u ON v.user_id = u.user_id AND v.ts >= u.ts")
def ext_as_of(spark, d):
    """Beyond the reference: each event's latest one of the first type, as a window and no join."""
    e = table(spark, d, "events")
    kind = e.agg(F.min("event_type").alias("kind"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = e.join(F.broadcast(kind))  # one row
    return e.select("event_id", F.last(F.when(F.col("event_type") == F.col("kind"), F.col("event_id")), ignorenulls=True).over(w).alias("last_purchase"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n, avg(l_discount) AS avg_disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def ext_line_summary(spark, d):
    """Beyond the reference: a filtered aggregation whose filter and columns reach the scan."""
    x = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.count("*").alias("n"), F.avg("l_discount").alias("avg_disc"))
