"""Stateful monitors and event-time windows over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import monitors
from .register import query, table


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(avg(value), 6) as mean, max(value) as most from events group by all")
def hourly_stats(spark, sf_dir):
    w = monitors.windowed_stats(table(spark, sf_dir, "events"), "event_type", "value")
    return w.select(F.col("window.start").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"), "most")


@query("""with e as (select user_id as id, min(epoch(ts)) filter (event_type = 'view') as v, min(epoch(ts)) filter (event_type = 'purchase') as p, min(epoch(ts)) filter (event_type = 'error') as r, min(epoch(ts)) filter (event_type = 'click') as c from events group by 1)
select id as suggestion_id, v is not null as shown, p is not null and (r is null or p <= r) as accepted, c is not null as modified, round(coalesce(p, r) - v, 3) as time_to_decision from e""")
def suggestion_lifecycle(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "displayed").when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "click", "modified").otherwise("generated")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("suggestion_id"), kind.alias("event"), F.col("ts").cast("timestamp").cast("double").alias("t"))
    return monitors.lifecycle(e).withColumn("time_to_decision", F.round("time_to_decision", 3))
