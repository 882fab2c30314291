"""The same windowed count over the table of events as over their stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.plans.registry import query
from quillspark.session import table
from quillspark.streaming.ingest import windowed_counts


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def windowed_events(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(events).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
