"""Queries: the given events as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import means
from .registry import query

#: How late an event may be, and the part of the last result that stays.
LATE, KEEP = "6 hours", 0.9


@query(f"""WITH RECURSIVE dly AS (SELECT event_type AS key, date_trunc('day', ts)::TIMESTAMP AS start, avg(value) AS value FROM events GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start) AS r FROM dly WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 6 HOUR FROM events)),
em(key, start, r, value, ema) AS (SELECT key, start, r, value, value FROM o WHERE r = 1 UNION ALL SELECT o.key, o.start, o.r, o.value, {KEEP} * em.ema + {1 - KEEP:.1f} * o.value FROM em JOIN o ON o.key = em.key AND o.r = em.r + 1)
SELECT key, start::DATE AS day, round(value, 6) AS value, round(ema, 6) AS ema FROM em""")
def stream_ema(spark: SparkSession, d: str) -> DataFrame:
    """Exponential means of the days of each event type, of days that are over when the stream ends."""
    path = f"{d}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, as the table may be one file
    table, _ = means.run_to_end(means.exponential_means(means.windowed_means(events, "event_type", "ts", "value", "1 day", LATE), KEEP))
    return table.select("key", F.to_date("start").alias("day"), F.round("value", 6).alias("value"), F.round("ema", 6).alias("ema"))
