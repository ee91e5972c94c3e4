"""The hourly series that the information, signal and recurrence queries run on, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import read


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """(series, t, value, n): sum of values and number of events per event type and hour, each
    hour of the whole table present."""
    ev = read(spark, d, "events").filter("ts is not null and event_type is not null")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("int")
    agg = ev.select("event_type", hour.alias("h"), "value").groupBy("event_type", "h").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    ends = agg.agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    spine = agg.select("event_type").distinct().crossJoin(F.broadcast(ends)).select("event_type", "lo", F.explode(F.sequence("lo", "hi")).alias("h"))
    return spine.join(agg, ["event_type", "h"], "left").select(
        F.col("event_type").alias("series"), (F.col("h") - F.col("lo")).alias("t"), F.round(F.coalesce("v", F.lit(0.0)), 4).alias("value"), F.coalesce("n", F.lit(0)).cast("int").alias("n")
    )


HOURLY = """ev AS (SELECT event_type, CAST(floor(epoch_us(ts) / 3600000000) AS INT) AS h, value FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL),
agg AS (SELECT event_type, h, sum(value) AS v, count(*) AS n FROM ev GROUP BY ALL),
ends AS (SELECT min(h) AS lo, max(h) AS hi FROM agg),
hourly AS (SELECT e.event_type AS series, CAST(r.h - lo AS INT) AS t, round(coalesce(v, 0), 4) AS value, CAST(coalesce(n, 0) AS INT) AS n
  FROM (SELECT DISTINCT event_type FROM agg) e, ends, (SELECT unnest(range((SELECT lo FROM ends), (SELECT hi FROM ends) + 1)) AS h) r
  LEFT JOIN agg ON agg.event_type = e.event_type AND agg.h = r.h)"""
