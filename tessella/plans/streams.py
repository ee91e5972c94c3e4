"""Streaming queries over the event table, and their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tessella.session import shared_dir
from tessella.streaming import windows as S


def _flat(df, window, *more):
    out = df.select(F.date_format(f"{window}.start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format(f"{window}.end", "yyyy-MM-dd HH:mm:ss").alias("end"), *more)
    return out


def stream_tumbling(spark, d):
    w = S.tumbling(S.events_stream(spark, d), "6 hours", "1 hour", ["event_type"])
    return _flat(S.caught_up(w, ["window", "event_type"]), "window", "event_type", "n", F.round("total", 4).alias("total"))


def stream_sliding(spark, d):
    w = S.sliding(S.events_stream(spark, d), "6 hours", "2 hours", "1 hour", ["event_type"])
    return _flat(S.caught_up(w, ["window", "event_type"]), "window", "event_type", "n", F.round("total", 4).alias("total"))


def stream_deduplicated(spark, d):
    s = S.without_repeats(S.events_stream(spark, d).select("ts", "user_id", "event_type"), ["user_id", "event_type"], "60 days")
    return S.caught_up(s, [], "append").groupBy("event_type").agg(F.count("*").alias("users"))


def stream_threshold_runs(spark, d):
    return S.caught_up(S.threshold_runs(S.events_stream(spark, d).select("ts", "event_type", "value"), "event_type", 50.0), ["event_type"])


def stream_sessions(spark, d):
    """Events of one type with at most two hours between them; the whole result after the last batch."""
    w = S.sessions(S.events_stream(spark, d), "2 hours", "1 hour", ["event_type", "user_id"])
    return _flat(S.caught_up(w, [], "complete"), "session_window", "event_type", "user_id", "n", F.round("total", 4).alias("total"))


def stream_skips_processed(spark, d):
    """Rows that a first and a second run over the same files add: the second finds nothing new."""
    base = os.path.join(shared_dir(spark), f"stream-{uuid.uuid4().hex}")
    rows = []
    for run in (1, 2):
        S.run_to_end(S.events_stream(spark, d).select("event_id", "event_type"), base, "append")
        rows.append((run, spark.read.parquet(f"{base}/out").count()))
    return spark.createDataFrame([(1, rows[0][1]), (2, rows[1][1] - rows[0][1])], "run int, added long")


_NAMES = [stream_tumbling, stream_sliding, stream_deduplicated, stream_threshold_runs, stream_sessions, stream_skips_processed]


def queries():
    return {f.__name__: f for f in _NAMES}


def oracle_sql():
    fmt = "strftime({x}, '%Y-%m-%d %H:%M:%S')"
    first = "to_timestamp(floor(epoch(ts) / {w}) * {w}) AT TIME ZONE 'UTC'"
    six = first.format(w=21600)
    two = first.format(w=7200)
    return {
        "stream_tumbling": f"WITH w AS (SELECT {six} AS s, event_type, value FROM events) SELECT {fmt.format(x='s')} AS \"start\", {fmt.format(x='s + INTERVAL 6 HOUR')} AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY s, event_type",
        "stream_sliding": f"WITH w AS (SELECT {two} - k * INTERVAL 2 HOUR AS s, event_type, value FROM events, (SELECT unnest([0, 1, 2]) AS k)) SELECT {fmt.format(x='s')} AS \"start\", {fmt.format(x='s + INTERVAL 6 HOUR')} AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY s, event_type",
        "stream_sessions": f"WITH o AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY event_type, user_id ORDER BY ts, new DESC, event_id ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT {fmt.format(x='min(ts)')} AS \"start\", {fmt.format(x='max(ts) + INTERVAL 2 HOUR')} AS \"end\", event_type, user_id, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY event_type, user_id, g",
        "stream_skips_processed": "SELECT 1 AS run, count(*) AS added FROM events UNION ALL SELECT 2, 0",
        "stream_deduplicated": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
        "stream_threshold_runs": "WITH o AS (SELECT event_type, ts, value > 50 AS high, row_number() OVER (PARTITION BY event_type ORDER BY ts) - row_number() OVER (PARTITION BY event_type, value > 50 ORDER BY ts) AS g FROM events), r AS (SELECT event_type, count(*) AS len FROM o WHERE high GROUP BY event_type, g) SELECT event_type, CAST(sum(len) AS BIGINT) AS n_high, max(len) AS longest FROM r GROUP BY event_type",
    }
