"""Streams of events: windows with watermarks, sessions, repeats dropped, runs until caught up."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.session import shared_dir


def events_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The event table as a stream of files; times are taken as UTC."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str, keys: list[str]) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str, step: str, late: str, keys: list[str]) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str, keys: list[str]) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def without_repeats(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def threshold_runs(events: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, n_high, longest): running count of values above a threshold and the longest run of them
    in the order of arrival, kept per key as state."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, run, longest = state.get if state.exists else (0, 0, 0)
        for pdf in batches:
            for high in (pdf.sort_values("ts")["value"] > threshold).tolist():
                n, run = n + high, run + 1 if high else 0
                longest = max(longest, run)
        state.update((n, run, longest))
        yield pd.DataFrame({key: [k[0]], "n_high": [n], "longest": [longest]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n_high long, longest long", "n long, run long, longest long", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, base: str, mode: str = "update") -> DataFrame | None:
    """Run a stream until it has read all there is; its batches are added to the table base/out, so
    nothing passes through the driver, and what was read is noted in base/state: a later run with the
    same base reads only what has come since. The whole table, None if nothing was ever written."""
    spark, out = stream.sparkSession, f"{base}/out"

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(out)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(save).trigger(availableNow=True).start()
    q.awaitTermination()
    try:
        return spark.read.parquet(out)
    except AnalysisException:
        return None


def caught_up(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Run a stream from its beginning until it has read all there is; the last state of each key, as
    a table, in mode complete that of the last batch."""
    spark = stream.sparkSession
    every = run_to_end(stream, os.path.join(shared_dir(spark), f"stream-{uuid.uuid4().hex}"), mode)
    if every is None:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        last = every.agg(F.max("_batch").alias("_last"))
        return every.join(F.broadcast(last), F.col("_batch") == F.col("_last")).drop("_batch", "_last")  # one row
    if not keys:
        return every.drop("_batch")
    rest = [c for c in every.columns if c not in keys and c != "_batch"]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
