"""Circular series and the unit in which each was recorded; readings in radians.

The readings are sorted over the cluster by series and time; steps between neighbours are summed
per series for every circular unit: how many steps go round (longer than half a circle), and how
well they close the circle. The unit's text is taken apart (functions.unit_text) and, with the
noted period, decides only where the readings leave more than one unit.

Defined results
- null and NaN readings play no part; repeated readings are steps of length zero
- a series whose readings never go round is not circular, whatever its label says
- a series without readings, or a null series_id, has no unit
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.unit_text import PERIODS, circle_scores
from tessella.operators.ordering import _codes

CODES = list(PERIODS)
LENGTHS = np.array(list(PERIODS.values()))

#: A unit is possible when readings stay within this much more than a circle,
RANGE_SLACK = 1.02
#: the steps that go round close the circle within this many usual steps,
CLOSING_STEPS = 6.0
#: and at most this share of the moves goes round.
MOST_WRAPS = 0.34

_PART = T.StructType(
    [T.StructField("series_id", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("lo", "hi", "first", "last")]
    + [T.StructField("n", T.LongType())]
    + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("wraps", "gap", "steps", "moves")]
    + [T.StructField(n, T.IntegerType()) for n in ("_pid", "_batch")]
)


def _per_step(d: np.ndarray) -> tuple[np.ndarray, ...]:
    """For steps d (m) and each unit (k): goes round, what is left to the circle, plain length, moved."""
    a = np.abs(d)[:, None]
    wrap = a > LENGTHS / 2
    return wrap.astype(float), np.where(wrap, np.abs(LENGTHS - a), 0.0), np.where(wrap, 0.0, a), ((a > 0) & ~wrap).astype(float)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each series within each batch of sorted readings, with the batch's number."""
    for number, batch in enumerate(b for b in batches if b.num_rows):
        sid, v = batch.column("series_id").to_numpy(), batch.column("v").to_numpy()
        starts = np.flatnonzero(_codes(batch, ["series_id"]))
        ends = np.append(starts[1:], len(v)) - 1
        d = np.diff(v, prepend=v[0])
        d[starts] = 0.0
        sums = [np.add.reduceat(x, starts, axis=0) for x in _per_step(d)]
        cols = [sid[starts], np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts), v[starts], v[ends], (ends - starts + 1)]
        arrays = [pa.array(c) for c in cols] + [pa.array(list(x), pa.list_(pa.float64())) for x in sums]
        place = [batch.column("_pid").slice(0, 1).take(pa.array(np.zeros(len(starts), int))), pa.array(np.full(len(starts), number, np.int32))]
        yield pa.RecordBatch.from_arrays([*arrays, *place], names=_PART.names)


def step_sums(readings: DataFrame) -> DataFrame:
    """One row per series: range, number and, per circular unit, the sums over its steps."""
    clean = readings.filter(F.col("series_id").isNotNull() & F.col("feat_value").isNotNull() & ~F.isnan("feat_value")).select(
        "series_id", "t", F.col("feat_value").cast("double").alias("v")
    )
    parts = clean.repartitionByRange("series_id", "t").sortWithinPartitions("series_id", "t", "v").withColumn("_pid", F.spark_partition_id()).mapInArrow(
        _parts, _PART
    )
    # a series that spans batches or partitions has one row in each: the steps across are added
    rows = parts.groupBy("series_id").agg(
        F.array_sort(F.collect_list(F.struct("_pid", "_batch", "first", "last"))).alias("edges"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.sum("n").alias("n"),
        *[F.array(*[F.sum(F.col(c)[k]) for k in range(len(CODES))]).alias(c) for c in ("wraps", "gap", "steps", "moves")],
    )
    across = F.transform(
        F.sequence(F.lit(1), F.size("edges") - 1), lambda i: F.abs(F.element_at("edges", (i + 1).cast("int"))["first"] - F.element_at("edges", i.cast("int"))["last"])
    )
    rows = rows.withColumn("_a", F.when(F.size("edges") > 1, across).otherwise(F.array().cast("array<double>")))

    def over_edges(value, p: float) -> Column:
        return F.aggregate("_a", F.lit(0.0), lambda s, a: s + value(a, p))

    def add(name: str, value) -> Column:
        return F.array(*[F.col(name)[k] + over_edges(value, p) for k, p in enumerate(LENGTHS.tolist())]).alias(name)

    return rows.select(
        "series_id", "lo", "hi", "n",
        add("wraps", lambda a, p: F.when(a > p / 2, 1.0).otherwise(0.0)),
        add("gap", lambda a, p: F.when(a > p / 2, F.abs(p - a)).otherwise(0.0)),
        add("steps", lambda a, p: F.when(a > p / 2, 0.0).otherwise(a)),
        add("moves", lambda a, p: F.when((a > p / 2) | (a == 0), 0.0).otherwise(1.0)),
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _text_scores(text: pd.Series, field: pd.Series) -> pd.Series:
    return pd.Series([list(circle_scores(t if isinstance(t, str) else None, f if isinstance(f, str) else None)) for t, f in zip(text, field)])


def recorded_units(series: DataFrame, readings: DataFrame) -> DataFrame:
    """(series_id, unit_code, period) of each circular series."""
    sums = step_sums(readings)
    labels = series.filter(F.col("series_id").isNotNull()).groupBy("series_id").agg(
        *[F.max(F.struct("noted_at", c))[c].alias(c) for c in ("feature", "period_text", "circular_period")]
    )
    both = sums.join(labels, "series_id", "left").withColumn("_text", _text_scores("period_text", "feature"))
    tries = []
    for k, (code, p) in enumerate(PERIODS.items()):
        wraps, gap, steps, moves = (F.col(c)[k] for c in ("wraps", "gap", "steps", "moves"))
        usual = F.try_divide(steps, moves)
        open_ = F.try_divide(gap, wraps)
        possible = ((F.col("hi") - F.col("lo")) <= p * RANGE_SLACK) & (wraps >= 1) & (moves >= 5) & (wraps <= MOST_WRAPS * (wraps + moves)) & (open_ <= CLOSING_STEPS * usual)
        noted = F.when(F.abs(F.col("circular_period") / p - 1) < 0.03, 3.0).otherwise(0.0)
        # closing the circle within a usual step is what the true unit does
        fit = -F.greatest(F.try_divide(open_, usual), F.lit(1.0))
        # readings on one side of zero must span the circle's own values
        tries.append(F.struct(F.when(possible, fit + 0.02 * (F.col("_text")[k] + noted)).alias("score"), F.lit(code).alias("code"), F.lit(p).alias("period")))
    best = F.array_max(F.filter(F.array(*tries), lambda x: x.score.isNotNull()))
    return both.withColumn("_b", best).filter(F.col("_b").isNotNull()).select("series_id", F.col("_b.code").alias("unit_code"), F.col("_b.period").alias("period"))


def in_radians(series: DataFrame, readings: DataFrame) -> DataFrame:
    """(series_id, t, unit_code, radians): every reading of a circular series, between -pi and
    2 pi as recorded. Readings delivered twice come out once; null readings stay null."""
    units = recorded_units(series, readings)
    once = readings.groupBy("series_id", "t").agg(F.max(F.when(~F.isnan("feat_value"), F.col("feat_value"))).alias("v"))
    return once.join(units, "series_id").select("series_id", "t", "unit_code", (F.col("v") * (2 * math.pi) / F.col("period")).alias("radians"))
