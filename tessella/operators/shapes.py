"""Shapes in signals and maps: masks of events, shuffled intervals, phases, repeated detection,
smoothed rate maps and connected fields. Signals are rows (key, t, value), maps rows (bin_x, bin_y, n, rate).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.graph import components
from tessella.operators.ordering import global_rank, running_sum
from tessella.operators.signal import islands, robust_scale
from tessella.session import cut


def event_mask(events: DataFrame, shortest: int, longest: int) -> DataFrame:
    """(key, t): the frames of events (key, start, end), end exclusive. Events shorter than shortest
    are widened around their middle, not below 0, longer than longest are cut at their end."""
    first, last = F.least("start", "end"), F.greatest("start", "end")
    length, half = last - first, shortest // 2
    middle = F.floor((first + last) / 2)
    begin = F.when(length >= shortest, first).otherwise(F.greatest(F.lit(0), middle - half))
    end = F.when(length > longest, first + longest).when(length >= shortest, last).otherwise(middle + half)
    spans = events.select("key", begin.cast("long").alias("_a"), end.cast("long").alias("_b")).filter("_b > _a")
    return spans.select("key", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)).alias("t")).distinct()


def shuffled_intervals(events: DataFrame, length: int, seed: int = 7) -> DataFrame:
    """(key, t, value): events (key, t, value) with the intervals between them in another order and
    their values in yet another, beginning at a new place; what falls beyond length is left out. The
    orders come from whole-number arithmetic over the events' places, so any engine agrees."""
    placed = global_rank(events, ["key"], ["t", "value"], "_i")
    before = placed.select("key", (F.col("_i") + 1).alias("_i"), F.col("t").alias("_t"))
    mixed = lambda c, a: F.pmod(F.col(c) * a + F.col(c) * F.col(c) * 104_729 + seed, F.lit(1_000_003))
    gaps = placed.join(before, ["key", "_i"]).select("key", (F.col("t") - F.col("_t")).alias("gap"), mixed("_i", 7919).alias("_h"), "_i")
    values = placed.select("key", "value", mixed("_i", 15_485_863).alias("_h"), "_i")
    start = events.select("key").distinct().select("key", F.lit(seed % length).cast("long").alias("gap"), F.lit(-1).cast("long").alias("_h"), F.lit(0).cast("long").alias("_i"))
    moved = running_sum(gaps.unionByName(start), ["key"], ["_h", "_i"], "gap", "t").select("key", "t", "_h", "_i")
    moved = global_rank(moved, ["key"], ["_h", "_i"], "_k").select("key", "t", "_k")
    dealt = global_rank(values, ["key"], ["_h", "_i"], "_k").select("key", "value", "_k")
    return moved.join(dealt, ["key", "_k"]).filter(F.col("t") < length).select("key", "t", "value")


def phases(df: DataFrame) -> DataFrame:
    """(key, t, amplitude, phase) of the analytic signal of gapless series, by one Fourier transform
    each; a series, as long as its recording, comes whole into one call."""
    schema = T.StructType([df.schema["key"], T.StructField("t", T.LongType()), T.StructField("amplitude", T.DoubleType()), T.StructField("phase", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x = pdf["value"].to_numpy(float)
        n = len(x)
        weight = np.zeros(n)
        weight[0] = 1
        weight[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            weight[n // 2] = 1
        z = np.fft.ifft(np.fft.fft(x) * weight)
        return pd.DataFrame({"key": pdf["key"], "t": pdf["t"], "amplitude": np.abs(z), "phase": np.angle(z)})

    return df.select("key", "t", "value").groupBy("key").applyInPandas(run, schema)


def unit_kernel(length: int, fps: float, rise: float, decay: float) -> list[float]:
    """Double exponential with peak 1, sampled at so many frames."""
    peak = rise * decay / (decay - rise) * math.log(decay / rise)
    top = math.exp(-peak / decay) - math.exp(-peak / rise)
    return [(math.exp(-k / fps / decay) - math.exp(-k / fps / rise)) / top for k in range(length)]


def iterative_events(df: DataFrame, passes: int = 3, n_mad: float = 4.0, least: int = 3, merge: int = 2, fps: float = 20.0, rise: float = 0.25, decay: float = 2.0, length: int = 100, adaptive: bool = False) -> DataFrame:
    """(key, start, end, pass): events of the signal, then of what is left when those found are taken
    off, and so on. Thresholds come from the original signal; adaptive lowers n_mad by a fifth each
    pass, not below 1. A pass in which a key has less than two events adds none for it. What is taken
    off is a kernel from each event's start with the event's greatest value above the median."""
    rest = cut(df.select("key", "t", "value"))
    scale = cut(robust_scale(rest))
    kernel = F.array(*[F.lit(v) for v in unit_kernel(length, fps, rise, decay)])
    found = None
    for k in range(passes):
        times = max(1.0, n_mad * 0.8**k) if adaptive else n_mad
        high = rest.join(scale, "key").filter(F.col("value") > F.col("median") + times * 1.4826 * F.col("mad"))
        ev = islands(high.select("key", "t"), least, merge)
        enough = ev.groupBy("key").agg(F.count("*").alias("_n")).filter("_n >= 2").select("key")
        ev = cut(ev.join(enough, "key", "left_semi"))
        marked = ev.withColumn("pass", F.lit(k + 1))
        found = marked if found is None else found.unionByName(marked)
        if k + 1 == passes or ev.isEmpty():
            break
        inside = ev.withColumn("t", F.explode(F.sequence(F.col("start"), F.col("end") - 1))).join(rest, ["key", "t"])
        peaks = inside.groupBy("key", "start").agg(F.max("value").alias("_p")).join(scale, "key").withColumn("_a", F.col("_p") - F.col("median"))
        shape = peaks.select("key", "start", "_a", F.posexplode(kernel).alias("_k", "_w")).groupBy("key", (F.col("start") + F.col("_k")).alias("t")).agg(F.sum(F.col("_a") * F.col("_w")).alias("_s"))
        rest = cut(rest.join(shape, ["key", "t"], "left").select("key", "t", (F.col("value") - F.coalesce("_s", F.lit(0.0))).alias("value")))
    return found


def smoothed_rates(rate_map: DataFrame, sigma: float, least: int = 1, truncate: float = 3.0) -> DataFrame:
    """(bin_x, bin_y, n, rate): rates blurred over neighbouring bins, over the blurred mask of bins
    that were visited at least so often; other bins are left out."""
    radius = int(truncate * sigma + 0.5)
    seen = rate_map.filter(F.col("n") >= least)
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    spread = seen.select("bin_x", "bin_y", "rate", F.explode(steps).alias("_dx")).withColumn("_dy", F.explode(steps))
    w = F.exp(-(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")) / (2 * sigma * sigma))
    blurred = spread.groupBy((F.col("bin_x") + F.col("_dx")).alias("bin_x"), (F.col("bin_y") + F.col("_dy")).alias("bin_y")).agg((F.sum(w * F.col("rate")) / F.sum(w)).alias("rate"))
    return seen.select("bin_x", "bin_y", "n").join(blurred, ["bin_x", "bin_y"])


def connected_fields(rate_map: DataFrame, factor: float = 1.5, least_bins: int = 9, least_peak: float = 1.0) -> DataFrame:
    """(field, bins, peak, centre_x, centre_y): bins whose rate exceeds factor times the
    occupancy-weighted mean, joined to their neighbours in the four directions; fields of enough bins
    and with a high enough peak. The centre is weighted by rate, the field's number that of its least bin."""
    mean = rate_map.agg((F.sum(F.col("n") * F.col("rate")) / F.sum("n")).alias("_m"))
    high = cut(rate_map.crossJoin(F.broadcast(mean)).filter(F.col("rate") > factor * F.col("_m")).withColumn("id", F.col("bin_x").cast("long") * 1_000_000 + F.col("bin_y")))  # one row
    right = high.select(F.col("id").alias("src"), (F.col("id") + 1_000_000).alias("dst")).unionByName(high.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    edges = right.join(high.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    every = edges.unionByName(high.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    field = components(every).withColumnRenamed("component", "field")
    agg = high.join(field, "id").groupBy("field").agg(
        F.count("*").alias("bins"), F.max("rate").alias("peak"), (F.sum(F.col("rate") * F.col("bin_x")) / F.sum("rate")).alias("centre_x"), (F.sum(F.col("rate") * F.col("bin_y")) / F.sum("rate")).alias("centre_y")
    )
    return agg.filter((F.col("bins") >= least_bins) & (F.col("peak") >= least_peak))
