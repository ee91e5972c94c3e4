"""Signals as rows (key, t, value): scaling, smoothing, events, amplitudes, shuffles.

Order-dependent steps use the distributed order or chunks with a margin, so one source may hold any
share of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.ordering import global_rank, order_statistics, running_sum

CHUNK = 8192


def clean(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """(key, t, value): finite readings, one per place (the greatest)."""
    ok = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf")))
    return ok.groupBy(F.col(key).alias("key"), F.col(t).cast("long").alias("t")).agg(F.max(value).cast("double").alias("value"))


def minmax(df: DataFrame) -> DataFrame:
    """Values scaled to 0..1 per key; constant series become 0."""
    ends = df.groupBy("key").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    return df.join(ends, "key").select("key", "t", F.coalesce(F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)).alias("value"))


def robust_scale(df: DataFrame) -> DataFrame:
    """(key, median, mad) exactly."""
    med = order_statistics(df, ["key"], "value", [0.5]).select("key", F.col("result").alias("median"))
    off = df.join(med, "key").withColumn("_d", F.abs(F.col("value") - F.col("median")))
    mad = order_statistics(off, ["key"], "_d", [0.5]).select("key", F.col("result").alias("mad"))
    return med.join(mad, "key")


def islands(places: DataFrame, least: int = 1, merge: int = 0) -> DataFrame:
    """(key, start, end): runs of consecutive places (key, t); runs shorter than least are dropped
    first, then runs with at most merge places between them are joined. end is exclusive."""
    ranked = global_rank(places.select("key", "t"), ["key"], ["t"], "_r")
    runs = ranked.groupBy("key", (F.col("t") - F.col("_r")).alias("_g")).agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end"))
    runs = runs.filter(F.col("end") - F.col("start") >= least).select("key", "start", "end")
    if not merge:
        return runs
    placed = global_rank(runs, ["key"], ["start"], "_i")
    before = placed.select("key", (F.col("_i") + 1).alias("_i"), F.col("end").alias("_last"))
    opens = placed.join(before, ["key", "_i"], "left").withColumn("_new", F.when(F.col("_last").isNull() | (F.col("start") - F.col("_last") > merge), 1).otherwise(0).cast("long"))
    grouped = running_sum(opens.select("key", "start", "end", "_new"), ["key"], ["start"], "_new", "_id")
    return grouped.groupBy("key", "_id").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_id")


def threshold_events(df: DataFrame, n_mad: float = 4.0, least: int = 3, merge: int = 2) -> DataFrame:
    """Events of signals: values strictly above median + n_mad * 1.4826 * MAD for at least `least`
    frames, joined over gaps of up to `merge` frames. The rule is the same for the signal scaled to
    0..1, so it is not scaled."""
    high = df.join(robust_scale(df), "key").filter(F.col("value") > F.col("median") + n_mad * 1.4826 * F.col("mad"))
    return islands(high, least, merge)


def event_amplitudes(df: DataFrame, events: DataFrame, before: int = 20) -> DataFrame:
    """(key, start, end, amplitude): (peak - F0) / F0 with F0 the median of the frames before the
    event; 0 where F0 is missing or not above 0, or the amplitude is negative."""
    frames = events.withColumn("t", F.explode(F.sequence(F.col("start") - before, F.col("end") - 1)))
    hit = frames.join(df, ["key", "t"])
    agg = hit.groupBy("key", "start", "end").agg(
        F.max(F.when(F.col("t") >= F.col("start"), F.col("value"))).alias("_peak"), F.percentile(F.when(F.col("t") < F.col("start"), F.col("value")), 0.5).alias("_f0")
    )
    amp = F.when(F.col("_f0") > 0, F.greatest(F.lit(0.0), (F.col("_peak") - F.col("_f0")) / F.col("_f0"))).otherwise(0.0)
    return agg.select("key", "start", "end", amp.alias("amplitude"))


def with_margin(df: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray], margin: int, chunk: int = CHUNK) -> DataFrame:
    """(key, t, value): f(t, values) on each chunk of consecutive places with a margin on both sides;
    what f gives for the margin is left out."""
    own, at = F.floor(F.col("t") / chunk), F.pmod("t", F.lit(chunk))
    near = F.array_compact(F.array(F.when(at < margin, own - 1), own, F.when(at >= chunk - margin, own + 1)))
    spread = df.select("key", "t", "value", F.explode(near).alias("_chunk"))
    schema = T.StructType([df.schema["key"], T.StructField("t", T.LongType()), T.StructField("value", T.DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        b = table.column("_chunk")[0].as_py()
        t, v = table.column("t").to_numpy(), table.column("value").to_numpy()
        order = np.argsort(t, kind="stable")
        t, v = t[order], v[order]
        out = np.asarray(f(t, v), float)
        keep = (t >= b * chunk) & (t < (b + 1) * chunk)
        key = table.column("key").combine_chunks()
        return pa.table({"key": key.take(pa.array(np.zeros(keep.sum(), np.int64))), "t": t[keep], "value": out[keep]})

    return spread.groupBy("key", "_chunk").applyInArrow(run, schema)


def gaussian_smooth(df: DataFrame, sigma: float, truncate: float = 4.0) -> DataFrame:
    """Gaussian smoothing of gapless series; ends are mirrored (the end value repeated)."""
    radius = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    w /= w.sum()

    def f(_: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.convolve(np.pad(v, radius, mode="symmetric"), w, "valid")

    return with_margin(df, f, radius)


def moving_median(df: DataFrame, half: int) -> DataFrame:
    """Median of up to 2 * half + 1 values around each; at the ends of what there is."""

    def f(_: np.ndarray, v: np.ndarray) -> np.ndarray:
        p = np.pad(v, half, constant_values=np.nan)
        return np.nanmedian(np.lib.stride_tricks.sliding_window_view(p, 2 * half + 1), axis=1)

    return with_margin(df, f, half)


def savitzky_golay(df: DataFrame, window: int, degree: int) -> DataFrame:
    """Least-squares polynomial smoothing; at the ends the end window's polynomial holds."""
    half = window // 2
    x = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(x, degree + 1, increasing=True))

    def f(_: np.ndarray, v: np.ndarray) -> np.ndarray:
        if len(v) < window:
            return v
        out = np.convolve(v, fit[0][::-1], "same")
        ends = np.vander(x, degree + 1, increasing=True)
        out[:half] = (ends @ (fit @ v[:window]))[:half]
        out[-half:] = (ends @ (fit @ v[-window:]))[-half:]
        return out

    return with_margin(df, f, window)


def differences(df: DataFrame) -> DataFrame:
    """value[t] - value[t - 1] where both are there."""
    prev = df.select("key", (F.col("t") + 1).alias("t"), F.col("value").alias("_p"))
    return df.join(prev, ["key", "t"]).select("key", "t", (F.col("value") - F.col("_p")).alias("value"))


def rolled(df: DataFrame, shift: Column) -> DataFrame:
    """Circular shift: the value at t moves to t + shift, modulo the series' length."""
    n = df.groupBy("key").agg((F.max("t") + 1).alias("_n"))
    return df.join(n, "key").select("key", F.pmod(F.col("t") + shift, F.col("_n")).alias("t"), "value")


def shuffled_blocks(df: DataFrame, blocks: int, a: int = 7, b: int = 3) -> DataFrame:
    """The series cut into equal blocks that change places: block k goes to (a k + b) mod blocks (a
    and blocks must have no common divisor). What the blocks leave over stays at the end."""
    if math.gcd(a, blocks) != 1:
        raise ValueError("a and blocks have a common divisor")
    n = df.groupBy("key").agg(F.floor((F.max("t") + 1) / blocks).alias("_w"))
    k = F.floor(F.try_divide(F.col("t"), F.col("_w")))
    moved = F.when(k < blocks, F.pmod(k * a + b, F.lit(blocks)) * F.col("_w") + F.col("t") - k * F.col("_w")).otherwise(F.col("t"))
    return df.join(n, "key").select("key", F.coalesce(moved, F.col("t")).alias("t"), "value")


def double_exponential(t: Column, rise: float, decay: float) -> Column:
    """Unit-peak kernel of rise and decay constants; 0 before its start."""
    peak = rise * decay / (decay - rise) * math.log(decay / rise)
    top = math.exp(-peak / decay) - math.exp(-peak / rise)
    return F.when(t < 0, 0.0).otherwise((F.exp(-t / decay) - F.exp(-t / rise)) / top)


def occupancy(df: DataFrame, x: str, y: str, bins: int, lo: float, hi: float, value: str | None = None) -> DataFrame:
    """(bin_x, bin_y, n, rate): 2-D histogram, and the mean value per bin."""
    place = lambda c: F.least(F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    inside = df.filter(F.col(x).between(lo, hi) & F.col(y).between(lo, hi))
    rate = F.avg(value) if value else F.lit(None).cast("double")
    return inside.groupBy(place(x).alias("bin_x"), place(y).alias("bin_y")).agg(F.count("*").alias("n"), rate.alias("rate"))


def spatial_information(rate_map: DataFrame) -> DataFrame:
    """Bits per event: sum of p (r / mean) log2(r / mean) over bins of positive rate; at least 0."""
    total = rate_map.agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("rate")) / F.sum("n")).alias("_m"))
    each = rate_map.crossJoin(F.broadcast(total))
    q = F.try_divide(F.col("rate"), F.col("_m"))
    return each.agg(F.greatest(F.lit(0.0), F.coalesce(F.sum(F.when((F.col("rate") > 0) & (F.col("_m") > 0), F.col("n") / F.col("_n") * q * F.log2(q))), F.lit(0.0))).alias("information"))


def place_fields(rate_map: DataFrame, factor: float = 1.5) -> DataFrame:
    """Bins whose rate exceeds factor times the occupancy-weighted mean."""
    mean = rate_map.agg((F.sum(F.col("n") * F.col("rate")) / F.sum("n")).alias("_m"))
    return rate_map.crossJoin(F.broadcast(mean)).filter(F.col("rate") > factor * F.col("_m")).drop("_m")


def trial_frames(trials: DataFrame, order: Sequence[str], n: int, duration: int | None = None) -> DataFrame:
    """(trial, start, end): a trial ends after duration, at the next start or at n, whichever is first."""
    ranked = global_rank(trials, [], [*order], "_i")
    nxt = ranked.select((F.col("_i") - 1).alias("_i"), F.col("start").alias("_next"))
    end = F.coalesce("_next", F.lit(n)) if duration is None else F.least(F.col("start") + duration, F.lit(n))
    return ranked.join(nxt, "_i", "left").withColumn("end", end.cast("long")).drop("_i", "_next")
