"""Shapes of events: decay constants, onset amplitudes by non-negative least squares, complexity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An accepted decay fit, in seconds and share of variance.
DECAY_RANGE, LEAST_R2 = (0.1, 30.0), 0.8


def decay_constants(df: DataFrame, events: DataFrame, fps: float, after: int = 20) -> DataFrame:
    """(key, start, end, tau, r2): log-linear fit from an event's peak over the `after` next frames
    above zero; fits outside the accepted range are left out."""
    frames = events.withColumn("t", F.explode(F.sequence(F.col("start"), F.col("end") + after)))
    hit = frames.join(df, ["key", "t"]).filter("value > 0")
    # the first frame of the greatest value
    peak = hit.filter(F.col("t") < F.col("end")).groupBy("key", "start", "end").agg(F.max(F.struct("value", (-F.col("t")).alias("_t"))).alias("_p"))
    tail = hit.join(peak.select("key", "start", "end", (-F.col("_p._t")).alias("_peak")), ["key", "start", "end"]).filter((F.col("t") >= F.col("_peak")) & (F.col("t") <= F.col("_peak") + after))
    y, x = F.ln("value"), (F.col("t") - F.col("_peak")) / F.lit(fps)
    fit = tail.groupBy("key", "start", "end").agg(F.regr_slope(y, x).alias("_b"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("_n"))
    tau = F.try_divide(F.lit(-1.0), F.col("_b"))
    return fit.withColumn("tau", tau).filter((F.col("_n") >= 3) & F.col("tau").between(*DECAY_RANGE) & (F.col("r2") >= LEAST_R2)).select("key", "start", "end", "tau", "r2")


def nnls(a: np.ndarray, y: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Non-negative least squares by the active set method."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    w = a.T @ (y - a @ x)
    for _ in range(rounds):
        if passive.all() or w[~passive].max(initial=-1) <= 1e-10:
            break
        passive[np.where(~passive, w, -np.inf).argmax()] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], y, rcond=None)[0]
            if s[passive].min() > 0:
                break
            bad = passive & (s <= 0)
            step = (x[bad] / (x[bad] - s[bad] + 1e-300)).min()
            x = x + step * (s - x)
            passive &= x > 1e-12
            if not passive.any():
                break
        x = np.where(passive, s, 0)
        w = a.T @ (y - a @ x)
    return x


def onset_amplitudes(df: DataFrame, onsets: DataFrame, fps: float, rise: float = 0.25, decay: float = 2.0, baseline: float = 0.1) -> DataFrame:
    """(key, onset, amplitude): amplitudes of unit-peak double exponentials at the onsets that add up
    to the signal above its baseline (a quantile) best. A series and its onsets come whole into one call."""
    kind = df.schema["key"].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("onset", T.LongType()), T.StructField("amplitude", T.DoubleType())])
    t = np.arange(0, 5 * decay, 1 / fps)
    kernel = np.exp(-t / decay) - np.exp(-t / rise)
    kernel /= kernel.max()

    def run(key: tuple, x: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(o):
            return pd.DataFrame({"key": pd.Series([], dtype=object), "onset": pd.Series([], dtype="int64"), "amplitude": pd.Series([], dtype=float)})
        x = x.sort_values("t")
        t0, n = int(x["t"].iloc[0]), int(x["t"].iloc[-1] - x["t"].iloc[0]) + 1
        y = np.zeros(n)
        y[x["t"].to_numpy() - t0] = x["value"].to_numpy() - x["value"].quantile(baseline)
        starts = np.sort(o["onset"].to_numpy()) - t0
        starts = starts[(starts >= 0) & (starts < n)]
        a = np.zeros((n, len(starts)))
        for k, s in enumerate(starts):
            m = min(len(kernel), n - s)
            a[s : s + m, k] = kernel[:m]
        return pd.DataFrame({"key": key[0], "onset": starts + t0, "amplitude": nnls(a, y)})

    return df.groupBy("key").cogroup(onsets.groupBy("key")).applyInPandas(run, schema)


@F.pandas_udf(T.DoubleType())
def approximate_entropy(values: pd.Series, m: pd.Series, r: pd.Series) -> pd.Series:
    """Of each array of readings: phi(m) - phi(m + 1) with tolerance r times the deviation."""

    def phi(x: np.ndarray, m: int, r: float) -> float:
        e = np.lib.stride_tricks.sliding_window_view(x, m)
        c = np.array([(np.abs(e - p).max(axis=1) <= r).mean() for p in e])
        return float(np.log(c).mean())

    def one(v, m, r) -> float:
        x = np.asarray(v, float)
        if len(x) < m + 2 or x.std() == 0:
            return 0.0
        return phi(x, m, r * x.std()) - phi(x, m + 1, r * x.std())

    return pd.Series([one(a, int(b), float(c)) for a, b, c in zip(values, m, r)])


def _digamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x, float)
    x = x.astype(float).copy()
    for _ in range(6):
        out -= 1 / x
        x += 1
    z = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z / 240)))


def ksg(x: np.ndarray, y: np.ndarray, k: int = 5) -> float:
    """Mutual information of two series by nearest neighbours (first estimator of Kraskov, Stoegbauer
    and Grassberger), in bits. Ties are broken by a tiny slope, so that any run agrees."""
    n = len(x)
    if n <= k + 1:
        return 0.0
    x = x + 1e-10 * (np.arange(n) * 0.6180339887 % 1) * (x.std() or 1)
    y = y + 1e-10 * (np.arange(n) * 0.7548776662 % 1) * (y.std() or 1)
    dx, dy = np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :])
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    eps = np.partition(d, k - 1, axis=1)[:, k - 1]
    nx, ny = (dx < eps[:, None]).sum(axis=1) - 1, (dy < eps[:, None]).sum(axis=1) - 1
    value = _digamma(np.array([k]))[0] + _digamma(np.array([n]))[0] - (_digamma(nx + 1) + _digamma(ny + 1)).mean()
    return float(max(0.0, value / math.log(2)))


@F.pandas_udf(T.DoubleType())
def ksg_information(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ksg(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def neighbour_entropy(values: pd.Series, k: pd.Series) -> pd.Series:
    """Entropy of each array of readings from the distance to the k-th neighbour (Kozachenko and
    Leonenko), in bits. Ties are broken by a tiny slope, so that any run agrees."""

    def one(v, k: int) -> float | None:
        x = np.asarray(v, float)
        n = len(x)
        if n <= k + 1:
            return None
        x = np.sort(x + 1e-10 * (np.arange(n) * 0.6180339887 % 1) * (x.std() or 1))
        # the k-th neighbour is among the k before and the k after
        near = np.full((n, 2 * k), np.inf)
        for j in range(1, k + 1):
            d = x[j:] - x[:-j]
            near[j:, j - 1], near[:-j, k + j - 1] = d, d
        eps = np.sort(near, axis=1)[:, k - 1]
        return float((_digamma(np.array([n]))[0] - _digamma(np.array([k]))[0] + np.log(2 * eps).mean()) / math.log(2))

    return pd.Series([one(v, int(c)) for v, c in zip(values, k)])


def rise_constants(df: DataFrame, events: DataFrame, fps: float, before: int = 20) -> DataFrame:
    """(key, start, end, tau): amplitude over steepest step of the signal on its way to an event's
    peak, smoothed over five frames by parabolas, in seconds; only between 0.01 and 1. The frames
    from `before` ahead of the peak on are taken, an event's few rows at a time."""
    frames = events.withColumn("t", F.explode(F.sequence(F.col("start") - before, F.col("end") - 1))).join(df, ["key", "t"])
    top = F.array_max(F.filter("_a", lambda x: x["t"] >= F.col("start"))["value"])
    rows = frames.groupBy("key", "start", "end").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("_a"))
    peak = F.array_min(F.filter("_a", lambda x: (x["t"] >= F.col("start")) & (x["value"] == top))["t"])

    @F.pandas_udf(T.DoubleType())
    def tau(rise: pd.Series) -> pd.Series:
        def one(v) -> float | None:
            x = np.asarray(v, float)
            if len(x) < 5:
                return None
            # weights of the parabola through five frames, which at the ends holds for them as well
            a = np.vander(np.arange(-2, 3), 3, increasing=True)
            hat = a @ np.linalg.pinv(a)
            y = np.convolve(x, hat[2][::-1], "same")
            y[:2], y[-2:] = (hat @ x[:5])[:2], (hat @ x[-5:])[-2:]
            steep, height = np.gradient(y).max() * fps, y[-1] - np.median(y[:5])
            value = height / steep if steep > 1e-6 else -1.0
            return float(value) if height > 0 and 0.01 < value < 1 else None

        return rise.map(one)

    up = rows.withColumn("_p", peak).withColumn("_r", F.transform(F.filter("_a", lambda x: (x["t"] <= F.col("_p")) & (x["t"] > F.col("_p") - before)), lambda x: x["value"]))
    return up.select("key", "start", "end", tau("_r").alias("tau")).filter("tau is not null")


def reconstructed(df: DataFrame, method) -> DataFrame:
    """(key, t, value): each signal, as long as its recording, through a function from its places and
    values to as many values, such as one that takes events out of a signal."""
    kind = df.schema["key"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        out = np.asarray(method(pdf["t"].to_numpy(), pdf["value"].to_numpy(float)), float)
        if out.shape != (len(pdf),):
            raise ValueError("a reconstruction gives one value per place")
        return pd.DataFrame({"key": pdf["key"], "t": pdf["t"], "value": out})

    return df.select("key", "t", "value").groupBy("key").applyInPandas(run, f"key {kind}, t long, value double")
