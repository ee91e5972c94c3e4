"""Events as ridges of a wavelet transform.

A chunk of frames with a margin is min-max scaled by its source, smoothed and transformed at scales
that grow by a fixed ratio. Local maxima of each scale are linked, from fine to coarse, to ridges:
a maximum goes on the ridge whose last place lies within the scale's time, the larger one if there
are several; maxima that find no ridge begin one. Ridges that are long, reach a scale and a height
and don't last too long are events; an event belongs to the chunk in which its peak lies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.signal import minmax


@dataclass(frozen=True)
class RidgeLimits:
    """Parameters of ridge events, in frames where they are times."""

    sigma: float = 3.0  # smoothing before the transform
    finest: float = 3.0  # scale of the finest wavelet
    ratio: float = 1.12  # of neighbouring scales
    scales: int = 25
    length: int = 12  # a ridge covers so many scales,
    reach: int = 6  # rises to at least this one (counted from the finest)
    height: float = 0.04  # and to this value of the transform
    longest: int = 200  # an event lasts at most so long


def ricker(scale: float) -> np.ndarray:
    t = np.arange(-int(5 * scale), int(5 * scale) + 1) / scale
    return (1 - t * t) * np.exp(-t * t / 2) * (2 / (np.sqrt(3) * np.pi**0.25)) / np.sqrt(scale)


def transform(x: np.ndarray, limits: RidgeLimits) -> tuple[np.ndarray, np.ndarray]:
    """(scales, coefficients), heights comparable between scales."""
    s = limits.finest * limits.ratio ** np.arange(limits.scales)
    out = np.zeros((len(s), len(x)))
    for k, scale in enumerate(s):
        w = ricker(scale)
        half = len(w) // 2
        full = np.convolve(np.pad(x, half, mode="edge"), w, "valid")
        out[k] = full / np.sqrt(scale)
    return s, out


def maxima(row: np.ndarray) -> np.ndarray:
    inner = (row[1:-1] > row[:-2]) & (row[1:-1] >= row[2:]) & (row[1:-1] > 0)
    return np.flatnonzero(inner) + 1


def ridges(scales: np.ndarray, c: np.ndarray) -> list[list[tuple[int, int, float]]]:
    """Each ridge as (scale number, place, height) from fine to coarse."""
    done: list[list[tuple[int, int, float]]] = []
    live: list[list[tuple[int, int, float]]] = []
    for k, scale in enumerate(scales):
        places = maxima(c[k])
        taken, grown = set(), []
        # stronger ridges choose first
        for r in sorted(live, key=lambda r: -r[-1][2]):
            at = r[-1][1]
            near = [p for p in places[np.searchsorted(places, at - scale) : np.searchsorted(places, at + scale, side="right")] if p not in taken]
            if near:
                best = max(near, key=lambda p: (c[k, p], -abs(p - at)))
                taken.add(best)
                r.append((k, int(best), float(c[k, best])))
                grown.append(r)
            else:
                done.append(r)
        live = grown + [[(k, int(p), float(c[k, p]))] for p in places if p not in taken]
    return done + live


def ridge_events(x: np.ndarray, limits: RidgeLimits) -> list[tuple[int, int, int, float, float]]:
    """(start, end, peak, scale, height) of the events of a scaled signal."""
    if len(x) < 3:
        return []
    radius = int(4 * limits.sigma + 0.5)
    g = np.exp(-0.5 * (np.arange(-radius, radius + 1) / limits.sigma) ** 2)
    smooth = np.convolve(np.pad(x, radius, mode="edge"), g / g.sum(), "valid")
    s, c = transform(smooth, limits)
    out = []
    for r in ridges(s, c):
        k, peak, height = max(r, key=lambda p: p[2])
        if len(r) < limits.length or k < limits.reach or height < limits.height:
            continue
        # the event lasts while the transform at the ridge's scale is above zero
        row = c[k]
        left, right = peak, peak
        while left > 0 and row[left - 1] > 0:
            left -= 1
        while right < len(row) - 1 and row[right + 1] > 0:
            right += 1
        if right + 1 - left <= limits.longest:
            out.append((left, right + 1, peak, float(s[k]), height))
    return sorted(set(out), key=lambda e: (e[2], -e[4]))


def events(df: DataFrame, limits: RidgeLimits | None = None, chunk: int = 4096, margin: int = 512) -> DataFrame:
    """(key, start, end, peak, scale, height) of rows (key, t, value) with gapless places."""
    limits = limits or RidgeLimits()
    scaled = minmax(df)
    own, at = F.floor(F.col("t") / chunk), F.pmod("t", F.lit(chunk))
    near = F.array_compact(F.array(F.when(at < margin, own - 1), own, F.when(at >= chunk - margin, own + 1)))
    kind = df.schema["key"].dataType
    schema = T.StructType([T.StructField("key", kind)] + [T.StructField(n, T.LongType()) for n in ("start", "end", "peak")] + [T.StructField(n, T.DoubleType()) for n in ("scale", "height")])

    def run(table: pa.Table) -> pa.Table:
        b = table.column("_chunk")[0].as_py()
        t, v = table.column("t").to_numpy(), table.column("value").to_numpy()
        order = np.argsort(t, kind="stable")
        t, v = t[order], v[order]
        found = [e for e in ridge_events(v, limits) if b * chunk <= t[e[2]] < (b + 1) * chunk]
        key = table.column("key").combine_chunks()
        cols = [t[[e[0] for e in found]], t[[e[1] - 1 for e in found]] + 1, t[[e[2] for e in found]]] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(
            {"key": key.take(pa.array(np.zeros(len(found), np.int64))), "start": cols[0], "end": cols[1], "peak": cols[2], "scale": pa.array([e[3] for e in found], pa.float64()), "height": pa.array([e[4] for e in found], pa.float64())}
        )

    return scaled.select("key", "t", "value", F.explode(near).alias("_chunk")).groupBy("key", "_chunk").applyInArrow(run, schema)
