"""Readings at fault: spikes, stuck values and impossible values, judged per source.

The readings of a source are cut into chunks of consecutive positions that overlap by a margin, so
that a source may be as large as the table. A chunk is ordered, deliveries are made one, and a
season, where the autocorrelation of the chunk's residuals shows one, is taken off by the medians of
its phases. Every reading gets a height: its distance to the nearer of the local levels before and
after it, in units of the chunk's noise, for runs of up to three readings. The level is a running
median, which follows transients, lasting shifts and seasons that are longer than its window.

Heights are declustered to one peak for each run of raised readings. All peaks of a source are
counted in bins of two percent, which add up over chunks; a generalised Pareto tail is fitted to the
peaks over a threshold by probability-weighted moments and gives the cutoff at a fixed risk. So that
the spikes that are looked for don't set the tail, the fit begins with the peaks that plain normal
noise could have and takes in those beyond as far as the fitted tail itself reaches. A source's peaks
are joined by a fixed number of peaks of its field's sources and of normal noise, so short sources
lean on the others and long ones on themselves, without any switch between the two.

Defined results
- null and NaN readings are never at fault and break no run; a null source or position is left out
- readings delivered twice at one position count once (the greatest value, should they differ)
- a gap of more than MARGIN positions begins a new local context
- infinite readings and readings beyond the source's plausible range are always at fault
- a source whose values normally repeat has no stuck runs; a source without noise gets the least
  noise of its number format
- a spike needs a reading before and one after it, so sources of less than three have none
- an empty table gives an empty result
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.session import cut

#: Positions per chunk and overlap on either side; a chunk is what one call of Python sees.
CHUNK, MARGIN = 4096, 64
#: Readings on either side from which a local level is taken, and the longest spike.
SIDE, LONGEST = 5, 3
#: Bins in which peaks are counted: log-spaced from LOWEST noise units, BINS_PER_E per factor e.
LOWEST, BINS_PER_E, BINS = 0.25, 50, 800
#: Readings within so many noise units are within usual noise, whatever their source: never spikes.
USUAL = 2.0
#: Share of the peaks below the threshold over which the tail is fitted.
THRESHOLD = 0.95
#: The fit takes in peaks up to this multiple of its cutoff, and shapes of the tail between these.
BEYOND, SHAPES = 1.25, (-0.1, 0.5)
#: Readings' worth of peaks by which the field's sources, and normal noise, join those of a source.
OF_FIELD, OF_NORMAL = 5_000, 200
#: A season needs so many cycles in a chunk and so much autocorrelation at its length.
CYCLES, SEASONAL = 4, 0.35


@dataclass(frozen=True)
class Limits:
    """Parameters of one kind of reading."""

    stuck: int = 10  # readings in a run of one value
    risk: float = 1e-6  # chance of a sound reading beyond the cutoff
    returns: float = 0.35  # levels before and after differ by at most this share of its height
    reach: float = 60.0  # plausible range: so many times the source's usual range
    repeats: float = 0.5  # sources that repeat values in more than this share never stick
    floor: float = 1e-4  # noise is at least this share of the level's size


def _runs(change: np.ndarray) -> np.ndarray:
    """Length of the run in which each element lies; change: True at a run's first element."""
    starts = np.flatnonzero(change)
    lengths = np.diff(np.append(starts, len(change)))
    return np.repeat(lengths, lengths)


def _ordered(t: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Readings in order, one per position (the greatest), missing ones left out."""
    ok = ~np.isnan(v)
    t, v = t[ok], v[ok]
    order = np.lexsort((v, t))
    t, v = t[order], v[order]
    last = np.append(t[1:] != t[:-1], True) if len(t) else np.zeros(0, bool)
    return t[last], v[last]


def _medians(x: np.ndarray, width: int) -> np.ndarray:
    """Medians of x[i : i + width] for every i at which the window fits (odd width)."""
    return np.partition(np.lib.stride_tricks.sliding_window_view(x, width), width // 2, axis=1)[:, width // 2]


def noise(x: np.ndarray, floor: float) -> float:
    """Robust scale of the step-to-step noise."""
    d = np.abs(np.diff(x))
    d = d[np.isfinite(d)]
    size = float(np.median(np.abs(x[np.isfinite(x)]))) if np.isfinite(x).any() else 0.0
    least = max(floor * size, 1e-9)
    return max(float(np.median(d)) * 1.4826 / np.sqrt(2), least) if len(d) else least


def heights(x: np.ndarray, scale: float, share: float) -> np.ndarray:
    """For each reading the height, in noise units, of the best spike that it could be part of: a
    run of one to three readings, all on one side of the levels before and after, which agree."""
    n = len(x)
    best = np.zeros(n)
    if n < 3:
        return best
    width = min(SIDE, (n - 1) // 2)
    width -= 1 - width % 2
    pad = np.concatenate([np.full(width, x[0]), x, np.full(width, x[-1])])
    med = _medians(pad, width)  # med[i]: median of x[i - width : i]
    edge = np.concatenate([x[:1], x, x[-1:]])
    for run in range(1, LONGEST + 1):
        if n < run + 2:
            break
        m = n - run + 1  # starts
        before, after = med[:m], med[width + run : width + run + m]
        low, high = np.minimum(before, after), np.maximum(before, after)
        seg_min, seg_max = x[:m].copy(), x[:m].copy()
        for k in range(1, run):
            np.minimum(seg_min, x[k : k + m], out=seg_min)
            np.maximum(seg_max, x[k : k + m], out=seg_max)
        h = np.maximum(seg_min - high, low - seg_max)
        ok = (h > 0) & (high - low <= share * h)
        # back at once: the readings on either side lie with the levels; a transient that rises on
        # the remains of another one comes back to the level before it, but slowly
        prev, following = edge[:m], edge[run + 1 : run + 1 + m]
        h = np.maximum(seg_min - np.maximum(high, np.maximum(prev, following)), np.minimum(low, np.minimum(prev, following)) - seg_max)
        ok &= h > 0
        h = np.where(ok, h, 0.0) / scale
        for k in range(run):
            np.maximum(best[k : k + m], h, out=best[k : k + m])
    return best


def season_of(t: np.ndarray, x: np.ndarray, scale: float) -> int:
    """Length of the season in positions, 0 if there is none: the lag of greatest autocorrelation of
    the residuals about the running median, if that is high there and at twice the lag."""
    n = int(t[-1] - t[0]) + 1 if len(t) else 0
    if len(t) < 4 * CYCLES or n > 4 * (CHUNK + 2 * MARGIN):
        return 0
    pad = np.concatenate([np.full(SIDE // 2, x[0]), x, np.full(SIDE // 2, x[-1])])
    r = np.clip(x - _medians(pad, SIDE), -20 * scale, 20 * scale)
    grid, there = np.zeros(n), np.zeros(n)
    grid[t - t[0]], there[t - t[0]] = r - r.mean(), 1.0
    size = 1 << (2 * n - 1).bit_length()
    power = lambda v: np.fft.irfft(np.abs(np.fft.rfft(v, size)) ** 2, size)[: n // 2 + 1]
    both, pairs = power(grid), np.maximum(power(there), 1.0)
    if both[0] <= 0:
        return 0
    r = both / pairs / (both[0] / pairs[0])
    lags = np.arange(2, n // CYCLES + 1)
    if not len(lags):
        return 0
    # a season's multiples are as high as itself
    lag = int(lags[np.argmax(r[lags] >= 0.85 * r[lags].max())])
    return lag if r[lag] >= SEASONAL and r[2 * lag] >= SEASONAL / 2 else 0


def deseasoned(t: np.ndarray, x: np.ndarray, season: int) -> np.ndarray:
    """x without the medians, by phase, of its distance to the running median."""
    pad = np.concatenate([np.full(season // 2, x[0]), x, np.full(season // 2, x[-1])])
    level = _medians(pad, season // 2 * 2 + 1)
    off, phase = x - level, t % season
    order = np.lexsort((off, phase))
    first = np.flatnonzero(np.append(True, np.diff(phase[order]) != 0))
    many = np.diff(np.append(first, len(x)))
    middle = (off[order][first + (many - 1) // 2] + off[order][first + many // 2]) / 2
    profile = np.zeros(season)
    profile[phase[order][first]] = middle
    return x - profile[phase]


def peaks(h: np.ndarray) -> np.ndarray:
    """The greatest height of each run of raised readings, at its place; 0 elsewhere."""
    up = h > 0
    run = np.cumsum(up & ~np.append(False, up[:-1])) * up
    out = np.zeros(len(h))
    order = np.lexsort((h, run))
    last = order[np.append(run[order][1:] != run[order][:-1], True)] if len(h) else order
    last = last[run[last] > 0]
    out[last] = h[last]
    return out


def binned(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, count) of the heights above 0."""
    h = h[h > 0]
    return np.unique(np.clip((np.log(h / LOWEST) * BINS_PER_E).astype(int), 0, BINS - 1), return_counts=True)


def analyse(t: np.ndarray, v: np.ndarray, lo: int, hi: int, limits: Limits, season: int | None = None) -> tuple[dict, tuple]:
    """Sums of a chunk, and its readings that could be at fault: position, value, height, stuck.
    Only positions in [lo, hi) are the chunk's own. season: its length if known, 0 for none."""
    t, v = _ordered(t, v)
    own = (t >= lo) & (t < hi)
    empty = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, bool))
    if not own.any():
        return {"n": 0}, empty
    finite = np.isfinite(v)
    # what can't be is left out before the levels are taken, else it would hide a neighbour
    mid = float(np.median(v[finite])) if finite.any() else 0.0
    q = np.quantile(v[finite], [0.02, 0.5, 0.98]) if finite.any() else np.zeros(3)
    scale = noise(v[finite], limits.floor) if finite.any() else 1.0
    spread = max(q[2] - q[0], 20 * scale)
    wild = ~finite | (np.abs(np.where(finite, v, 0.0) - mid) > limits.reach * spread)
    h = np.zeros(len(v))
    calm = ~wild
    x = v[calm]
    found = season_of(t[calm], x, scale) if season is None else season
    if found:
        x = deseasoned(t[calm], x, found)
        scale = noise(x, limits.floor)
    h[calm] = heights(x, scale, limits.returns)
    change = np.append(True, v[1:] != v[:-1])
    stuck = _runs(change) >= limits.stuck
    equal = ~change
    bins, counts = binned(peaks(h)[own & calm])
    pick = own & (wild | (h >= USUAL) | stuck)
    sums = {
        "n": int(own.sum()), "bins": bins.tolist(), "counts": counts.tolist(), "repeats": int((equal & own & ~stuck).sum()), "stuck": int((stuck & own).sum()),
        "mid": mid, "spread": float(spread), "scale": float(scale),
    }
    return sums, (t[pick], v[pick], h[pick], stuck[pick])


#: One row of sums per chunk, then its readings that could be at fault.
_SUMS = [("n", pa.int64()), ("bins", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("repeats", pa.int64()), ("n_stuck", pa.int64()), ("mid", pa.float64()), ("spread", pa.float64())]
_OUT = pa.schema([("source_id", pa.string()), ("t", pa.int64()), ("v", pa.float64()), ("height", pa.float64()), ("stuck", pa.bool_()), *_SUMS])


def _chunk(limits: Limits, chunk: int, season: int | None):
    def run(table: pa.Table) -> pa.Table:
        source = table.column("source_id")[0].as_py()
        b = table.column("_chunk")[0].as_py()
        sums, picked = analyse(table.column("t").to_numpy(), table.column("v").to_numpy(), b * chunk, (b + 1) * chunk, limits, season)
        k = len(picked[0])
        first = np.append(True, np.zeros(k, bool))
        cols = [pa.array([source] * (k + 1), pa.string())]
        cols += [pa.array(np.append(np.zeros(1, c.dtype), c), f.type, mask=first) for c, f in zip(picked, list(_OUT)[1:5])]
        head = [sums["n"]] + ([sums["bins"], sums["counts"], sums["repeats"], sums["stuck"], sums["mid"], sums["spread"]] if sums["n"] else [None] * 6)
        cols += [pa.concat_arrays([pa.array([x], kind), pa.nulls(k, kind)]) for x, (_, kind) in zip(head, _SUMS)]
        return pa.table(cols, schema=_OUT)

    return run


def cutoff_at(counts: np.ndarray, n: float, risk: float, start: float) -> float:
    """Height that a sound reading exceeds with the probability risk, from the counts of peaks among n
    readings. Only peaks up to start make the first fit, peaks up to its cutoff the next, and so on
    until the fit keeps the very peaks that it was made from."""
    middle = LOWEST * np.exp((np.arange(BINS) + 0.5) / BINS_PER_E)
    cutoff, kept = start, -1
    for _ in range(50):
        # a little beyond the cutoff, else the tail would be cut where it is to be told
        last, kept = kept, int(np.searchsorted(middle, cutoff * BEYOND, side="right"))
        total = counts[:kept].sum()
        if kept == last or total <= 0:
            return cutoff
        below = int(np.searchsorted(np.cumsum(counts[:kept]), THRESHOLD * total)) + 1
        u, w = middle[below - 1], counts[below:kept]
        if w.sum() <= 0:
            return cutoff
        x, w_all = middle[below:kept] - u, w.sum()
        above = (np.cumsum(w[::-1])[::-1] - w / 2) / w_all
        a0, a1 = (w * x).sum() / w_all, (w * x * above).sum() / w_all
        shape = float(np.clip(2 - a0 / max(a0 - 2 * a1, 1e-12), *SHAPES))
        sigma, ratio = a0 * (1 - shape), max(w_all / n / risk, 1.0)
        cutoff = float(u + (sigma / shape * (ratio**shape - 1) if abs(shape) > 1e-6 else sigma * np.log(ratio)))
    return cutoff


@lru_cache(maxsize=8)
def of_normal_noise(risk: float) -> tuple[np.ndarray, float]:
    """Peaks per reading of normal noise, by bin, and their cutoff."""
    x = np.random.default_rng(0).normal(size=60_000)
    bins, k = binned(peaks(heights(x, noise(x, 0.0), Limits.returns)))
    rate = np.bincount(bins, k, BINS) / len(x)
    return rate, cutoff_at(rate, 1.0, risk, np.inf)


def cutoffs(bins: np.ndarray, counts: np.ndarray, n: float, of_field: np.ndarray, risk: float) -> float:
    """A source's cutoff. of_field: peaks per reading of all sources of its field."""
    normal, start = of_normal_noise(risk)
    own = np.bincount(bins, counts, BINS)
    return cutoff_at(own + OF_FIELD * of_field + OF_NORMAL * normal, n + OF_FIELD + OF_NORMAL, risk, start)


def sound_rate(rate: np.ndarray, risk: float) -> np.ndarray:
    """Peaks per reading of a field's sources without those beyond their common cutoff."""
    normal, start = of_normal_noise(risk)
    middle = LOWEST * np.exp((np.arange(BINS) + 0.5) / BINS_PER_E)
    return np.where(middle <= cutoff_at(rate + OF_NORMAL / OF_FIELD * normal, 1.0 + OF_NORMAL / OF_FIELD, risk, start), rate, 0.0)


def faults(readings: DataFrame, source: str, position: str, value: str, limits: Limits | None = None, chunk: int = CHUNK, season: int | None = None) -> DataFrame:
    """(source_id, t, v, height, cutoff, reason) of the readings at fault; position is a bigint that
    counts readings or frames. season: its length in positions where it is known (0: none); else each
    chunk looks for one."""
    limits = limits or Limits()
    rows = readings.select(
        F.col(source).cast("string").alias("source_id"), F.col(position).cast("long").alias("t"), F.col(value).cast("double").alias("v")
    ).filter(F.col("source_id").isNotNull() & F.col("t").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    own, at = F.floor(F.col("t") / chunk), F.pmod("t", F.lit(chunk))
    near = F.when(at < MARGIN, F.array(own - 1, own)).when(at >= chunk - MARGIN, F.array(own, own + 1)).otherwise(F.array(own))
    spread = rows.select("source_id", F.explode(near).alias("_chunk"), "t", "v")
    schema = "source_id string, t long, v double, height double, stuck boolean, n long, bins array<long>, counts array<long>, repeats long, n_stuck long, mid double, spread double"
    parts = cut(spread.groupBy("source_id", "_chunk").applyInArrow(_chunk(limits, chunk, season), schema))

    # one row per chunk: counts add up bin by bin, levels and ranges by their medians
    sums = parts.filter(F.col("n") > 0)
    usual = sums.groupBy("source_id").agg(
        F.sum("n").alias("n_all"), F.sum("repeats").alias("n_repeats"), F.sum("n_stuck").alias("all_stuck"),
        F.percentile_approx("mid", 0.5, 1000).alias("mid_all"), F.percentile_approx("spread", 0.5, 1000).alias("spread_all"),
    )
    peaked = sums.select("source_id", F.explode(F.arrays_zip("bins", "counts")).alias("_b")).groupBy("source_id", "_b.bins").agg(F.sum("_b.counts").alias("k"))
    # of each source at most BINS rows
    tails = peaked.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("bins", "k"))).alias("_t"))
    sources = cut(usual.join(tails, "source_id", "left"))
    # peaks per reading, each source counting alike: BINS rows at most
    shares = sources.select("n_all", F.explode("_t").alias("_b")).groupBy("_b.bins").agg(F.sum(F.col("_b.k") / F.col("n_all")).alias("rate")).collect()
    rate, many = np.zeros(BINS), max(sources.count(), 1)
    for r in shares:
        rate[r.bins] = r.rate / many
    of_field = sound_rate(rate, limits.risk)

    @F.pandas_udf(T.DoubleType())
    def cutoff(n: pd.Series, bins: pd.Series, counts: pd.Series) -> pd.Series:
        none = np.zeros(0, np.int64)
        return pd.Series([cutoffs(none if b is None else b, none if k is None else k, m, of_field, limits.risk) for m, b, k in zip(n, bins, counts)])

    judged = parts.filter(F.col("t").isNotNull()).select("source_id", "t", "v", "height", "stuck").join(sources.withColumn("cutoff", cutoff("n_all", "_t.bins", "_t.k")).drop("_t"), "source_id")
    apart = F.abs(F.col("v")) == float("inf")
    wild = apart | (F.abs(F.col("v") - F.col("mid_all")) > limits.reach * F.col("spread_all"))
    sticks = F.col("stuck") & (F.col("n_repeats") <= limits.repeats * (F.col("n_all") - F.col("all_stuck"))) & (F.col("all_stuck") <= limits.repeats * F.col("n_all"))
    reason = F.when(wild, "impossible").when((F.col("height") >= USUAL) & (F.col("height") > F.col("cutoff")), "spike").when(sticks, "stuck")
    return judged.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("source_id", "t", "v", "height", "cutoff", "reason")
