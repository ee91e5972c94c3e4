"""Units against features: a measure of dependence at every circular shift, and the two-stage test.

Both sides are rows (key, kind, dim, t, x): kind is continuous or discrete, dim numbers the components
of a vector. A series, as long as its session, is one matrix; the series of either side are dealt into
blocks and every two blocks meet once, so each series is transformed once per block it meets and no
key holds all pairs. What leaves a block are a few numbers per pair, never its values at all shifts.

A positive shift rolls the second series: the first one's value at t meets the second's at t - shift.

Defined results
- series of different lengths, constant series and series of fewer than 3 places have no row
- null and NaN readings are left out, and with them a series whose places then aren't whole
- shuffles are not more than the places; with as many, every shift is taken once
- a shift inside the margin of either end, seen from the pair's delay, is drawn again, up to 100 times
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.special import digamma, digamma_value
from tessella.operators.information import cross_correlations
from tessella.operators.selectivity import p_values, thresholds

LN2 = math.log(2)
#: Series of a side that one block holds.
BLOCK = 64
#: Redraws of a shift that falls into the margin.
REDRAWS = 100


@dataclass(frozen=True)
class Series:
    """Components as rows: continuous ones centred, plain ones as they are; discrete series have one
    row per class."""

    kind: str
    x: np.ndarray

    @property
    def n(self) -> int:
        return self.x.shape[1]

    @classmethod
    def of(cls, kind: str, x: np.ndarray) -> Series:
        if kind == "discrete":
            return cls(kind, (np.unique(x[0])[:, None] == x[0][None, :]).astype(float))
        return cls(kind, x if kind == "plain" else x - x.mean(axis=1, keepdims=True))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b, n): the sums of a[i][t] * b[j][t - s] for every shift s."""
    n = a.shape[1]
    return np.fft.irfft(np.fft.rfft(a, axis=1)[:, None] * np.conj(np.fft.rfft(b, axis=1))[None], n, axis=2)


def _bias(n: float, d: int) -> float:
    """What estimating a covariance of d dimensions from n values adds to an entropy, in nats."""
    return sum(digamma_value((n - i) / 2) / 2 for i in range(1, d + 1)) + d * (LN2 - math.log(n - 1)) / 2


def _log_det(c: np.ndarray) -> np.ndarray:
    """Of matrices along the last two axes; degenerate ones give minus infinity."""
    d = np.linalg.det(c)
    return np.log(np.where(d > 1e-15, d, np.nan))


def gaussian(a: Series, b: Series) -> np.ndarray:
    """Information of jointly normal vectors, in bits."""
    n, p, q = a.n, len(a.x), len(b.x)
    joint = np.empty((n, p + q, p + q))
    joint[:, :p, :p], joint[:, p:, p:] = a.x @ a.x.T / (n - 1), b.x @ b.x.T / (n - 1)
    joint[:, :p, p:] = np.moveaxis(products(a.x, b.x), 2, 0) / (n - 1)
    joint[:, p:, :p] = np.swapaxes(joint[:, :p, p:], 1, 2)
    raw = 0.5 * (_log_det(joint[0, :p, :p]) + _log_det(joint[0, p:, p:]) - _log_det(joint))
    return (raw - _bias(n, p) - _bias(n, q) + _bias(n, p + q)) / LN2


def with_classes(a: Series, b: Series) -> np.ndarray:
    """Information between a normal vector and a class: the entropy of all values less that within the
    classes; classes with too few values for a covariance are left out."""
    n, d = a.n, len(a.x)
    pairs = np.array([a.x[i] * a.x[j] for i in range(d) for j in range(d)])
    s1, s2 = products(a.x, b.x), products(pairs, b.x)
    total = 0.5 * _log_det(a.x @ a.x.T / (n - 1)) - _bias(n, d)
    within = np.zeros(n)
    for k, m in enumerate(b.x.sum(axis=1)):
        if m < max(d + 1, 2):
            continue
        mean = np.moveaxis(s1[:, k], 1, 0) / m
        cov = (np.moveaxis(s2[:, k], 1, 0).reshape(n, d, d) - m * mean[:, :, None] * mean[:, None, :]) / (m - 1)
        within += m / n * (0.5 * _log_det(cov) - _bias(m, d))
    return (total - within) / LN2


def of_classes(a: Series, b: Series) -> np.ndarray:
    """Information between two classes, from their joint counts."""
    n, p, q = a.n, a.x.sum(axis=1), b.x.sum(axis=1)
    joint = np.rint(products(a.x, b.x))
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(joint > 0, joint / n * np.log2(joint * n / (p[:, None] * q[None, :])[:, :, None]), 0.0)
    return terms.sum(axis=(0, 1))


def pearson(a: Series, b: Series) -> np.ndarray:
    return products(a.x, b.x)[0, 0] / math.sqrt((a.x[0] @ a.x[0]) * (b.x[0] @ b.x[0]))


def information(a: Series, b: Series) -> np.ndarray:
    """Mutual information for any two kinds, at least 0; null where a covariance is degenerate."""
    if a.kind == b.kind:
        out = of_classes(a, b) if a.kind == "discrete" else gaussian(a, b)
    else:
        # rolling the second by s is rolling the first by -s
        out = with_classes(a, b) if b.kind == "discrete" else np.roll(with_classes(b, a)[::-1], 1)
    return np.maximum(out, 0.0)


def on_off(a: Series, b: Series) -> np.ndarray:
    """Mean of the first (as it is, not centred) where the second's last class holds, over the mean
    elsewhere; null where that is 0."""
    on = products(a.x, b.x[-1:])[0, 0] / b.x[-1].sum()
    off = products(a.x, 1 - b.x[-1:])[0, 0] / (1 - b.x[-1]).sum()
    return np.where(np.abs(off) > 1e-12, on / np.where(off == 0, 1, off), np.nan)


#: The measures by name.
METRICS: dict[str, Callable[[Series, Series], np.ndarray]] = {"mi": information, "pearson": pearson, "av": on_off}


def register(name: str, metric: Callable[[Series, Series], np.ndarray]) -> None:
    """Add a measure: from two Series an array with its value at every shift."""
    METRICS[name] = metric


def metric_by_name(name: str) -> Callable[[Series, Series], np.ndarray]:
    if name not in METRICS:
        raise ValueError(f"no such metric: {name}")
    return METRICS[name]


def matrices(rows: DataFrame) -> DataFrame:
    """(key, kind, n, x): one array of arrays per series, for series whose places are whole."""
    ok = rows.filter(F.col("x").isNotNull() & ~F.isnan("x"))
    lines = ok.groupBy("key", "kind", "dim").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s["x"]).alias("line"), (F.max("t") - F.min("t") + 1).alias("span"), F.count("*").alias("n")
    )
    whole = lines.filter("n = span and n >= 3")
    return whole.groupBy("key", "kind", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "line"))), lambda s: s["line"]).alias("x"))


def _dealt(series: DataFrame, own: str, other: str, n_own: int, n_other: int) -> DataFrame:
    block = F.pmod(F.xxhash64("key"), F.lit(n_own)).cast("int").alias(own)
    return series.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))


def pairs_by_blocks(units: DataFrame, features: DataFrame, run: Callable[[Mapping, Mapping], list[tuple]], fields: Sequence[T.StructField], same: bool = False) -> DataFrame:
    """(unit, feature, ...) for every two series of equal length, same: for u < f of one bunch. run
    gets two mappings from key to Series and gives the rows of their pairs."""
    count = lambda df: max(1, -(-df.count() // BLOCK))
    n_u, n_f = count(units), count(features)
    # the right side under names of its own, as both may be one table
    left, right = _dealt(units, "_u", "_f", n_u, n_f), _dealt(features.toDF(*features.columns), "_f", "_u", n_f, n_u)
    schema = T.StructType([T.StructField("unit", units.schema["key"].dataType), T.StructField("feature", features.schema["key"].dataType), *fields])

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame([], columns=schema.names)
        held = [{k: Series.of(kind, np.array([np.asarray(r, float) for r in x])) for k, kind, x in zip(s["key"], s["kind"], s["x"])} for s in (a, b)]
        # constant series tell nothing
        held = [{k: v for k, v in h.items() if (len(v.x) > 1 if v.kind == "discrete" else (v.x**2).sum(axis=1).min() > 1e-12)} for h in held]
        rows = [(u, f, *r) for u, x in held[0].items() for f, y in held[1].items() if x.n == y.n and (not same or u < f) for r in [run(x, y)] if r is not None]
        return pd.DataFrame(rows, columns=schema.names)

    return left.groupBy("_u", "_f").cogroup(right.groupBy("_u", "_f")).applyInPandas(block, schema)


def at_all_shifts(units: DataFrame, features: DataFrame, metric: str = "mi", same: bool = False) -> DataFrame:
    """(unit, feature, n, values): the measure at every shift. For reports on a few pairs; tests keep
    the values inside their block."""
    f = metric_by_name(metric)
    fields = [T.StructField("n", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType()))]

    def run(a: Series, b: Series) -> tuple:
        return a.n, [None if not math.isfinite(v) else float(v) for v in f(a, b)]

    return pairs_by_blocks(matrices(units), matrices(features), run, fields, same)


def drawn(n: int, k: int, seed: int, delay: int = 0, margin: int = 0) -> np.ndarray:
    """k shifts from whole-number arithmetic, so that any engine agrees; all n of them if k is not
    less than n."""
    if k >= n:
        return np.arange(n)
    i, j = np.arange(1, k + 1, dtype=np.int64)[:, None], np.arange(REDRAWS, dtype=np.int64)[None, :]
    s = (i * 7919 + i * i * 104729 + j * 15485863 + seed) % n
    ok = ((s - delay) % n >= margin) & ((s - delay) % n < n - margin)
    ok[:, -1] |= ~ok.any(axis=1)
    return s[np.arange(k), ok.argmax(axis=1)]


@dataclass(frozen=True)
class Plan:
    """Parameters of the two-stage test."""

    first: int = 100  # shuffles of stage 1
    second: int = 1_000  # and of stage 2
    top: int = 1  # the observed value may be so many-th best in stage 1
    top2: int = 5  # and in stage 2
    window: int = 0  # delays from -window to window, in places
    margin: int = 0  # places at either end at which no shuffle begins
    alpha: float = 0.05
    method: str = "holm"
    tail: str = "gamma_zi"
    metric: str = "mi"
    skip_delays: tuple = ()  # features for which no delay is sought


def shuffled(units: DataFrame, features: DataFrame, plan: Plan, shuffles: int, seed: int, same: bool = False) -> DataFrame:
    """(unit, feature, n, delay, mi, null_mi): the measure at the pair's best delay and at the
    shuffles' shifts, to nine decimals. units and features are matrices."""
    f = metric_by_name(plan.metric)
    fields = [T.StructField("n", T.LongType()), T.StructField("delay", T.IntegerType()), T.StructField("mi", T.DoubleType()), T.StructField("null_mi", T.ArrayType(T.DoubleType()))]

    def run(a: Series, b: Series, window: int = plan.window) -> tuple | None:
        v = np.round(f(a, b), 9)
        if not np.isfinite(v).all():
            v = np.where(np.isfinite(v), v, 0.0)
        around = np.arange(-min(window, a.n // 2), min(window, a.n // 2) + 1)
        delay = int(around[np.argmax(v[around % a.n])]) if window else 0  # the first of equal ones
        return a.n, delay, float(v[delay % a.n]), v[drawn(a.n, shuffles, seed, delay, plan.margin)].tolist()

    if not plan.skip_delays:
        return pairs_by_blocks(units, features, run, fields, same)
    skip = F.col("key").isin(list(plan.skip_delays))
    rest = pairs_by_blocks(units, features.filter(~skip), run, fields, same)
    return rest.unionByName(pairs_by_blocks(units, features.filter(skip), lambda a, b: run(a, b, 0), fields, same))


def ranked(tested: DataFrame, top: int) -> DataFrame:
    """With rank (share of shuffles below the observed value) and whether it passes, strictly."""
    k = F.size("null_mi")
    rank = (F.size(F.filter("null_mi", lambda x: x < F.col("mi"))) + 1) / (k + 1)
    return tested.withColumn("rank", rank).withColumn("passed", F.col("rank") > 1 - F.lit(top) / (k + 1))


def significance(units: DataFrame, features: DataFrame, plan: Plan | None = None, same: bool = False) -> DataFrame:
    """Every pair with its outcome: delay, mi, pre_rank, stage1, and for pairs that pass stage 1 rank,
    pval, p_threshold and significant."""
    plan = plan or Plan()
    a, b = matrices(units), matrices(features)
    one = ranked(shuffled(a, b, plan, plan.first, 7, same), plan.top)
    stay = one.filter("passed").select("unit", "feature")
    two = ranked(shuffled(a, b, plan, plan.second, 11, same).join(stay, ["unit", "feature"], "left_semi"), plan.top2)
    two = thresholds(p_values(two, plan.tail), "pval", plan.alpha, ["unit", "feature"], plan.method)
    two = two.select("unit", "feature", "rank", "pval", "p_threshold", (F.col("passed") & (F.col("pval") < F.col("p_threshold"))).alias("significant"))
    first = one.select("unit", "feature", "delay", "mi", F.col("rank").alias("pre_rank"), F.col("passed").alias("stage1"))
    return first.join(two, ["unit", "feature"], "left").withColumn("significant", F.coalesce("significant", F.lit(False)))


def entropy_of_series(rows: DataFrame) -> DataFrame:
    """(key, entropy) in bits: of classes from their counts; of normal values from their variance,
    corrected for its estimation."""
    c = rows.filter("kind = 'discrete'").groupBy("key", "x").agg(F.count("*").alias("n")).groupBy("key").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))
    n = F.count("*").cast("double")
    g = rows.filter("kind = 'continuous'").groupBy("key").agg(n.alias("n"), F.var_samp("x").alias("v"))
    h = 0.5 * F.ln(2 * math.pi * math.e * F.col("v")) - (LN2 - F.ln(F.col("n") - 1)) / 2 - digamma((F.col("n") - 1) / 2) / 2
    return c.unionByName(g.select("key", (h / LN2).alias("entropy")))


def ratios(raw: DataFrame, features: DataFrame, delays: DataFrame) -> DataFrame:
    """(unit, feature, signal_ratio): mean of the unit's raw signal (key, t, x) while the feature, rolled
    by the pair's delay, is on, over the mean while it is off. On: the greater of two classes, or above
    the median. Features of more classes have none."""
    one = features.filter("dim = 0")
    kinds = one.groupBy("key", "kind").agg(F.count_distinct("x").alias("_k"), F.count("*").alias("_n"), F.max("x").alias("_top"), F.percentile("x", 0.5).alias("_half"))
    on = one.join(kinds.filter("kind = 'continuous' or _k = 2"), ["key", "kind"]).select(
        F.col("key").alias("feature"), "t", "_n", F.when(F.col("kind") == "discrete", F.col("x") == F.col("_top")).otherwise(F.col("x") > F.col("_half")).alias("on")
    )
    met = delays.select("unit", "feature", "delay").join(on, "feature").select("unit", "feature", F.pmod(F.col("t") + F.col("delay"), F.col("_n")).alias("t"), "on")
    x = met.join(raw.select(F.col("key").alias("unit"), "t", "x"), ["unit", "t"])
    return x.groupBy("unit", "feature").agg(F.try_divide(F.avg(F.when(F.col("on"), F.col("x"))), F.avg(F.when(~F.col("on"), F.col("x")))).alias("signal_ratio"))


def finished(tested: DataFrame, units: DataFrame, features: DataFrame, raw: DataFrame) -> DataFrame:
    """The test's outcome with rel_me_beh and rel_me_ca (the measure over the entropies of feature and
    unit) and signal_ratio; pairs whose unit is not more active while the feature is on are revoked."""
    hf = entropy_of_series(features).select(F.col("key").alias("feature"), F.col("entropy").alias("_hf"))
    hu = entropy_of_series(units).select(F.col("key").alias("unit"), F.col("entropy").alias("_hu"))
    out = tested.join(hf, "feature", "left").join(hu, "unit", "left").join(ratios(raw, features, tested), ["unit", "feature"], "left")
    return out.withColumns(
        {
            "rel_me_beh": F.try_divide(F.col("mi"), F.col("_hf")),
            "rel_me_ca": F.try_divide(F.col("mi"), F.col("_hu")),
            "significant": F.col("significant") & ~F.coalesce(F.col("signal_ratio") <= 1.0, F.lit(False)),
        }
    ).drop("_hf", "_hu")


#: Measures below EPSILON count as none, a measure DOMINANT times the other's dominates,
#: and a share below RESIDUAL that stays given the other feature makes a feature redundant.
EPSILON, DOMINANT, RESIDUAL = 1e-6, 2.0, 0.1


def outcome_rules() -> list[tuple[float, str]]:
    """(outcome, condition) over mi_1, mi_2, cmi_1, cmi_2 and interaction; the first that holds decides
    between two features of a unit: 0 the first is primary, 1 the second, 0.5 both stay."""

    def beaten(x: int, y: int) -> str:
        """Feature x tells less than the two share, and y still tells more than that given x."""
        return f"(mi_{x} < -interaction AND cmi_{y} >= -interaction)"

    def residual(x: int) -> str:
        return f"(cmi_{x} / nullif(mi_{x}, 0))"

    shared, ratios_ = "interaction < 0", f"mi_1 > {EPSILON} AND mi_2 > {EPSILON}"
    one, two = beaten(1, 2), beaten(2, 1)
    small = [f"{residual(x)} < {RESIDUAL}" for x in (1, 2)]
    return [
        (1.0, f"{shared} AND {one} AND NOT {two}"),
        (0.0, f"{shared} AND {two} AND NOT {one}"),
        (1.0, f"{shared} AND {ratios_} AND {small[0]} AND NOT {small[1]}"),
        (0.0, f"{shared} AND {ratios_} AND {small[1]} AND NOT {small[0]}"),
        (0.0, f"{shared} AND {ratios_} AND {small[0]} AND {small[1]} AND mi_1 > mi_2"),
        (1.0, f"{shared} AND {ratios_} AND {small[0]} AND {small[1]} AND mi_2 > mi_1"),
        (0.5, shared),
        (0.0, f"mi_2 < {EPSILON} AND cmi_1 > cmi_2"),
        (1.0, f"mi_1 < {EPSILON} AND cmi_2 > cmi_1"),
        (0.0, f"mi_2 >= {EPSILON} AND mi_1 > {DOMINANT} * mi_2 AND cmi_1 > cmi_2"),
        (1.0, f"mi_1 >= {EPSILON} AND mi_2 > {DOMINANT} * mi_1 AND cmi_2 > cmi_1"),
        (0.5, "true"),
    ]


def outcome_sql() -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {out}" for out, cond in outcome_rules()) + " END"


def disentangled(pairs: DataFrame, unrelated: DataFrame | None = None, before: Sequence[Callable[[DataFrame], DataFrame]] = (), after: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """pairs (unit, f1, f2, mi_1, mi_2, cmi_1, cmi_2) with interaction and outcome. unrelated: pairs
    (f1, f2) of features that don't depend on each other, of which both stay. before, after: filters
    of a population, each from DataFrame to DataFrame, applied in order."""
    for f in before:
        pairs = f(pairs)
    gain = (F.col("cmi_1") - F.col("mi_1") + F.col("cmi_2") - F.col("mi_2")) / 2
    out = pairs.withColumn("interaction", gain).withColumn("outcome", F.expr(outcome_sql()).cast("double"))
    if unrelated is not None:
        free = unrelated.select("f1", "f2").distinct().withColumn("_free", F.lit(True))
        out = out.join(free, ["f1", "f2"], "left").withColumn("outcome", F.when(F.col("_free"), 0.5).otherwise(F.col("outcome"))).drop("_free")
    for f in after:
        out = f(out)
    return out


def disentanglement_matrix(decided: DataFrame) -> DataFrame:
    """(feature_a, feature_b, score, n): over all units the sum of outcomes in which b is the primary
    one of the two (0.5: both), and their number; both directions of every pair."""
    both = decided.select(F.col("f1").alias("feature_a"), F.col("f2").alias("feature_b"), "outcome").unionByName(
        decided.select(F.col("f2").alias("feature_a"), F.col("f1").alias("feature_b"), (1 - F.col("outcome")).alias("outcome"))
    )
    return both.groupBy("feature_a", "feature_b").agg(F.sum("outcome").alias("score"), F.count("*").alias("n"))


def losers(decided: DataFrame) -> DataFrame:
    """(unit, feature): the features that lose against another one of their unit."""
    return decided.filter("outcome <> 0.5").select("unit", F.when(F.col("outcome") == 1.0, F.col("f1")).otherwise(F.col("f2")).alias("feature")).distinct()


def composed(*filters: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One filter from several, applied from left to right."""

    def run(df: DataFrame) -> DataFrame:
        for f in filters:
            df = f(df)
        return df

    return run


def tagged(rows: DataFrame, key: Column, t: Column, x: Column, kind: str, dim: int | Column = 0) -> DataFrame:
    """Rows of one side: (key, kind, dim, t, x)."""
    return rows.select(key.alias("key"), F.lit(kind).alias("kind"), F.lit(dim).alias("dim"), t.cast("long").alias("t"), x.cast("double").alias("x"))


def on_frames(units: DataFrame, features: DataFrame) -> DataFrame:
    """(unit, feature, r): correlation of every unit with every feature over the places that both have;
    of one-dimensional series (key, kind, dim, t, x)."""
    one = lambda df, name: df.filter("dim = 0 and x is not null and not isnan(x)").select(F.col("key").alias("key"), "t", F.col("x").alias(name))
    return cross_correlations(one(units, "x"), one(features, "x"), "key", "t", "x").select(F.col("key_a").alias("unit"), F.col("key_b").alias("feature"), "r")
