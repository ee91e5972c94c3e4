"""What kind of series rows (key, t, value) are: discrete or continuous, and their subtype.

Evidence is gathered set by set: moments, histograms and distances between sorted values and between
neighbours in time are joins and aggregates over the distributed order, so a series needs no single
task; only the autocorrelation takes a series as one array. What follows from the evidence is a table
of rules, each a weight and a condition in SQL, which any engine can evaluate.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.ordering import global_rank

#: Words in a name that suggest a circular quantity.
CIRCULAR_WORDS = ["angle", "phase", "direction", "heading", "azimuth", "orientation", "rotation", "bearing", "circular", "theta", "phi", "degrees", "radians", "compass"]
#: Ranges of circular quantities (low, high), whose length is the period.
CIRCULAR_RANGES = [(0, 2 * math.pi), (-math.pi, math.pi), (0, 360), (-180, 180)]
#: Evidence for a circular quantity (weight, condition); weights add up to `circle`.
CIRCLE = [
    (0.3, "named"),
    (0.4, "in_range AND uniqueness > 0.1 AND n_unique > 2"),
    (0.2, "jumps > 0"),
    (0.3, "autocorrelation > 0.7 AND n_unique > 5"),
    (0.2, "kappa > 0.5"),
]
#: Circle at which a series is circular, and above which nothing else is asked.
IS_CIRCULAR, SURELY_CIRCULAR = 0.6, 0.7
#: What makes a series discrete by itself (confidence, condition); the first holds.
DISCRETE = [
    (1.0, "n_unique = 2 AND integers > 0.98"),
    (0.95, "uniqueness < 0.05 AND n_unique <= 20"),
    (0.9, "integers > 0.99 AND uniqueness < 0.3"),
    (0.95, "integers > 0.99 AND falls = 0"),
    (0.85, "cv_gap < 0.05 AND uniqueness > 0.8"),
]
#: Votes (for discrete, for continuous, condition) where nothing above holds.
VOTES = [
    (0.3, 0.0, "uniqueness < 0.1"),
    (0.0, 0.3, "uniqueness > 0.5"),
    (0.2, 0.0, "entropy < 0.3"),
    (0.0, 0.2, "entropy > 0.7"),
    (0.2, 0.0, "integers > 0.95"),
    (0.0, 0.2, "integers < 0.1"),
    (0.1, 0.0, "cv_gap < 0.1"),
    (0.0, 0.1, "cv_gap > 1.0"),
    (0.1, 0.0, "n_unique <= 30"),
    (0.0, 0.1, "n_unique > 30 AND n_unique > 0.7 * n"),
    (0.0, 0.1, "p_normal > 0.05"),
    (0.0, 0.1, "p_uniform > 0.05"),
]
#: Fixed value: shares of the votes that differ by less decide nothing.
UNDECIDED = 0.2
#: Subtypes of discrete series; the first whose condition holds.
SUBTYPES = [("binary", "n_unique = 2"), ("count", "integers > 0.99 AND falls = 0"), ("timeline", "uniqueness > 0.8 AND n_unique >= 10 AND cv_gap < 0.05"), ("categorical", "true")]


def type_features(df: DataFrame) -> DataFrame:
    """Order-free statistics per key: n, n_unique, mean, std (population), lo, hi, skewness and
    excess kurtosis (population), share of whole numbers."""
    v = F.col("value")
    good = df.filter(v.isNotNull() & ~F.isnan(v))
    return good.groupBy("key").agg(
        F.count("*").alias("n"), F.count_distinct(v).alias("n_unique"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"), F.avg(F.when(F.abs(v - F.rint(v)) < 1e-10, 1.0).otherwise(0.0)).alias("integers"),
    )


def normality_sql(n: str, g: str, k: str) -> str:
    """Probability of normality from skewness g and excess kurtosis k of n values together
    (D'Agostino and Pearson), as SQL; 0 for less than 8 values."""
    y = f"({g} * sqrt(({n} + 1.0) * ({n} + 3) / (6.0 * ({n} - 2))))"
    beta = f"(3.0 * ({n} * {n} + 27.0 * {n} - 70) * ({n} + 1) * ({n} + 3) / (({n} - 2.0) * ({n} + 5) * ({n} + 7) * ({n} + 9)))"
    w2 = f"(-1 + sqrt(2 * ({beta} - 1)))"
    zs = f"(asinh({y} / sqrt(2 / ({w2} - 1))) / sqrt(0.5 * ln({w2})))"
    mean = f"(3.0 * ({n} - 1) / ({n} + 1))"
    var = f"(24.0 * {n} * ({n} - 2) * ({n} - 3) / (({n} + 1.0) * ({n} + 1) * ({n} + 3) * ({n} + 5)))"
    root = f"(6.0 * ({n} * {n} - 5.0 * {n} + 2) / (({n} + 7.0) * ({n} + 9)) * sqrt(6.0 * ({n} + 3) * ({n} + 5) / ({n} * ({n} - 2.0) * ({n} - 3))))"
    a = f"(6 + 8 / {root} * (2 / {root} + sqrt(1 + 4 / ({root} * {root}))))"
    t = f"((1 - 2 / {a}) / (1 + ({k} + 3 - {mean}) / sqrt({var}) * sqrt(2 / ({a} - 4))))"
    zk = f"((1 - 2 / (9 * {a}) - sign({t}) * power(abs({t}), 1.0 / 3)) / sqrt(2 / (9 * {a})))"
    return f"CASE WHEN {n} >= 8 AND {g} IS NOT NULL THEN exp(-({zs} * {zs} + {zk} * {zk}) / 2) ELSE 0.0 END"


def uniformity(n: Column, d: Column) -> Column:
    """Asymptotic Kolmogorov-Smirnov probability of a distance d of n values."""
    z = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * d
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * z * z))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


@F.pandas_udf(T.DoubleType())
def _autocorrelation(values: pd.Series) -> pd.Series:
    """Greatest absolute autocorrelation of an array at lags from 1 to below half its length."""

    def one(v: np.ndarray) -> float:
        x = np.asarray(v, float)
        n = len(x)
        if n < 20 or x.std() == 0:
            return 0.0
        f = np.fft.rfft((x - x.mean()) / x.std(), 2 * n)
        return float(np.abs(np.fft.irfft(f * np.conj(f))[1 : n // 2]).max() / n)

    return values.map(one)


def evidence(df: DataFrame, name: str = "name") -> DataFrame:
    """One row per key with everything that the rules ask for."""
    rows = df.filter(F.col("value").isNotNull() & ~F.isnan("value")).select("key", "t", "value", F.col(name).alias("name"))
    base = type_features(rows).join(rows.groupBy("key").agg(F.max("name").alias("name")), "key")
    ends = base.select("key", "n", "n_unique", "mean", "lo", "hi")
    span = F.col("hi") - F.col("lo")

    # neighbours among the sorted values: gaps between different ones, distance to a uniform spread
    by_value = global_rank(rows.join(ends, "key"), ["key"], ["value", "t"], "_r")
    u = F.try_divide(F.col("value") - F.col("lo"), span)
    ks = by_value.groupBy("key").agg(F.greatest(F.max((F.col("_r") + 1) / F.col("n") - u), F.max(u - F.col("_r") / F.col("n"))).alias("ks"))
    different = global_rank(rows.select("key", "value").distinct(), ["key"], ["value"], "_r")
    after = different.select("key", (F.col("_r") - 1).alias("_r"), F.col("value").alias("_next"))
    gap = F.col("_next") - F.col("value")
    gaps = different.join(after, ["key", "_r"]).groupBy("key").agg((F.stddev_pop(gap) / (F.avg(gap) + 1e-10)).alias("cv_gap"))

    # neighbours in time: falls, and jumps over most of the range that cross the mean
    placed = global_rank(rows.join(ends.select("key", "mean", "lo", "hi"), "key"), ["key"], ["t", "value"], "_r")
    later = placed.select("key", (F.col("_r") - 1).alias("_r"), F.col("value").alias("_next"))
    crosses = (F.col("value") > F.col("mean")) != (F.col("_next") > F.col("mean"))
    moves = placed.join(later, ["key", "_r"]).groupBy("key").agg(
        F.count_if(gap < 0).alias("falls"), F.count_if((F.abs(gap) > 0.8 * span) & crosses).alias("jumps")
    )

    bins = F.greatest(F.lit(1), F.least(F.col("n_unique"), F.floor(F.sqrt("n"))))
    bin_ = F.least(F.floor(F.coalesce(u, F.lit(0.0)) * bins), bins - 1)
    turned = rows.join(ends, "key").withColumn("_bin", bin_).withColumn("_u", u)
    hist = turned.groupBy("key", "_bin").agg(F.count("*").alias("_k")).groupBy("key").agg(
        F.coalesce(F.try_divide(F.ln(F.sum("_k")) - F.sum(F.col("_k") * F.ln("_k")) / F.sum("_k"), F.ln(F.count("*"))), F.lit(0.0)).alias("entropy")
    )
    r2 = F.pow(F.avg(F.cos(2 * math.pi * F.col("_u"))), 2) + F.pow(F.avg(F.sin(2 * math.pi * F.col("_u"))), 2)
    turns = turned.groupBy("key").agg(r2.alias("_r2"))
    arrays = rows.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("_v")).select("key", _autocorrelation("_v").alias("autocorrelation"))

    out = base
    for part in (ks, gaps, moves, hist, turns, arrays):
        out = out.join(part, "key", "left")
    near = [(F.abs(F.col("lo") - a) < 0.1 * (b - a)) & (F.abs(F.col("hi") - b) < 0.1 * (b - a)) for a, b in CIRCULAR_RANGES]
    r = F.sqrt("_r2")
    kappa = F.when((span > 1e-10) & (F.col("n") >= 50) & (F.col("n_unique") > 10), r * (2 - F.col("_r2")) / F.greatest(F.lit(1e-12), 1 - F.col("_r2"))).otherwise(0.0)
    return out.select(
        "key", "name", "n", "n_unique", (F.col("n_unique") / F.col("n")).alias("uniqueness"), "entropy", "integers", F.coalesce("cv_gap", F.lit(0.0)).alias("cv_gap"),
        F.coalesce("falls", F.lit(0)).alias("falls"), F.coalesce("jumps", F.lit(0)).alias("jumps"), "autocorrelation", kappa.alias("kappa"),
        F.when(F.col("std") > 0, F.expr(normality_sql("n", "skewness", "kurtosis"))).otherwise(0.0).alias("p_normal"),
        F.when(F.col("ks").isNotNull(), uniformity(F.col("n"), F.col("ks"))).otherwise(0.0).alias("p_uniform"),
        (near[0] | near[1] | near[2] | near[3]).alias("in_range"), F.coalesce(F.lower("name").rlike("|".join(CIRCULAR_WORDS)), F.lit(False)).alias("named"),
    )


def total_sql(rules: list[tuple[float, str]]) -> str:
    """Sum of the weights whose conditions hold."""
    return " + ".join(f"CASE WHEN {cond} THEN {weight} ELSE 0.0 END" for weight, cond in rules)


def first_sql(rules: list[tuple], otherwise: str = "NULL") -> str:
    """The outcome of the first condition that holds."""
    return "CASE " + " ".join(f"WHEN {cond} THEN {out!r}" for out, cond in rules) + f" ELSE {otherwise} END"


def rule_columns() -> list[tuple[str, str]]:
    """(name, SQL) of what follows from the evidence, each from what stands before it."""
    either = "discrete_votes + continuous_votes"
    return [
        ("circle", total_sql(CIRCLE)),
        ("sure", first_sql(DISCRETE)),
        ("kind", first_sql(SUBTYPES)),
        ("discrete_votes", total_sql([(d, c) for d, _, c in VOTES if d])),
        ("continuous_votes", total_sql([(w, c) for _, w, c in VOTES if w])),
        ("lead", f"CASE WHEN {either} > 0 THEN (discrete_votes - continuous_votes) / ({either}) ELSE 0.0 END"),
        ("share", f"CASE WHEN {either} > 0 THEN greatest(discrete_votes, continuous_votes) / ({either}) ELSE 0.0 END"),
        ("primary_type", f"CASE WHEN circle > {SURELY_CIRCULAR} THEN 'continuous' WHEN sure IS NOT NULL THEN 'discrete' WHEN round(abs(lead), 9) < {UNDECIDED} THEN 'ambiguous' WHEN lead > 0 THEN 'discrete' ELSE 'continuous' END"),
        ("subtype", f"CASE WHEN circle > {SURELY_CIRCULAR} THEN 'circular' WHEN primary_type = 'discrete' THEN kind WHEN primary_type = 'continuous' THEN CASE WHEN circle >= {IS_CIRCULAR} THEN 'circular' ELSE 'linear' END END"),
        ("confidence", f"CASE WHEN circle > {SURELY_CIRCULAR} THEN least(1.0, circle) WHEN sure IS NOT NULL THEN sure ELSE share END"),
    ]


def infer_types(df: DataFrame, name: str = "name") -> DataFrame:
    """(key, name, primary_type, subtype, confidence) per series; missing readings are left out, a
    series without readings has no row."""
    out = evidence(df, name)
    for column, sql in rule_columns():
        out = out.withColumn(column, F.expr(sql).cast("double") if column in ("circle", "sure", "discrete_votes", "continuous_votes", "lead", "share", "confidence") else F.expr(sql))
    return out.select("key", "name", "primary_type", "subtype", F.round("confidence", 6).alias("confidence"))
