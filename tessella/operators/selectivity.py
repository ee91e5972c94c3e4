"""Ranks, tails and thresholds of tests against shifted series, and triples of series.

Shifts come from the blocks of pairs in pairing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.special import fit_gamma, gamma_sf, normal_sf
from tessella.operators.information import correlation_table, gaussian_mi
from tessella.operators.ordering import global_rank


def as_arrays(df: DataFrame, key: str, on: str, value: str) -> DataFrame:
    """(key, n, values): each series in order."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(on, value))), lambda x: x[value]).alias("values")).withColumn("n", F.size("values"))


def best_shift(shifts: DataFrame, window: int) -> DataFrame:
    """(key_a, key_b, shift, mi): first shift of greatest information within -window..window."""
    each = shifts.withColumn("shift", F.explode(F.sequence(F.lit(-window), F.lit(window))))
    mi = gaussian_mi(F.element_at("r", (F.pmod("shift", F.col("n")) + 1).cast("int")), F.col("n"))
    # ties at nine decimals go to the first shift
    return (
        each.select("key_a", "key_b", "shift", F.round(mi, 9).alias("mi"))
        .groupBy("key_a", "key_b")
        .agg(F.max(F.struct("mi", (-F.col("shift")).alias("back"))).alias("_b"))
        .select("key_a", "key_b", (-F.col("_b.back")).alias("shift"), F.col("_b.mi").alias("mi"))
    )


def stage_shifts(k: int, seed: int = 7, least: int = 0) -> Column:
    """k shifts in [least, n - least), from whole-number arithmetic so that any engine agrees."""
    span = F.greatest(F.col("n") - 2 * least, F.lit(1))
    return F.transform(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long")), lambda i: least + F.pmod(i * 7919 + i * i * 104729 + seed, span))


def rank_test(shifts: DataFrame, k: int, top: int = 1, seed: int = 7, least: int = 0) -> DataFrame:
    """(key_a, key_b, mi, rank, passed): share of shuffles below the unshifted value; a pair passes
    when its rank exceeds 1 - top / (k + 1), strictly."""
    mi = lambda s: F.round(gaussian_mi(F.element_at(F.col("r"), (s + 1).cast("int")), F.col("n")), 9)
    out = shifts.withColumn("mi", mi(F.lit(0))).withColumn("null_mi", F.transform(stage_shifts(k, seed, least), mi))
    rank = (F.size(F.filter("null_mi", lambda x: x < F.col("mi"))) + 1) / (k + 1)
    return out.select("key_a", "key_b", "n", "mi", "null_mi", rank.alias("rank")).withColumn("passed", F.col("rank") > 1 - top / (k + 1))


def tail_probability(observed: float, null: np.ndarray, kind: str = "gamma_zi") -> float:
    """p-value of an observed value under a distribution fitted to its shuffles: zero-inflated
    gamma, gamma, lognorm or norm. 1 where nothing can be fitted or nothing was observed."""
    null = np.asarray(null, float)
    if kind == "norm":
        sd = null.std()
        return float(normal_sf((observed - null.mean()) / sd)[0]) if sd > 0 else 1.0
    if observed <= 1e-10:
        return 1.0
    some = null[null > 1e-10]
    if kind == "lognorm":
        if len(some) < 2 or np.log(some).std() == 0:
            return 1.0
        return float(normal_sf((np.log(observed) - np.log(some).mean()) / np.log(some).std())[0])
    fit = fit_gamma(some)
    if fit is None:
        return 1.0
    share = len(some) / len(null) if kind == "gamma_zi" else 1.0
    return float(min(1.0, max(0.0, share * gamma_sf(observed, *fit))))


def p_values(tested: DataFrame, kind: str = "gamma_zi") -> DataFrame:
    @F.pandas_udf(T.DoubleType())
    def p(mi: pd.Series, null: pd.Series) -> pd.Series:
        return pd.Series([tail_probability(a, np.asarray(b), kind) for a, b in zip(mi, null)])

    return tested.withColumn("pval", p("mi", "null_mi"))


def thresholds(df: DataFrame, p: str, alpha: float, ties: Sequence[str], method: str = "holm") -> DataFrame:
    """df with p_threshold: holm, bonferroni, bh or none. Pairs pass strictly below it."""
    if method == "none":
        return df.withColumn("p_threshold", F.lit(alpha))
    n = df.agg(F.count("*").alias("_m"))
    if method == "bonferroni":
        return df.crossJoin(F.broadcast(n)).withColumn("p_threshold", F.try_divide(F.lit(alpha), F.col("_m"))).drop("_m")
    if method not in ("holm", "bh"):
        raise ValueError(f"no such method: {method}")
    # the hypotheses (pairs) are ordered over the cluster; the decision is one number
    ranked = global_rank(df.select(*ties, p), [], [p, *ties], "_i").crossJoin(F.broadcast(n))
    if method == "holm":
        first_fail = ranked.filter(F.col(p) > alpha / (F.col("_m") - F.col("_i"))).agg(F.min("_i").alias("_f"))
        # the last hypothesis that passes sets the threshold; if none does, it is the first one's
        passed = F.coalesce("_f", F.col("_m"))
        limit = first_fail.crossJoin(n).select(F.try_divide(F.lit(alpha), F.least(F.col("_m") - passed + 1, F.col("_m"))).alias("p_threshold"))
    else:
        limit = ranked.filter(F.col(p) <= alpha * (F.col("_i") + 1) / F.col("_m")).agg(F.coalesce(F.max(p), F.lit(0.0)).alias("p_threshold"))
    return df.crossJoin(F.broadcast(limit))


def feature_pairs(scores: DataFrame, key: str, on: str, value: str) -> DataFrame:
    """(unit, f1, f2, mi_1, mi_2, cmi_1, cmi_2): for each series as a unit and any two others as its
    features, the Gaussian information of either feature, alone and given the other, in bits."""
    # all correlations at once, from sums of products; triples are then joined without places
    r = correlation_table(scores, key, on, value).filter(F.col("key_a") != F.col("key_b"))
    x = r.select(F.col("key_a").alias("unit"), F.col("key_b").alias("f1"), F.col("r").alias("p"))
    y = r.select(F.col("key_a").alias("unit"), F.col("key_b").alias("f2"), F.col("r").alias("q"))
    c = x.join(y, "unit").filter("f1 < f2").join(r.select(F.col("key_a").alias("f1"), F.col("key_b").alias("f2"), "r"), ["f1", "f2"])
    p, q, r = F.col("p"), F.col("q"), F.col("r")
    bits = lambda k: -0.5 * F.log2(1 - k * k)
    given = lambda u, v: F.try_divide(u - v * r, F.sqrt((1 - v * v) * (1 - r * r)))
    return c.select("unit", "f1", "f2", bits(p).alias("mi_1"), bits(q).alias("mi_2"), bits(given(p, q)).alias("cmi_1"), bits(given(q, p)).alias("cmi_2"))
