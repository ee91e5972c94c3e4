"""Conditional information of mixed kinds, from moments and counts: x and y given z, in bits.

Normal variables enter as they are (give normal scores for a copula estimate), classes as any column.
Every measure is one aggregation of moments per class, so what is shuffled are the classes' sums.
Entropies are corrected for the number of values; small negative results become 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.special import digamma

LN2 = math.log(2)


def _moments(names: Sequence[str]) -> list[Column]:
    out = [F.count("*").cast("double").alias("_n")]
    for i, a in enumerate(names):
        out += [F.covar_samp(a, b).alias(f"_{a}_{b}") for b in names[i:]]
    return out


def _cov(a: str, b: str, names: Sequence[str]) -> Column:
    i, j = sorted((names.index(a), names.index(b)))
    return F.col(f"_{names[i]}_{names[j]}")


def _det(of: Sequence[str], names: Sequence[str]) -> Column:
    """Determinant of the covariance of some of the variables, by its first row."""
    rows = [[_cov(a, b, names) for b in of] for a in of]

    def det(m: list[list[Column]]) -> Column:
        if len(m) == 1:
            return m[0][0]
        out = F.lit(0.0)
        for k, c in enumerate(m[0]):
            part = c * det([r[:k] + r[k + 1 :] for r in m[1:]])
            out = out + part if k % 2 == 0 else out - part
        return out

    return det(rows)


def _entropy(of: Sequence[str], names: Sequence[str], n: Column) -> Column:
    """Entropy of jointly normal variables in nats, from moments over n values."""
    d = len(of)
    bias = d * (LN2 - F.ln(n - 1)) / 2
    for i in range(1, d + 1):
        bias = bias + digamma((n - i) / 2) / 2
    return 0.5 * F.ln(_det(of, names)) + d * math.log(2 * math.pi * math.e) / 2 - bias


def gaussian_entropy(df: DataFrame, keys: Sequence[str], names: Sequence[str], name: str = "entropy") -> DataFrame:
    """Joint entropy of normal variables per group."""
    rows = df.dropna(subset=[*names]).groupBy(*keys).agg(*_moments(names)).filter(F.col("_n") > len(names) + 1)
    return rows.select(*keys, (_entropy(names, names, F.col("_n")) / LN2).alias(name))


def given_normal(df: DataFrame, keys: Sequence[str], x: str, y: str, z: str) -> DataFrame:
    """x and y given z, all normal."""
    names, n = [x, y, z], F.col("_n")
    m = df.dropna(subset=names).groupBy(*keys).agg(*_moments(names)).filter("_n > 4")
    h = lambda *of: _entropy(of, names, n)
    return m.select(*keys, F.greatest(F.lit(0.0), (h(x, z) + h(y, z) - h(x, y, z) - h(z)) / LN2).alias("cmi"))


def given_class(df: DataFrame, keys: Sequence[str], x: str, y: str, z: str) -> DataFrame:
    """x and y, normal within each class of z, given that class; classes of less than 5 values are
    left out of the sum."""
    names, n = [x, y], F.col("_n")
    m = df.dropna(subset=[*names, z]).groupBy(*keys, z).agg(*_moments(names))
    h = lambda *of: _entropy(of, names, n)
    each = m.withColumn("_i", F.when(n > 4, F.greatest(F.lit(0.0), h(x) + h(y) - h(x, y))))
    return each.groupBy(*keys).agg((F.coalesce(F.sum(n * F.col("_i")), F.lit(0.0)) / F.sum(n) / LN2).alias("cmi"))


def class_given_normal(df: DataFrame, keys: Sequence[str], x: str, y: str, z: str) -> DataFrame:
    """Normal x and class y given normal z: what z leaves open of x, less the same within the classes
    of more than 2 values."""
    names, n = [x, z], F.col("_n")
    rows = df.dropna(subset=[*names, y])
    left = _entropy(names, names, n) - _entropy([z], names, n)
    every = rows.groupBy(*keys).agg(*_moments(names)).select(*keys, n.alias("_all"), left.alias("_h"))
    within = rows.groupBy(*keys, y).agg(*_moments(names)).filter("_n > 3").select(*keys, (n * left).alias("_w")).groupBy(*keys).agg(F.sum("_w").alias("_w"))
    both = every.join(within, list(keys)) if keys else every.crossJoin(within)  # without keys one row each
    return both.select(*keys, F.greatest(F.lit(0.0), (F.col("_h") - F.col("_w") / F.col("_all")) / LN2).alias("cmi"))


def class_given_class(df: DataFrame, keys: Sequence[str], x: str, y: str, z: str) -> DataFrame:
    """Normal x and class y given class z: the entropy of x within the classes of z, less that within
    those of both; classes of less than 3 values are left out of either sum."""
    n = F.col("_n")
    rows = df.dropna(subset=[x, y, z])

    def within(*by: str) -> DataFrame:
        m = rows.groupBy(*keys, *by).agg(*_moments([x])).filter(f"_n > 2 and _{x}_{x} > 0")
        return m.groupBy(*keys).agg(F.sum(n * _entropy([x], [x], n)).alias("_w"), F.sum("_n").alias("_m"))

    a, b = within(z), within(y, z).withColumnsRenamed({"_w": "_w2", "_m": "_m2"})
    both = a.join(b, list(keys)) if keys else a.crossJoin(b)  # without keys one row each
    return both.select(*keys, F.greatest(F.lit(0.0), (F.col("_w") / F.col("_m") - F.col("_w2") / F.col("_m2")) / LN2).alias("cmi"))


def correlations_of_many(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(n, tc, dtc, o_information) of three or more normal variables, without corrections, in bits:
    what they have in common at all, what each adds to the others, and the difference, above 0 where
    redundancy prevails."""
    if len(names) < 3:
        raise ValueError("at least three variables")
    m = df.dropna(subset=[*names]).agg(*_moments(names))
    h = lambda of: 0.5 * F.log2(_det(of, names))
    every = h(list(names))
    tc = -every
    dtc = every
    for x in names:
        tc = tc + h([x])
        dtc = dtc - (every - h([y for y in names if y != x]))
    return m.select(F.col("_n").cast("long").alias("n"), tc.alias("tc"), dtc.alias("dtc"), (tc - dtc).alias("o_information"))
