"""Entropies and information measures of tables and series, in bits.

Discrete measures come from counts of the values that occur; Gaussian ones from moments of normal
scores. All sums are partial aggregates, so only counts and moments are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.special import digamma, normal_ppf
from tessella.operators.ordering import global_rank

LN2 = math.log(2)
#: Series between which all correlations are taken at once.
MOST_SERIES = 4_000


def _plogp(counts: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Entropy of the counts n within each group: log2 N - sum n log2 n / N."""
    return counts.groupBy(*by).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias(name))


def entropy(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), name: str = "entropy") -> DataFrame:
    """Joint entropy of the columns, per group."""
    return _plogp(df.groupBy(*by, *columns).agg(F.count("*").alias("n")), by, name)


def mutual_information(df: DataFrame, x: Sequence[str], y: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """H(x) + H(y) - H(x, y), all from one table of joint counts."""
    joint = df.groupBy(*by, *x, *y).agg(F.count("*").alias("n"))
    hx = _plogp(joint.groupBy(*by, *x).agg(F.sum("n").alias("n")), by, "hx")
    hy = _plogp(joint.groupBy(*by, *y).agg(F.sum("n").alias("n")), by, "hy")
    hxy = _plogp(joint, by, "hxy")
    out = hx.join(hy, list(by)).join(hxy, list(by)) if by else hx.crossJoin(hy).crossJoin(hxy)  # without groups one row each
    return out.withColumn("mi", F.greatest(F.lit(0.0), F.col("hx") + F.col("hy") - F.col("hxy")))


def conditional_mi(df: DataFrame, x: Sequence[str], y: Sequence[str], z: Sequence[str]) -> DataFrame:
    """I(x; y | z) and the interaction information I(x; y | z) - I(x; y), of discrete columns."""
    joint = df.groupBy(*x, *y, *z).agg(F.count("*").alias("n"))
    terms = {"hx": x, "hy": y, "hz": z, "hxy": [*x, *y], "hxz": [*x, *z], "hyz": [*y, *z], "hxyz": [*x, *y, *z]}
    out = None
    for name, cols in terms.items():
        h = _plogp(joint.groupBy(*cols).agg(F.sum("n").alias("n")), [], name)  # one row
        out = h if out is None else out.crossJoin(h)
    cmi = F.greatest(F.lit(0.0), F.col("hxz") + F.col("hyz") - F.col("hxyz") - F.col("hz"))
    mi = F.greatest(F.lit(0.0), F.col("hx") + F.col("hy") - F.col("hxy"))
    return out.select(cmi.alias("cmi"), mi.alias("mi"), (cmi - mi).alias("interaction"))


def normal_scores(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], name: str = "z") -> DataFrame:
    """Normal scores of ordinal ranks within keys: ties get consecutive ranks in the order of tie."""
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    ranked = global_rank(rows, keys, [value, *tie], "_place")
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    return ranked.join(n, list(keys)).withColumn("rank", F.col("_place") + 1).withColumn(name, normal_ppf(F.col("rank") / (F.col("_n") + 1))).drop("_place", "_n")


def pair_correlations(df: DataFrame, key: str, on: str, value: str) -> DataFrame:
    """(key_a, key_b, r, n) for all series a < b over the places that both have.

    The values of a place are one vector; every partition adds up products of its vectors, and only
    these sums, a matrix row at a time, are shuffled: no pair of rows is ever built. The number of
    series is checked, since a matrix of their sums must fit a task.
    """
    keys = [r[0] for r in df.select(key).filter(F.col(key).isNotNull()).distinct().limit(MOST_SERIES + 1).collect()]
    if len(keys) > MOST_SERIES:
        raise ValueError(f"more than {MOST_SERIES} series")
    keys.sort()
    at, k = {x: i for i, x in enumerate(keys)}, len(keys)
    kind = df.schema[key].dataType
    good = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))
    rows = good.groupBy(on).agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))).alias("x")).select("x")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, k, k))
        for pdf in batches:
            x, m = np.zeros((len(pdf), k)), np.zeros((len(pdf), k))
            for r, cells in enumerate(pdf["x"]):
                i = [at[c["k"]] for c in cells]
                x[r, i], m[r, i] = [c["v"] for c in cells], 1.0
            # one matrix at a time, so that no more than one is held besides the sums
            for t, (a, b) in enumerate(((m, m), (x, m), (x * x, m), (x, x))):
                total[t] += a.T @ b
        yield pd.DataFrame({"i": np.arange(k), "sums": [total[:, i, :].ravel().tolist() + total[1:3, :, i].ravel().tolist() for i in range(k)]})

    schema = T.StructType([T.StructField("key_a", kind), T.StructField("key_b", kind), T.StructField("r", T.DoubleType()), T.StructField("n", T.LongType())])

    def finish(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(group[0])
        n, sx, sxx, sxy, sy, syy = np.sum([np.asarray(s) for s in pdf["sums"]], axis=0).reshape(6, k)
        with np.errstate(all="ignore"):
            r = (sxy - sx * sy / n) / np.sqrt((sxx - sx * sx / n) * (syy - sy * sy / n))
        j = [j for j in range(i + 1, k) if n[j] > 0]
        return pd.DataFrame({"key_a": pd.Series([keys[i]] * len(j), dtype=object), "key_b": pd.Series([keys[x] for x in j], dtype=object), "r": [None if not np.isfinite(r[x]) else float(r[x]) for x in j], "n": [int(n[x]) for x in j]})

    return rows.mapInPandas(add, "i long, sums array<double>").groupBy("i").applyInPandas(finish, schema)


def cross_correlations(a: DataFrame, b: DataFrame, key: str, on: str, value: str) -> DataFrame:
    """(key_a, key_b, r) for every series of one table and every one of the other, over the places that
    both have. Series of the two are told apart by their side, then all are taken at once."""
    side = lambda df, s: df.select(F.struct(F.lit(s).alias("side"), F.col(key).alias("key")).alias("_k"), on, F.col(value).cast("double").alias(value))
    both = side(a, 0).unionByName(side(b, 1)).withColumn("_k", F.to_json("_k"))
    p = pair_correlations(both, "_k", on, value)
    at = lambda c: F.from_json(c, T.StructType([T.StructField("side", T.IntegerType()), T.StructField("key", a.schema[key].dataType)]))
    x = p.select(at("key_a").alias("_a"), at("key_b").alias("_b"), "r").filter("_a.side <> _b.side")
    return x.select(F.when(F.col("_a.side") == 0, F.col("_a.key")).otherwise(F.col("_b.key")).alias("key_a"), F.when(F.col("_a.side") == 0, F.col("_b.key")).otherwise(F.col("_a.key")).alias("key_b"), "r")


def gaussian_bias(n: Column) -> Column:
    """What estimating the moments from n values adds to Gaussian information, in bits."""
    return (digamma((n - 2) / 2) - digamma((n - 1) / 2)) / (2 * LN2)


def gaussian_mi(r: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.0), -0.5 * F.log2(1 - r * r) + gaussian_bias(n))


def pair_mi(scores: DataFrame, key: str, on: str, value: str = "z") -> DataFrame:
    return pair_correlations(scores, key, on, value).withColumn("mi", gaussian_mi(F.col("r"), F.col("n")))


def class_mi(df: DataFrame, keys: Sequence[str], value: str, label: str) -> DataFrame:
    """Information between a normal variable and a class: entropy of all values less that within
    the classes, each corrected for its number of values; classes of one value are left out."""
    each = df.groupBy(*keys, label).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))

    def h(n: Column, s: Column, ss: Column) -> Column:
        var = (ss - s * s / n) / (n - 1)
        return 0.5 * F.ln(var) - (LN2 - F.ln(n - 1)) / 2 - digamma((n - 1) / 2) / 2

    per = each.filter("n > 1").withColumn("h", h(F.col("n"), F.col("s"), F.col("ss")))
    within = per.groupBy(*keys).agg(F.sum(F.col("n") * F.col("h")).alias("_w"))
    total = each.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    return total.join(within, list(keys)).select(*keys, F.greatest(F.lit(0.0), (h(F.col("n"), F.col("s"), F.col("ss")) - F.col("_w") / F.col("n")) / LN2).alias("mi"), "n")


def gaussian_triple(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Of three normal variables: I(x; y), I(x; y | z), I(x; y and z), interaction, total and dual
    total correlation and O-information, without bias terms, from their correlations."""
    r = df.agg(F.corr(x, y).alias("a"), F.corr(x, z).alias("b"), F.corr(y, z).alias("c"), F.count("*").alias("n"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    det = 1 + 2 * a * b * c - a * a - b * b - c * c
    dab, dac, dbc = 1 - a * a, 1 - b * b, 1 - c * c
    half = lambda e: 0.5 * F.log2(e)
    mi = -half(dab)
    cmi = half(dac) + half(dbc) - half(det)
    tc = -half(det)
    # dual total correlation: joint entropy less what each variable adds to the other two
    dtc = half(dbc) + half(dac) + half(dab) - 2 * half(det)
    return r.select("n", mi.alias("mi"), cmi.alias("cmi"), (half(dbc) - half(det)).alias("mi_vector"), (cmi - mi).alias("interaction"), tc.alias("tc"), dtc.alias("dtc"), (tc - dtc).alias("o_information"))


def correlation_table(df: DataFrame, key: str, on: str, value: str) -> DataFrame:
    p = pair_correlations(df, key, on, value).select("key_a", "key_b", "r")
    both = p.unionByName(p.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b"), "r"))
    own = df.select(F.col(key).alias("key_a")).distinct().select("key_a", F.col("key_a").alias("key_b"), F.lit(1.0).alias("r"))
    return both.unionByName(own)


def signal_ratio(df: DataFrame, keys: Sequence[str], value: str, on: str) -> DataFrame:
    """Mean value while on over mean value while off; null where there is no off or its mean is 0."""
    m = df.groupBy(*keys).agg(F.avg(F.when(F.col(on), F.col(value))).alias("mean_on"), F.avg(F.when(~F.col(on), F.col(value))).alias("mean_off"))
    return m.withColumn("ratio", F.when(F.col("mean_off") != 0, F.col("mean_on") / F.col("mean_off")))


def binary_mi(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Information in bits between two binary variables, from how often each and both hold among n."""

    def part(o: Column, e: Column) -> Column:
        return F.when(o > 0, o / n * F.log2(o * n / e)).otherwise(0.0)

    return F.greatest(F.lit(0.0), part(both, a * b) + part(a - both, a * (n - b)) + part(b - both, (n - a) * b) + part(n - a - b + both, (n - a) * (n - b)))
