"""Delay embeddings, ordinal patterns, visibility and recurrence graphs of rows (key, t, value)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.ordering import global_rank
from tessella.operators.signal import islands


def takens(df: DataFrame, dim: int, tau: int) -> DataFrame:
    """(key, t, point): x[t], x[t + tau], ...; places without all of them are left out. Equi-joins
    on the place, so a series needs no single task."""
    out = df.select("key", "t", F.array("value").alias("point"))
    for j in range(1, dim):
        nxt = df.select("key", (F.col("t") - j * tau).alias("t"), F.col("value").alias("_v"))
        out = out.join(nxt, ["key", "t"]).select("key", "t", F.concat("point", F.array("_v")).alias("point"))
    return out


def ordinal_patterns(df: DataFrame, dim: int, tau: int) -> DataFrame:
    """(key, t, pattern): the places of an embedded point in order of value (ties: the earlier)."""
    indexed = F.transform("point", lambda x, i: F.struct(x.alias("v"), i.alias("i")))
    return takens(df, dim, tau).select("key", "t", F.array_join(F.transform(F.array_sort(indexed), lambda s: s["i"].cast("string")), "").alias("pattern"))


def permutation_entropy(patterns: DataFrame, dim: int) -> DataFrame:
    """Entropy of the patterns over log2 of dim factorial."""
    n = patterns.groupBy("key", "pattern").agg(F.count("*").alias("n"))
    return n.groupBy("key").agg(((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")) / math.log2(math.factorial(dim))).alias("entropy"))


def pattern_transitions(patterns: DataFrame) -> DataFrame:
    """(key, src, dst, p): moves between different patterns at neighbouring places, per source."""
    nxt = patterns.select("key", (F.col("t") - 1).alias("t"), F.col("pattern").alias("dst"))
    moves = patterns.join(nxt, ["key", "t"]).filter(F.col("pattern") != F.col("dst")).groupBy("key", F.col("pattern").alias("src"), "dst").agg(F.count("*").alias("n"))
    total = moves.groupBy("key", "src").agg(F.sum("n").alias("_n"))
    return moves.join(total, ["key", "src"]).select("key", "src", "dst", (F.col("n") / F.col("_n")).alias("p"))


def _horizontal(v: np.ndarray, strict: bool) -> list[tuple[int, int]]:
    """Pairs that see each other horizontally, by a stack of falling values; without strict a value
    also sees past equal ones."""
    out, stack = [], []
    for b, x in enumerate(v):
        while stack:
            a = stack[-1]
            out.append((a, b))
            if v[a] > x or (v[a] == x and not strict):
                break
            stack.pop()
            if v[a] == x:
                break
        stack.append(b)
    return out


def _natural(v: np.ndarray) -> list[tuple[int, int]]:
    """Pairs whose connecting line lies above all values between: from each place, the slopes that
    exceed all before."""
    out, n = [], len(v)
    for a in range(n - 1):
        slope = (v[a + 1 :] - v[a]) / np.arange(1, n - a)
        best = np.maximum.accumulate(np.append(-np.inf, slope[:-1]))
        out += [(a, a + 1 + int(k)) for k in np.flatnonzero(slope > best)]
    return out


def visibility(df: DataFrame, kind: str = "horizontal", strict: bool = False) -> DataFrame:
    """(key, a, b): edges a < b of the visibility graph of each series, which is as long as its
    session and comes whole into one call."""
    key = df.schema["key"]
    schema = T.StructType([key, T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        v, t = pdf["value"].to_numpy(), pdf["t"].to_numpy()
        e = np.array(_horizontal(v, strict) if kind == "horizontal" else _natural(v), np.int64).reshape(-1, 2)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "a": t[e[:, 0]], "b": t[e[:, 1]]})

    return df.groupBy("key").applyInPandas(run, schema)


def recurrences(df: DataFrame, eps: float, theiler: int = 1) -> DataFrame:
    """(key, i, j): i < j at least theiler apart whose values differ by at most eps. Values are put
    into bands of eps, and only neighbouring bands are joined."""
    banded = df.withColumn("_b", F.floor(F.col("value") / eps))
    a = banded.select("key", F.col("t").alias("i"), F.col("value").alias("_x"), F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"))
    b = banded.select("key", F.col("t").alias("j"), F.col("value").alias("_y"), "_b")
    return a.join(b, ["key", "_b"]).filter((F.col("j") - F.col("i") >= theiler) & (F.abs(F.col("_x") - F.col("_y")) <= eps)).select("key", "i", "j")


def line_measures(rec: DataFrame, least: int = 2) -> DataFrame:
    """Per key, of the upper triangle: share of points on diagonal lines of at least `least` (det),
    their mean and greatest length, divergence and the entropy (natural) of their lengths; of both
    triangles: share of points on vertical lines (laminarity) and their mean length (trapping)."""
    diag = rec.select(F.struct("key", (F.col("j") - F.col("i")).alias("d")).alias("key"), F.col("i").alias("t"))
    lines = islands(diag).select("key.key", (F.col("end") - F.col("start")).alias("len"))
    points = rec.groupBy("key").agg(F.count("*").alias("points"))
    n = lines.filter(F.col("len") >= least).groupBy("key", "len").agg(F.count("*").alias("k"))
    agg = n.groupBy("key").agg(
        F.sum(F.col("k") * F.col("len")).alias("_on"), F.sum("k").alias("_k"), F.max("len").alias("l_max"), (F.ln(F.sum("k")) - F.sum(F.col("k") * F.ln("k")) / F.sum("k")).alias("entropy")
    )
    both = rec.unionByName(rec.select("key", F.col("j").alias("i"), F.col("i").alias("j")))
    vertical = islands(both.select(F.struct("key", F.col("i").alias("d")).alias("key"), F.col("j").alias("t"))).select("key.key", (F.col("end") - F.col("start")).alias("len"))
    on = F.when(F.col("len") >= least, F.col("len"))
    trapped = vertical.groupBy("key").agg((F.sum(on) / F.sum("len")).alias("_lam"), F.avg(on).alias("_tt"))
    out = points.join(agg, "key", "left").join(trapped, "key", "left")
    return out.select(
        "key", "points", F.coalesce(F.col("_on") / F.col("points"), F.lit(0.0)).alias("det"), F.coalesce(F.col("_on") / F.col("_k"), F.lit(0.0)).alias("l_mean"),
        F.coalesce("l_max", F.lit(0)).alias("l_max"), F.coalesce(F.try_divide(F.lit(1.0), F.col("l_max")), F.lit(0.0)).alias("divergence"), F.coalesce("entropy", F.lit(0.0)).alias("entropy"),
        F.coalesce("_lam", F.lit(0.0)).alias("laminarity"), F.coalesce("_tt", F.lit(0.0)).alias("trapping"),
    )


def joint_graph(edges: DataFrame, share: float) -> DataFrame:
    """(a, b, n): edges that at least the given share of all graphs (keys) have."""
    total = edges.select("key").distinct().agg(F.count("*").alias("_g"))
    n = edges.groupBy("a", "b").agg(F.count_distinct("key").alias("n"))
    return n.crossJoin(F.broadcast(total)).filter(F.col("n") >= share * F.col("_g")).drop("_g")


def edge_jaccard(edges: DataFrame) -> DataFrame:
    """(key_a, key_b, jaccard) of the edge sets of every two graphs with a common edge."""
    e = edges.select("key", "a", "b").distinct()
    size = e.groupBy("key").agg(F.count("*").alias("n"))
    both = e.withColumnRenamed("key", "key_a").join(e.withColumnRenamed("key", "key_b"), ["a", "b"]).filter(F.col("key_a") < F.col("key_b")).groupBy("key_a", "key_b").agg(F.count("*").alias("_c"))
    s = both.join(size.select(F.col("key").alias("key_a"), F.col("n").alias("_na")), "key_a").join(size.select(F.col("key").alias("key_b"), F.col("n").alias("_nb")), "key_b")
    return s.select("key_a", "key_b", (F.col("_c") / (F.col("_na") + F.col("_nb") - F.col("_c"))).alias("jaccard"))


def lagged_information(df: DataFrame, most: int, bins: int) -> DataFrame:
    """(key, lag, mi): information in bits between a series and itself `lag` places later, over bins
    of equal size by ordinal rank."""
    ranked = global_rank(df, ["key"], ["value", "t"], "_r")
    n = df.groupBy("key").agg(F.count("*").alias("_n"))
    # bins whose sizes differ by one at most, the first ones larger
    size, more = F.floor(F.col("_n") / bins), F.pmod("_n", F.lit(bins))
    cut = (size + 1) * more
    b = F.when(F.col("_r") < cut, F.floor(F.try_divide(F.col("_r"), size + 1))).otherwise(more + F.floor(F.try_divide(F.col("_r") - cut, size)))
    x = ranked.join(n, "key").select("key", "t", b.cast("int").alias("b"))
    later = x.select("key", F.col("t").alias("_t"), F.col("b").alias("c"))
    p = x.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("_t", F.col("t") + F.col("lag")).join(later, ["key", "_t"])
    joint = p.groupBy("key", "lag", "b", "c").agg(F.count("*").alias("n"))
    sums = lambda *by: joint.groupBy("key", "lag", *by).agg(F.sum("n").alias("n")).groupBy("key", "lag").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h_" + "".join(by)))
    h = sums("b").join(sums("c"), ["key", "lag"]).join(sums("b", "c"), ["key", "lag"])
    return h.select("key", "lag", (F.col("h_b") + F.col("h_c") - F.col("h_bc")).alias("mi"))


def choose_delay(lagged: DataFrame) -> DataFrame:
    """(key, delay): the first local minimum of the lagged information, else the first lag below 1/e
    of the first, else a third of the lags."""
    rows = F.array_sort(F.collect_list(F.struct("lag", F.round("mi", 9).alias("mi"))))
    a = lagged.groupBy("key").agg(rows.alias("_a"))
    n = F.size("_a")
    inner = F.filter(F.transform("_a", lambda x, i: F.struct(x["lag"].alias("lag"), x["mi"].alias("m"), F.get("_a", i - 1)["mi"].alias("p"), F.get("_a", i + 1)["mi"].alias("q"))), lambda x: (x["m"] < x["p"]) & (x["m"] < x["q"]))
    small = F.filter("_a", lambda x: x["mi"] < F.element_at("_a", 1)["mi"] / math.e)
    return a.select("key", F.coalesce(F.get(inner, F.lit(0))["lag"], F.get(small, F.lit(0))["lag"], F.floor(n / 3)).cast("int").alias("delay"))


def false_neighbours(df: DataFrame, most: int, tau: int, ratio: float = 10.0, size: float = 2.0) -> DataFrame:
    """(key, dim, share): share of points whose nearest neighbour in dim dimensions is false in the
    next: its distance grows by more than ratio, or lies beyond size deviations. A series, as long
    as its recording, comes whole into one call."""
    kind = df.schema["key"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["value"].to_numpy()
        sd, out = x.std(), []
        for m in range(1, most + 1):
            n = len(x) - m * tau
            if n < 3:
                break
            e = np.column_stack([x[j * tau : j * tau + n] for j in range(m)])
            nearest, at = np.full(n, np.inf), np.zeros(n, int)
            for a in range(0, n, 256):
                d = np.sqrt(((e[a : a + 256, None, :] - e[None, :, :]) ** 2).sum(axis=2))
                d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
                nearest[a : a + 256], at[a : a + 256] = d.min(axis=1), d.argmin(axis=1)
            grow = np.abs(x[np.arange(n) + m * tau] - x[at + m * tau])
            far = np.sqrt(nearest**2 + grow**2) > size * sd
            steep = np.where(nearest > 1e-10, grow / np.maximum(nearest, 1e-10), 0) > ratio
            out.append((pdf["key"].iloc[0], m, float((far | steep).mean())))
        return pd.DataFrame(out, columns=["key", "dim", "share"])

    return df.groupBy("key").applyInPandas(run, f"key {kind}, dim int, share double")
