"""Graphs as edge tables (src, dst, w): degrees, matrices, components, paths, spectra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.ordering import global_rank
from tessella.session import cut

#: Nodes of a graph whose matrix may be brought to the driver.
MATRIX_NODES = 4_000


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, degree, strength): degree counts different neighbours."""
    e = edges.select("src", "dst", "w")
    both = e.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i"), "w").unionByName(
        e.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).cast("double").alias("w"))
    )
    return both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count_distinct("other").alias("degree"), F.sum("w").alias("strength"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, w): each pair a < b once, weights of both directions added."""
    return without_loops(edges).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("w"))


def symmetric_part(edges: DataFrame) -> DataFrame:
    """Edges whose reverse exists."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["src", "dst"], "left_semi")


def asymmetric_part(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["src", "dst"], "left_anti")


def symmetry_index(edges: DataFrame) -> DataFrame:
    """Share of edges whose reverse exists, loops left out."""
    e = without_loops(edges).select("src", "dst").distinct()
    both = symmetric_part(e).agg(F.count("*").alias("_s"))
    return e.agg(F.count("*").alias("_n")).crossJoin(both).select(F.try_divide(F.col("_s"), F.col("_n")).alias("symmetry"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): least id of the connected component. Labels halve their distance to the
    root each round (small-star and large-star), so rounds grow with the logarithm of the size."""
    e = cut(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter("u <> v").distinct())
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    while True:
        # large star: every greater neighbour goes to the least of the neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours and the node itself go to the least
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("x"), "m").unionByName(low.select(F.col("u").alias("x"), "m")).filter("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        new = cut(small)
        # done when every node hangs on a root, and the edges no longer change
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            break
        e = new
    return nodes.join(e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def giant_component(edges: DataFrame) -> DataFrame:
    """(id): nodes of the largest component, the one with the least id among equals."""
    c = components(edges)
    best = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return c.join(F.broadcast(best.select("component")), "component", "left_semi").select("id")


def clusters_by_size(edges: DataFrame) -> DataFrame:
    """(place, component, size): components by falling size, the one with the least id first among
    equals; place counts from 1."""
    size = components(edges).groupBy("component").agg(F.count("*").alias("size"))
    placed = global_rank(size.withColumn("_s", -F.col("size")), [], ["_s", "component"], "place")
    return placed.select((F.col("place") + 1).alias("place"), "component", "size")


def laplacian(edges: DataFrame) -> DataFrame:
    """(i, j, value) of D - A, D the column sums of A."""
    a = edges.groupBy(F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.sum("w").alias("w"))
    d = a.groupBy("j").agg(F.sum("w").alias("value")).select(F.col("j").alias("i"), "j", "value")
    return a.select("i", "j", (-F.col("w")).alias("value")).unionByName(d).groupBy("i", "j").agg(F.sum("value").alias("value"))


def transition(edges: DataFrame) -> DataFrame:
    """(i, j, p): A[i, j] over the column sum of i, so directed rows need not add up to 1."""
    a = edges.groupBy(F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.sum("w").alias("w"))
    d = a.groupBy(F.col("j").alias("i")).agg(F.sum("w").alias("_d"))
    return a.join(d, "i").select("i", "j", F.try_divide(F.col("w"), F.col("_d")).alias("p"))


def clustering(edges: DataFrame) -> DataFrame:
    """(id, triangles, coefficient) of the undirected graph. Edges point from the lesser to the
    greater degree, so a hub opens few wedges."""
    e = undirected(edges).select("a", "b")
    deg = e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    da, db = deg.select(F.col("id").alias("a"), F.col("degree").alias("_da")), deg.select(F.col("id").alias("b"), F.col("degree").alias("_db"))
    first = (F.col("_da") < F.col("_db")) | ((F.col("_da") == F.col("_db")) & (F.col("a") < F.col("b")))
    out = e.join(da, "a").join(db, "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedges = out.join(out.withColumnRenamed("y", "z"), "x").filter("y < z")
    tri = wedges.join(e.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"]).select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    k = F.col("degree")
    t = F.coalesce("triangles", F.lit(0))
    return deg.join(tri, "id", "left").select("id", t.alias("triangles"), F.coalesce(F.try_divide(2.0 * t, k * (k - 1)), F.lit(0.0)).alias("coefficient"))


def hops(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id, hops): shortest unweighted paths from the given nodes (column id), until no new
    node is reached."""
    e = undirected(edges)
    e = cut(e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    seen = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("hops")))
    front, k = seen, 0
    while True:
        k += 1
        reach = front.join(e, front["id"] == e["u"]).select("source", F.col("v").alias("id")).distinct()
        front = cut(reach.join(seen, ["source", "id"], "left_anti").withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def dense(edges: DataFrame, symmetric: bool = True) -> np.ndarray:
    """The matrix of a small graph on the driver; the number of nodes is checked."""
    ids = [r.id for r in edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().orderBy("id").limit(MATRIX_NODES + 1).collect()]
    if len(ids) > MATRIX_NODES:
        raise ValueError(f"more than {MATRIX_NODES} nodes")
    at = {x: k for k, x in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for r in edges.groupBy("src", "dst").agg(F.sum("w").alias("w")).collect():
        a[at[r.src], at[r.dst]] = r.w
    return (a + a.T) / 2 if symmetric else a


def spectrum(edges: DataFrame, normalised: bool = True) -> DataFrame:
    """(rank, eigenvalue) of the (normalised) Laplacian of the symmetrised graph, ascending."""
    a = dense(without_loops(edges))
    d = a.sum(axis=0)
    lap = np.diag(d) - a
    if normalised and len(d):
        s = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
        lap = s[:, None] * lap * s[None, :]
    return edges.sparkSession.createDataFrame([(k, float(v)) for k, v in enumerate(np.linalg.eigvalsh(lap))] if len(d) else [], "rank int, eigenvalue double")


def spectral_entropy(edges: DataFrame, times: list[float]) -> DataFrame:
    """(t, entropy, free_entropy): of the weights exp(-t lambda) over the Laplacian spectrum, bits."""
    lam = np.array([r.eigenvalue for r in spectrum(edges).collect()])
    rows = []
    for t in times:
        w = np.exp(-t * lam)
        p = w / w.sum() if len(lam) else w
        rows.append((float(t), float(-(p[p > 0] * np.log2(p[p > 0])).sum()), float(np.log2(w.sum())) if len(lam) else 0.0))
    return edges.sparkSession.createDataFrame(rows, "t double, entropy double, free_entropy double")


def hyperbolicity(edges: DataFrame, quadruples: int = 100_000, seed: int = 7) -> DataFrame:
    """(quadruples, mean): Gromov hyperbolicity of hop distances over quadruples of nodes drawn by
    whole-number arithmetic: half of the greatest less the middle of the three sums of distances.
    Quadruples with equal nodes or without a path are left out."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    named = global_rank(nodes, [], ["id"], "k").select("id", "k")
    d = cut(hops(edges, nodes).join(named.select(F.col("id").alias("source"), F.col("k").alias("i")), "source").join(named.select("id", F.col("k").alias("j")), "id").select("i", "j", "hops"))
    n = named.agg(F.count("*").alias("n"))
    draw = edges.sparkSession.range(quadruples).crossJoin(F.broadcast(n))
    for c, (a, b) in zip("pqrs", ((7919, 104729), (15485863, 611953), (32452843, 49979), (86028121, 15487))):
        draw = draw.withColumn(c, F.pmod(F.col("id") * a + F.pmod(F.col("id") * F.col("id"), F.lit(1_000_003)) * b + seed, F.col("n")))
    draw = draw.filter("p <> q and p <> r and p <> s and q <> r and q <> s and r <> s")
    for x, y in ("pq", "rs", "pr", "qs", "ps", "qr"):
        draw = draw.join(d.select(F.col("i").alias(x), F.col("j").alias(y), F.col("hops").alias(f"d{x}{y}")), [x, y])
    sums = F.array_sort(F.array(F.col("dpq") + F.col("drs"), F.col("dpr") + F.col("dqs"), F.col("dps") + F.col("dqr")))
    return draw.agg(F.count("*").alias("quadruples"), F.avg((sums[2] - sums[1]) / 2).alias("mean"))


def _clustering_and_length(a: np.ndarray) -> tuple[float, float]:
    """Mean clustering coefficient and mean path length of an adjacency matrix, over pairs that meet."""
    k = a.sum(axis=1)
    triangles = np.einsum("ij,ji->i", a @ a, a)
    c = np.where(k > 1, triangles / np.maximum(k * (k - 1), 1), 0).mean()
    reach, dist, step = np.eye(len(a), dtype=bool), np.zeros_like(a), 0
    front = reach.copy()
    while front.any():
        step += 1
        front = ((front.astype(float) @ a) > 0) & ~reach
        dist[front] = step
        reach |= front
    met = dist > 0
    return float(c), float(dist[met].mean()) if met.any() else 0.0


def small_world(edges: DataFrame, graphs: int = 10, seed: int = 0) -> DataFrame:
    """(clustering, length, index): of the undirected graph, and (C / C0) / (L / L0) against the mean
    of random graphs with as many nodes and edges. A small graph, on the driver."""
    a = (dense(without_loops(edges)) > 0).astype(float)
    n, m = len(a), int(a.sum() / 2)
    c, length = _clustering_and_length(a) if n else (0.0, 0.0)
    rng, base = np.random.default_rng(seed), []
    i, j = np.triu_indices(n, 1)
    for _ in range(graphs if m else 0):
        r = np.zeros_like(a)
        pick = rng.choice(len(i), size=m, replace=False)
        r[i[pick], j[pick]] = r[j[pick], i[pick]] = 1
        base.append(_clustering_and_length(r))
    c0, l0 = np.mean(base, axis=0) if base else (0.0, 0.0)
    index = (c / c0) / (length / l0) if c0 > 0 and length > 0 and l0 > 0 else None
    return edges.sparkSession.createDataFrame([(c, length, None if index is None else float(index))], "clustering double, length double, index double")
