"""Dimension reduction by landmarks: small matrices of landmarks on the driver, all rows placed
among them in parallel.

Up to MOST_LANDMARKS points all are landmarks, so the reduction is fitted to every row. Of more
points a bounded number (checked) carries the geometry; every other point takes part through its
distances to them, so the work grows linearly with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.manifold import moments

#: Landmarks whose distance matrix is held by the driver.
MOST_LANDMARKS = 4_000


def landmarks_of(points: DataFrame) -> DataFrame:
    """All points where the driver can hold their distances, else as many as it can, spread by the
    hash of their id."""
    if points.limit(MOST_LANDMARKS + 1).count() <= MOST_LANDMARKS:
        return points
    return points.orderBy(F.xxhash64("id"), "id").limit(MOST_LANDMARKS)


def gather(landmarks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = landmarks.orderBy("id").limit(MOST_LANDMARKS + 1).collect()
    if len(rows) > MOST_LANDMARKS:
        raise ValueError(f"more than {MOST_LANDMARKS} landmarks")
    return np.array([r.id for r in rows], np.int64), np.array([r.features for r in rows], float)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None, :], 0))


def neighbour_graph(d: np.ndarray, k: int, weighted: bool = False) -> np.ndarray:
    """Symmetric adjacency of the k nearest (either end), 1 or the distance; inf elsewhere."""
    n = len(d)
    g = np.full((n, n), np.inf)
    order = np.argsort(d + np.diag(np.full(n, np.inf)), axis=1)[:, : min(k, n - 1)]
    rows = np.repeat(np.arange(n), order.shape[1])
    g[rows, order.ravel()] = d[rows, order.ravel()] if weighted else 1.0
    g = np.minimum(g, g.T)
    np.fill_diagonal(g, 0)
    return g


def shortest(g: np.ndarray) -> np.ndarray:
    """All shortest paths; parts that don't meet are put at the greatest distance there is."""
    d = g.copy()
    if np.isin(g, (0.0, 1.0, np.inf)).all():  # hops: the front of all points at once
        a, front, step = (g == 1).astype(np.float32), g == 1, 1
        while front.any():
            step += 1
            front = ((front.astype(np.float32) @ a) > 0) & np.isinf(d)
            d[front] = step
    else:
        for k in range(len(d)):
            np.minimum(d, d[:, k : k + 1] + d[k : k + 1, :], out=d)
    top = d[np.isfinite(d)].max() if np.isfinite(d).any() else 0.0
    return np.where(np.isfinite(d), d, top)


def _fixed_sign(v: np.ndarray) -> np.ndarray:
    return v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])]) if v.size else v


def scaling(d: np.ndarray, k: int) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """Classical scaling of a distance matrix; and the placing of a point from its distances."""
    d2 = d**2
    mean = d2.mean(axis=0)
    b = -0.5 * (d2 - mean[:, None] - mean[None, :] + d2.mean())
    lam, vec = np.linalg.eigh(b)
    top = np.argsort(lam)[::-1][:k]
    lam, vec = np.maximum(lam[top], 1e-12), _fixed_sign(vec[:, top])
    push = vec / np.sqrt(lam)
    return vec * np.sqrt(lam), lambda x: -0.5 * (x**2 - mean) @ push


def _spread(coords: np.ndarray, near: int):
    """Placing by the nearest landmarks, weighted by a Gaussian of their distance."""

    def place(d: np.ndarray) -> np.ndarray:
        m = min(near, d.shape[1])
        idx = np.argpartition(d, m - 1, axis=1)[:, :m]
        x = np.take_along_axis(d, idx, 1)
        w = np.exp(-((x / (np.median(x, axis=1, keepdims=True) + 1e-12)) ** 2))
        w /= w.sum(axis=1, keepdims=True)
        return (w[:, :, None] * coords[idx]).sum(axis=1)

    return place


def fit(points: np.ndarray, method: str, k: int, neighbours: int = 15, weighted: bool = False, time: int = 1):
    """Coordinates of the landmarks and how distances to them become coordinates."""
    d = distances(points, points)
    if method == "mds":
        return scaling(d, k)
    if method == "isomap":
        geo = shortest(neighbour_graph(d, neighbours, weighted))
        coords, place = scaling(geo, k)

        def through(x: np.ndarray) -> np.ndarray:
            near = x.argmin(axis=1)
            step = x[np.arange(len(x)), near] if weighted else np.where(x[np.arange(len(x)), near] > 1e-9, 1.0, 0.0)
            return place(geo[near] + step[:, None])

        return coords, through
    if method == "le":
        g = neighbour_graph(d, neighbours)
        a = (np.isfinite(g) & (g > 0)).astype(float)
        deg = a.sum(axis=1)
        s = 1 / np.sqrt(np.maximum(deg, 1e-12))
        lam, vec = np.linalg.eigh(np.eye(len(a)) - s[:, None] * a * s[None, :])
        coords = _fixed_sign(s[:, None] * vec[:, 1 : k + 1])
        coords = coords / np.linalg.norm(coords, axis=0)
        return coords, _spread(coords, neighbours)
    if method == "dmaps":
        sigma = np.median(d[d > 0]) if (d > 0).any() else 1.0
        w = np.exp(-((d / sigma) ** 2))
        s = 1 / np.sqrt(w.sum(axis=1))
        lam, vec = np.linalg.eigh(s[:, None] * w * s[None, :])
        top = np.argsort(lam)[::-1][1 : k + 1]
        coords = _fixed_sign(s[:, None] * vec[:, top]) * lam[top] ** time
        return coords, _spread(coords, neighbours)
    if method == "lle":
        n, m = len(points), min(neighbours, len(points) - 1)
        w = np.zeros((n, n))
        order = np.argsort(d + np.diag(np.full(n, np.inf)), axis=1)[:, :m]
        for i in range(n):
            z = points[order[i]] - points[i]
            c = z @ z.T
            c += np.eye(m) * 1e-3 * (np.trace(c) + 1e-12)
            x = np.linalg.solve(c, np.ones(m))
            w[i, order[i]] = x / x.sum()
        e = np.eye(n) - w
        lam, vec = np.linalg.eigh(e.T @ e)
        coords = _fixed_sign(vec[:, 1 : k + 1])
        return coords, _spread(coords, neighbours)
    if method in ("hlle", "tsne", "umap"):
        coords = _fixed_sign({"hlle": hessian, "tsne": stochastic_neighbours, "umap": fuzzy_layout}[method](points, d, k, neighbours))
        return coords, _spread(coords, neighbours)
    raise ValueError(f"no such method: {method}")


def hessian(points: np.ndarray, d: np.ndarray, k: int, neighbours: int) -> np.ndarray:
    """Coordinates with the least curvature: at each point the neighbours' tangent coordinates, with
    their products, tell the part of a function that bends; what bends nowhere is kept."""
    n, m = len(points), min(max(neighbours, k + k * (k + 1) // 2 + 1), len(points) - 1)
    order = np.argsort(d + np.diag(np.full(n, np.inf)), axis=1)[:, :m]
    bends = np.zeros((n, n))
    upper = np.triu_indices(k)
    for at in order:
        z = points[at] - points[at].mean(axis=0)
        u = np.linalg.svd(z, full_matrices=False)[0][:, :k]
        basis = np.column_stack([np.ones(m), u, u[:, upper[0]] * u[:, upper[1]]])
        bent = np.linalg.qr(basis)[0][:, k + 1 :]
        bends[np.ix_(at, at)] += bent @ bent.T
    # constants don't bend either and mix with the coordinates: what varies is told apart
    flat = np.linalg.eigh(bends)[1][:, : k + 1]
    return np.linalg.svd(flat - flat.mean(axis=0), full_matrices=False)[0][:, :k] * np.sqrt(n)


def _leading(points: np.ndarray, k: int) -> np.ndarray:
    z = points - points.mean(axis=0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    out = np.zeros((len(points), k))
    out[:, : min(k, len(s))] = _fixed_sign(u[:, :k] * s[:k])
    return out / (out[:, :1].std() or 1.0)


def stochastic_neighbours(points: np.ndarray, d: np.ndarray, k: int, neighbours: int, rounds: int = 400) -> np.ndarray:
    """Coordinates whose Student neighbourhoods agree with Gaussian ones of perplexity `neighbours`,
    from the leading axes on, by gradient steps with momentum; the same points give the same result."""
    n = len(points)
    perplexity, d2 = min(neighbours, (n - 1) / 3), d**2
    np.fill_diagonal(d2, np.inf)
    lo, hi, beta = np.zeros(n), np.full(n, np.inf), 1 / np.maximum(np.median(np.where(np.isfinite(d2), d2, 0), axis=1), 1e-12)
    for _ in range(60):  # the width at which the entropy is that of the perplexity
        p = np.exp(-beta[:, None] * (d2 - d2.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        h = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
        wide = h > np.log(perplexity)
        lo, hi = np.where(wide, beta, lo), np.where(wide, hi, beta)
        beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = 1e-2 * _leading(points, k)
    step, gain, rate = np.zeros_like(y), np.ones_like(y), max(n / 12 / 4, 10.0)
    for r in range(rounds):
        w = 1 / (1 + distances(y, y) ** 2)
        np.fill_diagonal(w, 0)
        f = (p * (12 if r < rounds // 4 else 1) - w / w.sum()) * w
        slope = 4 * (f.sum(axis=1)[:, None] * y - f @ y)
        gain = np.maximum(np.where(np.sign(slope) != np.sign(step), gain + 0.2, gain * 0.8), 0.01)
        step = (0.5 if r < rounds // 4 else 0.8) * step - rate * gain * slope
        y = y + step
    return y - y.mean(axis=0)


def fuzzy_layout(points: np.ndarray, d: np.ndarray, k: int, neighbours: int, rounds: int = 300, spread: float = 1.5, power: float = 0.9) -> np.ndarray:
    """Coordinates of a fuzzy neighbour graph: memberships fall from the nearest neighbour on so that
    they add up to log2 of the neighbours, joined by either end; edges pull and all pairs push."""
    n, m = len(points), min(neighbours, len(points) - 1)
    order = np.argsort(d + np.diag(np.full(n, np.inf)), axis=1)[:, :m]
    near = np.take_along_axis(d, order, 1)
    first, lo, hi = near[:, :1], np.full(n, 1e-9), np.full(n, near.max() * 100 + 1e-9)
    for _ in range(60):
        mid = np.sqrt(lo * hi)
        much = np.exp(-np.maximum(near - first, 0) / mid[:, None]).sum(axis=1) > np.log2(max(m, 2))
        lo, hi = np.where(much, lo, mid), np.where(much, mid, hi)
    w = np.zeros((n, n))
    w[np.repeat(np.arange(n), m), order.ravel()] = np.exp(-np.maximum(near - first, 0) / mid[:, None]).ravel()
    w = w + w.T - w * w.T
    y = 10 * _leading(points, k)
    for r in range(rounds):
        d2 = distances(y, y) ** 2
        pull = w * (2 * spread * power * np.maximum(d2, 1e-6) ** (power - 1)) / (1 + spread * d2**power)
        push = (1 - w) * 2 * power / ((0.001 + d2) * (1 + spread * d2**power)) * (w.sum() / n**2) * 5
        np.fill_diagonal(push, 0)
        f = push - pull
        move = np.clip(f.sum(axis=1)[:, None] * y - f @ y, -4, 4)
        y = y + (1 - r / rounds) * 0.3 * move
    return y - y.mean(axis=0)


def embed(points: DataFrame, landmarks: DataFrame, method: str, k: int = 2, **options) -> DataFrame:
    """(id, features): every point in k dimensions; landmarks keep the coordinates fitted to them."""
    ids, x = gather(landmarks)
    if len(ids) < k + 2:
        raise ValueError("too few landmarks")
    coords, place = fit(x, method, k, **options)
    at = {int(i): c for i, c in zip(ids, coords)}
    if landmarks is points:  # none is left to be placed
        x, place = x[:0], lambda d: np.zeros((len(d), k))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = np.array(pdf["features"].tolist(), float).reshape(len(pdf), -1)
            out = place(distances(p, x)) if len(p) else np.zeros((0, k))
            for r, i in enumerate(pdf["id"]):
                if int(i) in at:
                    out[r] = at[int(i)]
            yield pd.DataFrame({"id": pdf["id"], "features": out.tolist()})

    return points.mapInPandas(run, "id long, features array<double>")


#: Pairs that one block of queries may have; their vectors are sent to every task.
BLOCK_PAIRS = 20_000


def closer_counts(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query, id, rank): how many points other than the query are nearer to it than id is (ties: the
    lesser id). Blocks of pairs meet all points, and only counts leave a partition."""
    at = points.select(F.col("id").alias("_i"), "features")
    full = pairs.join(at.withColumnRenamed("features", "q"), F.col("query") == F.col("_i")).drop("_i").join(at.withColumnRenamed("features", "x"), F.col("id") == F.col("_i")).drop("_i")
    parts: list[DataFrame] = []
    rows: list = []

    def flush() -> None:
        qid, pid = np.array([r.query for r in rows]), np.array([r.id for r in rows])
        q, x = np.array([r.q for r in rows], float), np.array([r.x for r in rows], float)
        held = points.sparkSession.sparkContext.broadcast((qid, pid, q, np.round(((q - x) ** 2).sum(axis=1), 12)))

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qid, pid, q, limit = held.value
            n = np.zeros(len(qid), np.int64)
            uniq, first, inverse = np.unique(qid, return_index=True, return_inverse=True)
            of = [np.flatnonzero(inverse == u) for u in range(len(uniq))]
            for pdf in batches:
                p, i = np.array(pdf["features"].tolist(), float).reshape(len(pdf), -1), pdf["id"].to_numpy()
                for u, mine in enumerate(of):
                    other = i != uniq[u]
                    d = np.round(((p[other] - q[first[u]]) ** 2).sum(axis=1), 12)
                    n[mine] += ((d[None, :] < limit[mine, None]) | ((d[None, :] == limit[mine, None]) & (i[other][None, :] < pid[mine, None]))).sum(axis=1)
            yield pd.DataFrame({"query": qid, "id": pid, "n": n})

        parts.append(points.mapInPandas(count, "query long, id long, n long"))

    for r in full.toLocalIterator():
        rows.append(r)
        if len(rows) == BLOCK_PAIRS:
            flush()
            rows = []
    if rows:
        flush()
    if not parts:
        return pairs.withColumn("rank", F.lit(0).cast("long")).limit(0)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("query", "id").agg(F.sum("n").alias("rank"))


def trustworthiness(high: DataFrame, near_low: DataFrame, k: int) -> DataFrame:
    """1 - sum of (rank - k) over neighbours in the low space whose rank in the high space exceeds k,
    over the queries times k times (n - 1 - k); ranks begin at 1. Continuity is the same with the
    spaces changed."""
    ranks = closer_counts(high, near_low.select("query", "id"))
    n = high.agg(F.count("*").alias("_n"))
    total = ranks.agg(F.sum(F.when(F.col("rank") + 1 > k, F.col("rank") + 1 - k).otherwise(0)).alias("_s"), F.count_distinct("query").alias("_q"))
    return total.crossJoin(n).select(F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("_s"), F.col("_q") * k * (F.col("_n") - 1 - k))).alias("score"))


def linear_decoder(df: DataFrame, target: str, every: int = 5) -> DataFrame:
    """(n_train, n_test, r2, mean_error): least squares from features to a target, fitted to the rows
    whose id isn't divisible by `every` and judged on the others. Only sums of products leave the
    partitions."""
    both = df.filter(F.col(target).isNotNull()).select("id", F.concat(F.array(F.lit(1.0)), F.col("features"), F.array(F.col(target).cast("double"))).alias("features"))
    n, _, g = moments(both.filter(F.col("id") % every != 0))
    spark = df.sparkSession
    schema = "n_train long, n_test long, r2 double, mean_error double"
    if n == 0:
        return spark.createDataFrame([], schema)
    d = len(g) - 1
    beta = np.linalg.lstsq(g[:d, :d] + 1e-9 * np.eye(d), g[:d, d], rcond=None)[0]

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["features"].tolist(), float).reshape(len(pdf), -1)
            yield pd.DataFrame({"y": x[:, -1], "p": x[:, :-1] @ beta})

    test = both.filter(F.col("id") % every == 0).mapInPandas(predict, "y double, p double")
    m = test.agg(F.count("*").alias("n_test"), F.avg((F.col("y") - F.col("p")) ** 2).alias("_e"), F.var_pop("y").alias("_v"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mean_error"))
    return m.select(F.lit(n).cast("long").alias("n_train"), "n_test", (1 - F.try_divide(F.col("_e"), F.col("_v"))).alias("r2"), "mean_error")


def circular_alignment(df: DataFrame, truth: str, decoded: str, steps: int = 360) -> DataFrame:
    """(offset, reflected, error): the turn, one of `steps`, and reflection of decoded angles that
    leave the least mean angular error; the first of equals."""
    grid = df.sparkSession.range(2 * steps).select((F.col("id") % steps * (2 * np.pi / steps)).alias("offset"), (F.col("id") >= steps).alias("reflected"), "id")
    each = df.select(truth, decoded).filter(F.col(truth).isNotNull() & F.col(decoded).isNotNull()).crossJoin(F.broadcast(grid))  # a fixed grid
    turned = F.when(F.col("reflected"), -F.col(decoded)).otherwise(F.col(decoded)) + F.col("offset")
    miss = F.abs(F.pmod(turned - F.col(truth) + np.pi, F.lit(2 * np.pi)) - np.pi)
    mean = each.groupBy("id", "offset", "reflected").agg(F.avg(miss).alias("error"))
    return mean.agg(F.min(F.struct(F.round("error", 9).alias("error"), "id", "offset", "reflected")).alias("_b")).select("_b.offset", "_b.reflected", "_b.error")


def alignment_quality(df: DataFrame, truth: str, decoded: str, held_out: str) -> DataFrame:
    """(offset, reflected, train_error, test_error): turn and reflection that fit the rows where the
    truth column held_out is false best, and the mean angular error on these and on the others."""
    best = circular_alignment(df.filter(~F.col(held_out)), truth, decoded)
    both = df.filter(F.col(truth).isNotNull() & F.col(decoded).isNotNull()).crossJoin(F.broadcast(best))  # one row
    turned = F.when(F.col("reflected"), -F.col(decoded)).otherwise(F.col(decoded)) + F.col("offset")
    miss = F.abs(F.pmod(turned - F.col(truth) + np.pi, F.lit(2 * np.pi)) - np.pi)
    return both.groupBy("offset", "reflected").agg(F.avg(F.when(~F.col(held_out), miss)).alias("train_error"), F.avg(F.when(F.col(held_out), miss)).alias("test_error"))


def forest_decoder(df: DataFrame, targets: list[str], trees: int = 20, depth: int = 3, leaf: int = 50, seed: int = 42) -> DataFrame:
    """(target, n_train, n_test, r2): a random forest from features to each target, fitted to the half
    of the rows that the hash of their id names and judged on the other; r2 is not below 0."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    rows = df.select("id", array_to_vector("features").alias("features"), *targets).withColumn("_test", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2)) == 1)
    out = []
    for target in targets:
        some = rows.filter(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double"))).withColumn(target, F.col(target).cast("double"))
        model = RandomForestRegressor(labelCol=target, predictionCol="_p", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed).fit(some.filter("not _test"))
        m = model.transform(some.filter("_test")).agg(F.count("*").alias("n_test"), F.avg((F.col(target) - F.col("_p")) ** 2).alias("_e"), F.var_pop(target).alias("_v"))
        n = some.filter("not _test").agg(F.count("*").alias("n_train"))
        out.append(n.crossJoin(m).select(F.lit(target).alias("target"), "n_train", "n_test", F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("_e"), F.col("_v"))).alias("r2")))  # one row each
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every
