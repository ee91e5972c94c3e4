"""Point clouds (id, features, label): neighbours, distances, dimension, dissimilarity matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.ordering import global_rank

#: Bytes of query vectors sent to every task at once; more queries are searched in further blocks.
BLOCK_BYTES = 64_000_000
#: Features whose covariance may be brought to the driver.
MATRIX_FEATURES = 4_000


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def cosine_similarity(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def points(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, features) of the rows with a whole vector."""
    return df.filter(F.col(id_).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("features"))


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows, size = [], [], 0
    for r in queries.toLocalIterator():
        ids.append(r.id)
        rows.append(r.features)
        size += 8 * len(r.features)
        if size > BLOCK_BYTES:
            yield np.array(ids), np.array(rows)
            ids, rows, size = [], [], 0
    if ids:
        yield np.array(ids), np.array(rows)


def nearest(all_points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, distance, rank): the k nearest other points of each query point, exactly; rank 1
    is the nearest, ties go to the lesser id. Blocks of queries meet all rows; every partition
    sends k candidates a query, and these are merged."""
    out = None
    for ids, vectors in _blocks(queries):
        held = all_points.sparkSession.sparkContext.broadcast((ids, vectors, (vectors**2).sum(axis=1)))

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            qid, q, _ = held.value
            best_d, best_i = np.full((len(qid), 0), np.inf), np.zeros((len(qid), 0), np.int64)
            for pdf in batches:
                pid = pdf["id"].to_numpy()
                x = np.array(pdf["features"].tolist(), float).reshape(len(pid), -1)
                for a in range(0, len(pid), 2048):
                    p, i = x[a : a + 2048], pid[a : a + 2048]
                    d = np.maximum((q**2).sum(axis=1)[:, None] - 2 * q @ p.T + (p**2).sum(axis=1)[None, :], 0)
                    d[qid[:, None] == i[None, :]] = np.inf
                    d = np.concatenate([best_d, d], axis=1)
                    i = np.concatenate([best_i, np.broadcast_to(i, (len(qid), len(i)))], axis=1)
                    if d.shape[1] > k + 8:  # a few more, for ties at the border
                        keep = np.argpartition(d, k + 8, axis=1)[:, : k + 8]
                        d, i = np.take_along_axis(d, keep, 1), np.take_along_axis(i, keep, 1)
                    best_d, best_i = d, i
            n = best_d.shape[1]
            flat = pd.DataFrame({"query": np.repeat(qid, n), "id": best_i.ravel(), "d": best_d.ravel()})
            yield flat[np.isfinite(flat["d"])]

        part = all_points.mapInPandas(scan, "query long, id long, d double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return all_points.sparkSession.createDataFrame([], "query long, id long, distance double, rank int")
    # k and a few candidates per query and partition: the lists merge pairwise as they are shuffled
    top = out.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.round("d", 12).alias("d"), "id"))), 1, k).alias("_t"))
    return top.select("query", F.posexplode("_t").alias("_p", "_x")).select("query", F.col("_x.id").alias("id"), F.sqrt("_x.d").alias("distance"), (F.col("_p") + 1).alias("rank"))


def _distance(metric: str | Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from two sets of points (rows) to the matrix of their distances."""
    named = {
        "euclidean": lambda a, b: np.sqrt(np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None], 0)),
        "cityblock": lambda a, b: np.abs(a[:, None] - b[None]).sum(2),
        "chebyshev": lambda a, b: np.abs(a[:, None] - b[None]).max(2),
        "cosine": lambda a, b: 1 - (a @ b.T) / np.maximum(np.sqrt((a**2).sum(1)[:, None] * (b**2).sum(1)[None]), 1e-300),
    }
    if callable(metric):
        return metric
    if metric not in named:
        raise ValueError(f"no such metric: {metric}")
    return named[metric]


def _met(all_points: DataFrame, queries: DataFrame, rows: Callable[[np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str, metric) -> DataFrame:
    """Blocks of queries meet all points: rows(query ids, point ids, distances) for each block and
    batch, the query itself at infinite distance."""
    f, out = _distance(metric), None
    for ids, vectors in _blocks(queries):
        held = all_points.sparkSession.sparkContext.broadcast((ids, vectors))

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            qid, q = held.value
            for pdf in batches:
                x, pid = np.array(pdf["features"].tolist(), float).reshape(len(pdf), -1), pdf["id"].to_numpy()
                for a in range(0, len(pid), 512):
                    d = np.asarray(f(q, x[a : a + 512]), float).copy()
                    d[qid[:, None] == pid[None, a : a + 512]] = np.inf
                    yield rows(qid, pid[a : a + 512], d)

        part = all_points.mapInPandas(scan, schema)
        out = part if out is None else out.unionByName(part)
    return all_points.sparkSession.createDataFrame([], schema) if out is None else out


def nearest_by(all_points: DataFrame, queries: DataFrame, k: int, metric) -> DataFrame:
    """nearest for any metric: a name (euclidean, cityblock, chebyshev, cosine) or a function from
    two arrays of points to the matrix of their distances."""

    def best(qid: np.ndarray, pid: np.ndarray, d: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((np.broadcast_to(pid, d.shape), np.round(d, 9)), axis=1)[:, :k]
        flat = pd.DataFrame({"query": np.repeat(qid, order.shape[1]), "id": pid[order].ravel(), "d": np.take_along_axis(d, order, 1).ravel()})
        return flat[np.isfinite(flat["d"])]

    part = _met(all_points, queries, best, "query long, id long, d double", metric)
    top = part.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.round("d", 9).alias("d"), "id"))), 1, k).alias("_t"))
    return top.select("query", F.posexplode("_t").alias("_p", "_x")).select("query", F.col("_x.id").alias("id"), F.col("_x.d").alias("distance"), (F.col("_p") + 1).alias("rank"))


def within(all_points: DataFrame, queries: DataFrame, radius: float, metric="euclidean") -> DataFrame:
    """(query, id, distance): all other points within the radius of each query point."""

    def near(qid: np.ndarray, pid: np.ndarray, d: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(d <= radius)
        return pd.DataFrame({"query": qid[i], "id": pid[j], "distance": d[i, j]})

    return _met(all_points, queries, near, "query long, id long, distance double", metric)


def counts_within(all_points: DataFrame, queries: DataFrame, radii: list[float], metric="euclidean") -> DataFrame:
    """(query, radius, n): number of other points within each radius; only counts leave a partition."""

    def count(qid: np.ndarray, pid: np.ndarray, d: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"query": np.tile(qid, len(radii)), "radius": np.repeat(radii, len(qid)), "n": np.concatenate([(d <= r).sum(axis=1) for r in radii])})

    return _met(all_points, queries, count, "query long, radius double, n long", metric).groupBy("query", "radius").agg(F.sum("n").alias("n"))


def correlation_dimension(all_points: DataFrame, queries: DataFrame, low: float, high: float) -> DataFrame:
    """(near, far, dimension): pairs within two radii, and the slope of the logarithm of their number."""
    n = counts_within(all_points, queries, [low, high]).groupBy("radius").agg(F.sum("n").alias("n"))
    both = n.agg(F.max(F.when(F.col("radius") == low, F.col("n"))).alias("near"), F.max(F.when(F.col("radius") == high, F.col("n"))).alias("far"))
    return both.select("near", "far", F.when(F.col("near") > 0, F.ln(F.col("far") / F.col("near")) / float(np.log(high / low))).alias("dimension"))


def stress(high: DataFrame, low: DataFrame, queries: DataFrame) -> DataFrame:
    """(n, stress): root of the squared differences of distances in the two spaces over the squared
    distances in the first, over the pairs of queries (column id) and all points."""
    both = high.select("id", F.col("features").alias("_h")).join(low.select("id", F.col("features").alias("_l")), "id").select("id", F.concat("_h", "_l").alias("features"), F.size("_h").alias("_d"))
    first = both.select("_d").first()
    d = first["_d"] if first is not None else 0
    f = _distance("euclidean")

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Both distances of a pair in one complex number."""
        return f(a[:, :d], b[:, :d]) + 1j * f(a[:, d:], b[:, d:])

    out = None
    for ids, vectors in _blocks(both.join(queries.select("id"), "id", "left_semi").select("id", "features")):
        held = both.sparkSession.sparkContext.broadcast((ids, vectors))

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            qid, q = held.value
            for pdf in batches:
                z = pair(q, np.array(pdf["features"].tolist(), float).reshape(len(pdf), -1))
                z[qid[:, None] == pdf["id"].to_numpy()[None, :]] = 0
                yield pd.DataFrame({"n": [int((qid[:, None] != pdf["id"].to_numpy()[None, :]).sum())], "off": [float(((z.real - z.imag) ** 2).sum())], "all": [float((z.real**2).sum())]})

        part = both.select("id", "features").mapInPandas(scan, "n long, off double, all double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return both.sparkSession.createDataFrame([], "n long, stress double")
    return out.agg(F.sum("n").alias("n"), F.sqrt(F.try_divide(F.sum("off"), F.sum("all"))).alias("stress"))


def symmetrised(knn: DataFrame, how: str = "intersection") -> DataFrame:
    """(a, b, distance): edges a < b that both ends have (intersection) or either has (union)."""
    e = knn.groupBy(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b")).agg(F.count("*").alias("_n"), F.min("distance").alias("distance"))
    return (e.filter("_n >= 2") if how == "intersection" else e).drop("_n")


def preservation(high: DataFrame, low: DataFrame) -> DataFrame:
    """Share of the neighbours in one space that are neighbours in the other, over all queries."""
    both = high.select("query", "id").join(low.select("query", "id"), ["query", "id"]).agg(F.count("*").alias("_b"))
    return high.agg(F.count("*").alias("_n")).crossJoin(both).select(F.try_divide(F.col("_b"), F.col("_n")).alias("preservation"))


def moments(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of points, their sum and their matrix of products, added up over partitions; the
    number of features is checked."""
    first = df.select(F.size("features").alias("d")).first()
    if first is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    if first.d > MATRIX_FEATURES:
        raise ValueError(f"more than {MATRIX_FEATURES} features")
    d = first.d

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, np.zeros(d), np.zeros((d, d))
        for pdf in batches:
            x = np.array(pdf["features"].tolist(), float).reshape(-1, d)
            n, s, g = n + len(x), s + x.sum(axis=0), g + x.T @ x
        yield pd.DataFrame({"i": np.arange(d + 1), "row": [np.append(s, n).tolist(), *[np.append(r, 0).tolist() for r in g]]})

    rows = df.select("features").mapInPandas(part, T.StructType([T.StructField("i", T.LongType()), T.StructField("row", T.ArrayType(T.DoubleType()))]))
    added = rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((d + 1, d + 1))
    for r in added:
        m[r.i, r.j] = r.v
    return int(m[0, d]), m[0, :d], m[1:, :d]


def covariance(df: DataFrame) -> np.ndarray:
    n, s, g = moments(df)
    return (g - np.outer(s, s) / n) / (n - 1) if n > 1 else np.zeros_like(g)


def effective_dimension(df: DataFrame, q: float = 2.0) -> DataFrame:
    """Renyi-q participation of the eigenvalues of the correlation matrix: exp of their entropy."""
    c = covariance(df)
    sd = np.sqrt(np.diag(c))
    live = sd > 0
    lam = np.linalg.eigvalsh(c[np.ix_(live, live)] / np.outer(sd[live], sd[live])) if live.any() else np.zeros(0)
    p = np.clip(lam, 0, None)
    p = p / p.sum() if p.sum() > 0 else p
    p = p[p > 0]
    if not len(p):
        value = 0.0
    elif q == 1:
        value = float(np.exp(-(p * np.log(p)).sum()))
    else:
        value = float((p**q).sum() ** (1 / (1 - q)))
    return df.sparkSession.createDataFrame([(value,)], "dimension double")


def pca(df: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Coordinates (id, features) on the k leading axes, and (rank, variance, share). An axis points
    to where its largest component is positive."""
    n, s, _ = moments(df)
    c = covariance(df)
    lam, vec = np.linalg.eigh(c)
    order = np.argsort(lam)[::-1][:k]
    axes = vec[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    mean = s / max(n, 1)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["features"].tolist(), float).reshape(len(pdf), -1)
            yield pd.DataFrame({"id": pdf["id"], "features": ((x - mean) @ axes).tolist()})

    spec = df.sparkSession.createDataFrame([(r + 1, float(lam[j]), float(lam[j] / lam.sum())) for r, j in enumerate(order)], "rank int, variance double, share double")
    return df.mapInPandas(project, "id long, features array<double>"), spec


def two_nn_dimension(knn: DataFrame) -> DataFrame:
    """Intrinsic dimension from the ratio of the second to the first neighbour's distance: number of
    points over the sum of log ratios."""
    r = knn.filter("rank <= 2").groupBy("query").agg(F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("b"), F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("a"))
    ok = r.filter((F.col("a") > 0) & (F.col("b") > 0))
    return ok.agg(F.count("*").alias("n"), F.try_divide(F.count("*"), F.sum(F.ln(F.col("b") / F.col("a")))).alias("dimension"))


def patterns(df: DataFrame, label: str, vector: str, how: str = "mean") -> DataFrame:
    """(label, i, v): mean or median of each feature per label."""
    value = {"mean": F.avg, "median": lambda c: F.percentile(c, 0.5)}[how]("x")
    return df.select(F.col(label).alias("label"), F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).groupBy("label", "i").agg(value.alias("v"))


#: Dissimilarities of two patterns x and y, as aggregates over their features.
DISSIMILARITIES = {
    "correlation": lambda x, y: 1 - F.corr(x, y),
    "euclidean": lambda x, y: F.sqrt(F.sum((x - y) * (x - y))),
    "manhattan": lambda x, y: F.sum(F.abs(x - y)),
    "cosine": lambda x, y: 1 - F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))),
}


def rdm(pattern: DataFrame, metric: str = "correlation") -> DataFrame:
    """(label_a, label_b, dissimilarity) of the labels' patterns, a < b."""
    a, b = pattern.select(F.col("label").alias("label_a"), "i", F.col("v").alias("x")), pattern.select(F.col("label").alias("label_b"), "i", F.col("v").alias("y"))
    j = a.join(b, "i").filter("label_a < label_b")
    return j.groupBy("label_a", "label_b").agg(DISSIMILARITIES[metric](F.col("x"), F.col("y")).alias("dissimilarity"))


def compare_rdms(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pearson, Spearman (mean ranks for ties) and cosine of two RDMs over the label pairs of both,
    each pair with the labels of its own matrix. Ranks come from the distributed order."""
    j = a.select("label_a", "label_b", F.col("dissimilarity").alias("x")).join(b.select("label_a", "label_b", F.col("dissimilarity").alias("y")), ["label_a", "label_b"])

    def mean_rank(df: DataFrame, c: str) -> DataFrame:
        placed = global_rank(df, [], [c, "label_a", "label_b"], "_p")
        mid = placed.groupBy(c).agg(F.avg("_p").alias(f"_r{c}"))
        return placed.drop("_p").join(mid, c)

    r = mean_rank(mean_rank(j, "x"), "y")
    return r.agg(
        F.corr("x", "y").alias("pearson"), F.corr("_rx", "_ry").alias("spearman"), F.try_divide(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y")))).alias("cosine")
    )


def eps_graph(all_points: DataFrame, eps: float, metric="euclidean", least: int = 0) -> DataFrame:
    """(a, b, distance): edges a < b between points at most eps apart; of points with fewer than least
    neighbours none. Every point is a query in some block; a cloud's edges are its result."""
    e = within(all_points, all_points, eps, metric).filter("query < id").select(F.col("query").alias("a"), F.col("id").alias("b"), "distance")
    if not least:
        return e
    enough = e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("id")
    return e.join(enough.withColumnRenamed("id", "a"), "a", "left_semi").join(enough.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b", "distance")


def procrustes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, disparity): of the points of both clouds (id, features), what is left of their squared
    distances, each cloud centred and of size 1, after the best turn, reflection and scale. Only the
    matrix of their products, as large as the features, leaves the cluster."""
    both = a.select("id", F.col("features").alias("_a")).join(b.select("id", F.col("features").alias("_b")), "id").select("id", F.concat("_a", "_b").alias("features"), F.size("_a").alias("_d"))
    first = both.select("_d").first()
    spark = a.sparkSession
    if first is None:
        return spark.createDataFrame([], "n long, disparity double")
    n, s, g = moments(both.select("id", "features"))
    c, d = g - np.outer(s, s) / n, first["_d"]
    size = np.trace(c[:d, :d]) * np.trace(c[d:, d:])
    value = 1 - np.linalg.svd(c[:d, d:], compute_uv=False).sum() ** 2 / size if size > 0 else None
    return spark.createDataFrame([(n, None if value is None else float(value))], "n long, disparity double")


def reconstruction_score(df: DataFrame, truth: str, decoded: str, decoding: float, circular: bool = True) -> DataFrame:
    """(error, correlation, score): mean error (angular, of pi, or absolute, of 1), correlation of the
    two (of their sines and cosines, averaged, for angles), and 0.4 (1 - error) + 0.3 correlation +
    0.3 decoding, where decoding is an accuracy measured elsewhere."""
    t, d = F.col(truth), F.col(decoded)
    if circular:
        miss = F.abs(F.pmod(d - t + np.pi, F.lit(2 * np.pi)) - np.pi)
        r = (F.corr(F.cos(t), F.cos(d)) + F.corr(F.sin(t), F.sin(d))) / 2
        scale = float(np.pi)
    else:
        miss, r, scale = F.abs(d - t), F.corr(t, d), 1.0
    m = df.filter(t.isNotNull() & d.isNotNull()).agg((F.avg(miss) / scale).alias("error"), r.alias("correlation"))
    return m.withColumn("score", 0.4 * F.greatest(F.lit(0.0), 1 - F.col("error")) + 0.3 * F.greatest(F.lit(0.0), F.col("correlation")) + 0.3 * decoding)
