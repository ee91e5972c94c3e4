"""Queries of graphs and point clouds, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import graph as N
from tessella.operators import manifold as M
from tessella.session import read


def trade(spark, d):
    """Customer nation to supplier nation, weighted by the number of order lines."""
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    s = read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").cast("double").alias("w"))


def _strong(spark, d):
    """Edges heavier than the mean, as the graph of all nations is complete."""
    t = trade(spark, d)
    return t.crossJoin(F.broadcast(t.agg(F.avg("w").alias("_m")))).filter("w > 1.15 * _m").drop("_m")


def _r(df, *names, nd=6):
    return df.select(*[F.round(c, nd).alias(c) if c in names else F.col(c) for c in df.columns])


def trade_degrees(spark, d):
    return N.degrees(_strong(spark, d))


def trade_symmetry(spark, d):
    return _r(N.symmetry_index(_strong(spark, d)), "symmetry")


def symmetric_edges(spark, d):
    return N.symmetric_part(N.without_loops(_strong(spark, d))).select("src", "dst", "w")


def asymmetric_edges(spark, d):
    return N.asymmetric_part(N.without_loops(_strong(spark, d))).select("src", "dst", "w")


def heavy(spark, d):
    """Edges of trade far above the mean."""
    t = trade(spark, d)
    return t.crossJoin(F.broadcast(t.agg(F.avg("w").alias("_m")))).filter("w > 1.6 * _m").drop("_m")


def trade_components(spark, d):
    return N.components(heavy(spark, d))


def trade_laplacian(spark, d):
    return N.laplacian(trade(spark, d))


def trade_transition(spark, d):
    return _r(N.transition(trade(spark, d)), "p")


def trade_clustering(spark, d):
    return _r(N.clustering(_strong(spark, d)), "coefficient")


def trade_hops(spark, d):
    s = _strong(spark, d)
    return N.hops(s, s.select(F.col("src").alias("id")).distinct())


def trade_spectrum(spark, d):
    return _r(N.spectrum(trade(spark, d)), "eigenvalue")


def trade_spectral_entropy(spark, d):
    return _r(N.spectral_entropy(trade(spark, d), [0.1, 1.0, 10.0]), "entropy", "free_entropy")


def trade_small_world(spark, d):
    return _r(N.small_world(_strong(spark, d)), "clustering", "length", "index")


def trade_hyperbolicity(spark, d):
    return _r(N.hyperbolicity(_strong(spark, d), 20_000), "mean")


def _cloud(spark, d):
    p = M.points(read(spark, d, "embeddings"), "vec_id", "embedding")
    return p, p.filter("id % 20 = 0")


def knn_search(spark, d):
    p, q = _cloud(spark, d)
    return _r(M.nearest(p, q, 10), "distance")


def knn_preservation(spark, d):
    p, q = _cloud(spark, d)
    low = lambda x: x.select("id", F.slice("features", 1, 8).alias("features"))
    return _r(M.preservation(M.nearest(p, q, 10), M.nearest(low(p), low(q), 10)), "preservation")


def nn_dimension(spark, d):
    p, q = _cloud(spark, d)
    return _r(M.two_nn_dimension(M.nearest(p, q, 2)), "dimension", nd=4)


def effective_dimension(spark, d):
    return _r(M.effective_dimension(_cloud(spark, d)[0]), "dimension", nd=4)


def pca_variances(spark, d):
    return _r(M.pca(_cloud(spark, d)[0], 5)[1], "variance", "share")


def rdm(spark, d):
    return _r(M.rdm(M.patterns(read(spark, d, "embeddings"), "label", "embedding")), "dissimilarity")


def rdm_comparison(spark, d):
    e = read(spark, d, "embeddings")
    half = lambda a: M.rdm(M.patterns(e.select("label", F.slice("embedding", a, 32).alias("v")), "label", "v"))
    return _r(M.compare_rdms(half(1), half(33)), "pearson", "spearman", "cosine")


_NAMES = [
    trade_degrees, trade_symmetry, symmetric_edges, asymmetric_edges, trade_components, trade_laplacian, trade_transition, trade_clustering, trade_hops, trade_spectrum, trade_spectral_entropy, trade_hyperbolicity, trade_small_world,
    knn_search, knn_preservation, nn_dimension, effective_dimension, pca_variances, rdm, rdm_comparison,
]


def queries():
    return {f.__name__: f for f in _NAMES}


_TRADE = "trade AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"
_STRONG = f"{_TRADE}, strong AS (SELECT * FROM trade WHERE w > 1.15 * (SELECT avg(w) FROM trade)), e AS (SELECT * FROM strong WHERE src <> dst), u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM e GROUP BY ALL), n AS (SELECT a AS x, b AS y FROM u UNION ALL SELECT b, a FROM u)"
HEAVY = f"{_TRADE}, h AS (SELECT * FROM trade WHERE w > 1.6 * (SELECT avg(w) FROM trade))"
_P = "p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings WHERE embedding IS NOT NULL)"
_NEAR = "(SELECT a.id AS query, b.id AS id, list_distance({x}, {y}) AS distance, CAST(row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance({x}, {y}) ** 2, 12), b.id) AS INT) AS rank FROM p a JOIN p b ON a.id % 20 = 0 AND a.id <> b.id QUALIFY rank <= {k})"
_PAT = "x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), pat AS (SELECT label, i, avg(x) AS v FROM x GROUP BY ALL)"
_RDM = "SELECT a.label AS label_a, b.label AS label_b, 1 - corr(a.v, b.v) AS dissimilarity FROM pat a JOIN pat b ON a.i = b.i AND a.label < b.label{x} GROUP BY ALL"


def oracle_sql():
    near = lambda k, x="a.f", y="b.f": _NEAR.format(x=x, y=y, k=k)
    return {
        "trade_degrees": f"WITH {_STRONG}, i AS (SELECT src AS id, dst AS o, 1 AS a, 0 AS b, w FROM strong UNION ALL SELECT dst, src, 0, 1, 0 FROM strong) SELECT id, CAST(sum(a) AS BIGINT) AS out_degree, CAST(sum(b) AS BIGINT) AS in_degree, count(DISTINCT o) AS degree, sum(w) AS strength FROM i GROUP BY id",
        "trade_symmetry": f"WITH {_STRONG} SELECT round(avg(CASE WHEN (dst, src) IN (SELECT (src, dst) FROM e) THEN 1.0 ELSE 0.0 END), 6) AS symmetry FROM e",
        "symmetric_edges": f"WITH {_STRONG} SELECT * FROM e WHERE (dst, src) IN (SELECT (src, dst) FROM e)",
        "asymmetric_edges": f"WITH {_STRONG} SELECT * FROM e WHERE (dst, src) NOT IN (SELECT (src, dst) FROM e)",
        "trade_components": f"WITH RECURSIVE {_TRADE}, h AS (SELECT * FROM trade WHERE w > 1.6 * (SELECT avg(w) FROM trade)), n AS (SELECT src AS x, dst AS y FROM h UNION SELECT dst, src FROM h), r AS (SELECT x, x AS y FROM n UNION SELECT r.x, n.y FROM r JOIN n ON r.y = n.x) SELECT x AS id, min(y) AS component FROM r GROUP BY x",
        "trade_laplacian": f"WITH {_TRADE}, d AS (SELECT dst AS i, sum(w) AS s FROM trade GROUP BY dst), l AS (SELECT src AS i, dst AS j, -w AS v FROM trade UNION ALL SELECT i, i, s FROM d) SELECT i, j, sum(v) AS value FROM l GROUP BY i, j",
        "trade_transition": f"WITH {_TRADE}, d AS (SELECT dst AS i, sum(w) AS s FROM trade GROUP BY dst) SELECT src AS i, dst AS j, round(w / s, 6) AS p FROM trade JOIN d ON i = src",
        "trade_clustering": f"WITH {_STRONG}, k AS (SELECT x AS id, count(*) AS k FROM n GROUP BY x), t AS (SELECT p.x AS id, count(*) // 2 AS t FROM n p JOIN n q ON p.y = q.x JOIN n r ON q.y = r.x AND r.y = p.x GROUP BY p.x) SELECT k.id, coalesce(t, 0) AS triangles, round(CASE WHEN k > 1 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END, 6) AS coefficient FROM k LEFT JOIN t ON t.id = k.id",
        "trade_hops": f"WITH RECURSIVE {_STRONG}, r AS (SELECT DISTINCT src AS source, src AS id, 0 AS hops FROM strong UNION SELECT r.source, n.y, r.hops + 1 FROM r JOIN n ON r.id = n.x WHERE r.hops < 8) SELECT source, id, min(hops) AS hops FROM r GROUP BY source, id",
        "trade_hyperbolicity": f"WITH RECURSIVE {_STRONG}, w AS (SELECT src AS id FROM strong UNION SELECT dst FROM strong), k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM w), r AS (SELECT id AS source, id, 0 AS hops FROM w UNION SELECT r.source, n.y, r.hops + 1 FROM r JOIN n ON r.id = n.x WHERE r.hops < 8), h AS (SELECT a.k AS i, b.k AS j, min(hops) AS d FROM r JOIN k a ON a.id = r.source JOIN k b ON b.id = r.id GROUP BY ALL), q AS (SELECT " + ", ".join(f"(x * {a} + ((x * x) % 1000003) * {b} + 7) % (SELECT count(*) FROM w) AS {c}" for c, (a, b) in zip("pqrs", ((7919, 104729), (15485863, 611953), (32452843, 49979), (86028121, 15487)))) + " FROM (SELECT unnest(range(20000)) AS x)), s AS (SELECT list_sort([a.d + b.d, c.d + e.d, f.d + g.d]) AS l FROM q JOIN h a ON a.i = p AND a.j = q JOIN h b ON b.i = r AND b.j = s JOIN h c ON c.i = p AND c.j = r JOIN h e ON e.i = q AND e.j = s JOIN h f ON f.i = p AND f.j = s JOIN h g ON g.i = q AND g.j = r WHERE p <> q AND p <> r AND p <> s AND q <> r AND q <> s AND r <> s) SELECT count(*) AS quadruples, round(avg((l[3] - l[2]) / 2), 6) AS mean FROM s",
        "knn_search": f"WITH {_P} SELECT query, id, round(distance, 6) AS distance, rank FROM {near(10)}",
        "knn_preservation": f"WITH {_P}, h AS {near(10)}, l AS {near(10, 'a.f[1:8]', 'b.f[1:8]')} SELECT round((SELECT count(*) FROM h JOIN l USING (query, id)) / (SELECT count(*) FROM h), 6) AS preservation",
        "nn_dimension": f"WITH {_P}, k AS {near(2)}, r AS (SELECT query, max(distance) FILTER (WHERE rank = 2) AS b, max(distance) FILTER (WHERE rank = 1) AS a FROM k GROUP BY query) SELECT count(*) AS n, round(count(*) / sum(ln(b / a)), 4) AS dimension FROM r WHERE a > 0",
        "effective_dimension": "WITH x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT a.i AS i, b.i AS j, corr(a.x, b.x) AS r FROM x a JOIN x b USING (vec_id) GROUP BY a.i, b.i) SELECT round(power((SELECT count(DISTINCT i) FROM x), 2) / sum(r * r), 4) AS dimension FROM c",
        "rdm": f"WITH {_PAT}, r AS ({_RDM.format(x='')}) SELECT label_a, label_b, round(dissimilarity, 6) AS dissimilarity FROM r",
        "rdm_comparison": f"WITH {_PAT}, a AS ({_RDM.format(x=' AND a.i <= 32')}), b AS ({_RDM.format(x=' AND a.i > 32')}), j AS (SELECT a.dissimilarity AS x, b.dissimilarity AS y FROM a JOIN b USING (label_a, label_b)), k AS (SELECT x, y, rank() OVER (ORDER BY x) AS rx, rank() OVER (ORDER BY y) AS ry FROM j) SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) AS cosine FROM k",
    }
