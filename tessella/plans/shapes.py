"""Queries of shapes in signals and maps, of neighbours by any metric and of dissimilarities, and
their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tessella.functions.special import digamma_sql
from tessella.operators import conditional as C
from tessella.operators import embedding as E
from tessella.operators import information as I
from tessella.operators import kinetics as K
from tessella.operators import manifold as M
from tessella.operators import pairing as P
from tessella.operators import shapes as H
from tessella.operators import signal as G
from tessella.plans import models, selective, signals
from tessella.plans.geometry import _P, _PAT
from tessella.plans.series import HOURLY, hourly
from tessella.session import read

_r = models._r


def _events(spark, d):
    return G.threshold_events(signals._units(spark, d))


def masked_frames(spark, d):
    m = H.event_mask(_events(spark, d), 6, 15)
    return m.groupBy(F.col("key").alias("unit_id")).agg(F.count("*").alias("frames"), F.sum("t").alias("places"))


def _marks(spark, d):
    """Hours of a series with an above-average sum, with that sum."""
    h = hourly(spark, d).select(F.col("series").alias("key"), F.col("t").cast("long").alias("t"), "value")
    mean = h.groupBy("key").agg(F.avg("value").alias("_m"))
    return h.join(mean, "key").filter("value > _m").select("key", "t", "value")


def shuffled_intervals(spark, d):
    return H.shuffled_intervals(_marks(spark, d), 720).withColumnRenamed("key", "series")


def analytic_signal(spark, d):
    return _r(H.phases(signals._rows(spark, d)), "amplitude", "phase", nd=5).withColumnRenamed("key", "series")


def events_iterative(spark, d):
    return H.iterative_events(signals._rows(spark, d), passes=2, n_mad=2.0, least=2, merge=1, length=40).withColumnRenamed("key", "series")


def rate_map_smoothed(spark, d):
    return _r(H.smoothed_rates(signals._map(spark, d), 1.0, 2), "rate")


def place_fields(spark, d):
    return _r(H.connected_fields(signals._map(spark, d), 1.1, 2, 0.05), "peak", "centre_x", "centre_y")


def cross_correlations(spark, d):
    """Hourly sums of each series against hourly numbers of each."""
    h = hourly(spark, d)
    return _r(I.cross_correlations(h.select("series", "t", "value"), h.select("series", "t", F.col("n").cast("double").alias("value")), "series", "t", "value"), "r")


def multivariate(spark, d):
    """Total and dual total correlation and O-information of the scores of the first four series."""
    s = selective._scores(spark, d)
    names = [r.series for r in s.select("series").distinct().orderBy("series").limit(4).collect()]  # names of columns
    wide = s.groupBy("t").agg(*[F.max(F.when(F.col("series") == x, F.col("z"))).alias(f"x{k}") for k, x in enumerate(names)])
    return _r(C.correlations_of_many(wide, [f"x{k}" for k in range(len(names))]), "tc", "dtc", "o_information")


def radius_neighbours(spark, d):
    p, q = models._cloud(spark, d)
    return _r(M.within(p, q, 1.3), "distance")


def radius_counts(spark, d):
    p, q = models._cloud(spark, d)
    return M.counts_within(p, q, [1.2, 1.4])


def knn_cityblock(spark, d):
    p, q = models._cloud(spark, d)
    return _r(M.nearest_by(p, q, 5, "cityblock"), "distance")


def knn_callable(spark, d):
    """Neighbours by a distance that is given as a function: the greatest difference of the first eight components."""
    p, q = models._cloud(spark, d)
    return _r(M.nearest_by(p, q, 5, lambda a, b: np.abs(a[:, None, :8] - b[None, :, :8]).max(axis=2)), "distance")


def knn_graph(spark, d):
    """Edges between query points and their ten nearest points that either end has."""
    p, q = models._cloud(spark, d)
    return _r(M.symmetrised(M.nearest(p, q, 10), "union"), "distance")


def correlation_dimension(spark, d):
    p, q = models._cloud(spark, d)
    return _r(M.correlation_dimension(p, q, 1.2, 1.4), "dimension", nd=5)


def stress(spark, d):
    p, q = models._cloud(spark, d)
    return _r(M.stress(p, models._low(p), q), "stress")


def eps_graph(spark, d):
    p, _ = models._cloud(spark, d)
    return _r(M.eps_graph(p, 1.1), "distance")


def procrustes(spark, d):
    """The cloud's first two components against its next two."""
    p, _ = models._cloud(spark, d)
    part = lambda a: p.select("id", F.slice("features", a, 2).alias("features"))
    return _r(M.procrustes(part(1), part(3)), "disparity")


def reconstruction(spark, d):
    ev = read(spark, d, "events").select((F.hour(F.col("ts").cast("timestamp")) * (2 * math.pi / 24)).alias("a"), (F.pmod("event_id", F.lit(24)) * (2 * math.pi / 24)).alias("b"))
    return _r(M.reconstruction_score(ev, "a", "b", 0.5), "error", "correlation", "score")


def alignment_held_out(spark, d):
    """Hours of the day against numbers of events: the best turn for most rows, and its error on the others."""
    ev = read(spark, d, "events").select((F.hour(F.col("ts").cast("timestamp")) * (2 * math.pi / 24)).alias("a"), (F.pmod("event_id", F.lit(24)) * (2 * math.pi / 24)).alias("b"), (F.col("event_id") % 5 == 0).alias("held"))
    return _r(E.alignment_quality(ev, "a", "b", "held"), "offset", "train_error", "test_error")


def neighbour_entropies(spark, d):
    return models._arrays(spark, d).select("series", F.round(K.neighbour_entropy("values", F.lit(5)), 6).alias("entropy"))


def reconstructed_steps(spark, d):
    """Signals through a given function: the part of each step that goes up."""
    up = lambda t, v: np.maximum(np.diff(v, prepend=v[0]), 0)
    return _r(K.reconstructed(signals._rows(spark, d), up), "value").withColumnRenamed("key", "series")


def frames_joined(spark, d):
    s = selective._scores(spark, d)
    return _r(P.on_frames(selective._units(s), selective._continuous(s)), "r")


def event_minutes(spark, d):
    """Frames at 20 a second as minutes, and the time of day at which each ends."""
    e = _events(spark, d).select(F.col("key").alias("unit_id"), "start", "end")
    return e.select("unit_id", "start", F.round(F.col("start") / (20 * 60), 6).alias("minute"), F.date_format(F.timestamp_seconds(F.floor(F.col("end") / 20)), "HH:mm:ss").alias("at"))


def _rdm(metric, how="mean"):
    def run(spark, d):
        return _r(M.rdm(M.patterns(read(spark, d, "embeddings"), "label", "embedding", how), metric), "dissimilarity")

    return run


rdm_euclidean, rdm_manhattan, rdm_cosine, rdm_of_medians = _rdm("euclidean"), _rdm("manhattan"), _rdm("cosine"), _rdm("correlation", "median")

_NAMES = [
    masked_frames, shuffled_intervals, analytic_signal, events_iterative, rate_map_smoothed, place_fields, cross_correlations, multivariate, radius_neighbours, radius_counts, knn_cityblock,
    knn_callable, knn_graph, correlation_dimension, stress, eps_graph, procrustes, reconstruction, alignment_held_out, neighbour_entropies, reconstructed_steps, frames_joined, event_minutes,
]


def queries():
    more = {"rdm_euclidean": rdm_euclidean, "rdm_manhattan": rdm_manhattan, "rdm_cosine": rdm_cosine, "rdm_of_medians": rdm_of_medians}
    return {f.__name__: f for f in _NAMES} | more


def _islands_sql(name: str, source: str, bar: str, least: int, merge: int) -> str:
    """Events of a source (series, t, x) above a bar, as a chain of expressions ending in `name`."""
    return f"""{name}_h AS (SELECT s.series, t, t - row_number() OVER (PARTITION BY s.series ORDER BY t) AS g FROM {source} s JOIN rob USING (series) WHERE x > {bar}),
{name}_i AS (SELECT series, min(t) AS a, max(t) + 1 AS b FROM {name}_h GROUP BY series, g HAVING count(*) >= {least}),
{name}_o AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY series ORDER BY a) <= {merge} THEN 0 ELSE 1 END AS o FROM {name}_i),
{name}_d AS (SELECT *, sum(o) OVER (PARTITION BY series ORDER BY a) AS id FROM {name}_o),
{name}_e AS (SELECT series, min(a) AS "start", max(b) AS "end" FROM {name}_d GROUP BY series, id),
{name} AS (SELECT * FROM {name}_e QUALIFY count(*) OVER (PARTITION BY series) >= 2)"""


def _hat(window: int, degree: int) -> np.ndarray:
    """Weights by which a window's values give the fitted polynomial's values at its places."""
    x = np.vander(np.arange(window) - window // 2, degree + 1, increasing=True)
    return x @ np.linalg.pinv(x)


def oracle_sql():
    near = "SELECT a.id AS query, b.id AS id, {dist} AS distance FROM p a JOIN p b ON a.id % 20 = 0 AND a.id <> b.id"
    e2 = near.format(dist="list_distance(a.f, b.f)")
    block = "list_sum(list_transform(list_zip(a.f, b.f), lambda z: abs(z[1] - z[2])))"
    top8 = "list_max(list_transform(list_zip(a.f[1:8], b.f[1:8]), lambda z: abs(z[1] - z[2])))"

    def ranked(dist: str, k: int) -> str:
        return f"WITH {_P}, n AS ({near.format(dist=dist)}), o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), id) AS rank FROM n) SELECT query, id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM o WHERE rank <= {k}"

    def dissimilar(expr: str, pat: str = _PAT) -> str:
        return f"WITH {pat}, r AS (SELECT a.label AS label_a, b.label AS label_b, {expr} AS dissimilarity FROM pat a JOIN pat b ON a.i = b.i AND a.label < b.label GROUP BY ALL) SELECT label_a, label_b, round(dissimilarity, 6) AS dissimilarity FROM r"

    marks = f"{HOURLY}, mk AS (SELECT series, t, value FROM hourly QUALIFY value > avg(value) OVER (PARTITION BY series))"
    mixed = lambda c, a: f"(({c} * {a} + {c} * {c} * 104729 + 7) % 1000003)"
    w = H.unit_kernel(40, 20.0, 0.25, 2.0)
    kernel = "k AS (SELECT unnest(range(0, 40)) AS k, unnest([" + ", ".join(repr(v) for v in w) + "]) AS w)"
    hat = _hat(7, 2)
    rows = ", ".join(f"({p}, {j}, {float(hat[p, j])!r})" for p in range(7) for j in range(7))
    smooth = f"{HOURLY}, w AS (SELECT * FROM (VALUES {rows}) v(p, j, c)), n AS (SELECT series, t, value, max(t) OVER (PARTITION BY series) AS last FROM hourly), c AS (SELECT series, t, CASE WHEN t < 3 THEN 0 WHEN t > last - 3 THEN last - 6 ELSE t - 3 END AS f FROM n)"
    phi = lambda m: f"SELECT series, avg(ln(c)) AS p FROM (SELECT a.series, a.t, count(*) / any_value(a.cnt) AS c FROM e a JOIN e b ON a.series = b.series AND {' AND '.join(f'abs(a.x{k} - b.x{k}) <= a.r' for k in range(m))} WHERE a.x{m - 1} IS NOT NULL AND b.x{m - 1} IS NOT NULL GROUP BY a.series, a.t) GROUP BY series"
    dist = lambda m: "sqrt(" + " + ".join(f"power(a.x{k} - b.x{k}, 2)" for k in range(m)) + ")"
    fnn = lambda m: f"f{m} AS (SELECT a.series, a.t, {dist(m)} AS d, abs(a.x{m} - b.x{m}) AS g, a.sd FROM e a JOIN e b ON a.series = b.series AND a.t <> b.t WHERE a.x{m} IS NOT NULL AND b.x{m} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a.series, a.t ORDER BY {dist(m)}, b.t) = 1)"
    share = lambda m: f"SELECT series AS key, {m} AS dim, round(avg(CASE WHEN sqrt(d * d + g * g) > 2 * sd OR (d > 1e-10 AND g / d > 10) THEN 1.0 ELSE 0.0 END), 6) AS share FROM f{m} GROUP BY series"
    four = ["a", "b", "c", "d"]
    det = lambda of: selective._det_sql(list(of), lambda x, y: f"covar_samp({x}, {y})" if x != y else f"var_samp({x})")
    h = lambda of: f"(0.5 * log2({det(of)}))"
    rest = [[x for x in four if x != y] for y in four]
    tc = " + ".join(h([x]) for x in four) + f" - {h(four)}"
    dtc = f"{h(four)} - (" + " + ".join(f"({h(four)} - {h(r)})" for r in rest) + ")"
    return {
        "masked_frames": f"WITH {signals._EVENTS}, m AS (SELECT unit_id, CASE WHEN \"end\" - \"start\" >= 6 THEN \"start\" ELSE greatest(0, (\"start\" + \"end\") // 2 - 3) END AS a, CASE WHEN \"end\" - \"start\" > 15 THEN \"start\" + 15 WHEN \"end\" - \"start\" >= 6 THEN \"end\" ELSE (\"start\" + \"end\") // 2 + 3 END AS b FROM ev), f AS (SELECT DISTINCT unit_id, unnest(range(a, b)) AS t FROM m) SELECT unit_id, count(*) AS frames, CAST(sum(t) AS BIGINT) AS places FROM f GROUP BY unit_id",
        "shuffled_intervals": f"WITH {marks}, p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS i, t - lag(t) OVER (PARTITION BY series ORDER BY t) AS gap FROM mk), g AS (SELECT series, gap, {mixed('i', 7919)} AS h, i FROM p WHERE gap IS NOT NULL UNION ALL SELECT DISTINCT series, 7 % 720, -1, 0 FROM mk), m AS (SELECT series, sum(gap) OVER w AS t, row_number() OVER w - 1 AS k FROM g WINDOW w AS (PARTITION BY series ORDER BY h, i ROWS UNBOUNDED PRECEDING)), v AS (SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY {mixed('i', 15485863)}, i) - 1 AS k FROM p) SELECT series, CAST(t AS BIGINT) AS t, value FROM m JOIN v USING (series, k) WHERE t < 720",
        "analytic_signal": f"WITH {HOURLY}, len AS (SELECT count(DISTINCT t) AS len FROM hourly), z AS (SELECT a.series, a.t, any_value(a.value) AS x, sum(CASE WHEN (a.t - b.t) % 2 <> 0 THEN b.value * 2.0 / len / tan(pi() * (a.t - b.t) / len) ELSE 0 END) AS y FROM hourly a JOIN hourly b ON a.series = b.series, len GROUP BY a.series, a.t) SELECT series, t, round(sqrt(x * x + y * y), 5) AS amplitude, round(atan2(y, x), 5) AS phase FROM z",
        "events_iterative": f"WITH {HOURLY}, {kernel}, src AS (SELECT series, t, value AS x FROM hourly), rob AS (SELECT series, median(x) AS m, mad(x) AS s FROM src GROUP BY series), {_islands_sql('one', 'src', 'm + 2 * 1.4826 * s', 2, 1)}, pk AS (SELECT e.series, e.\"start\", max(x) - any_value(m) AS a FROM one e JOIN src ON src.series = e.series AND t >= e.\"start\" AND t < e.\"end\" JOIN rob ON rob.series = e.series GROUP BY e.series, e.\"start\"), sub AS (SELECT series, \"start\" + k AS t, sum(a * w) AS s FROM pk, k GROUP BY ALL), rst AS (SELECT src.series, src.t, x - coalesce(s, 0) AS x FROM src LEFT JOIN sub ON sub.series = src.series AND sub.t = src.t), {_islands_sql('two', 'rst', 'm + 2 * 1.4826 * s', 2, 1)} SELECT *, 1 AS pass FROM one UNION ALL SELECT *, 2 FROM two",
        "rate_map_smoothed": f"WITH {signals._MAP}, s AS (SELECT * FROM map WHERE n >= 2) SELECT a.bin_x, a.bin_y, any_value(a.n) AS n, round(sum(b.rate * exp(-(power(a.bin_x - b.bin_x, 2) + power(a.bin_y - b.bin_y, 2)) / 2)) / sum(exp(-(power(a.bin_x - b.bin_x, 2) + power(a.bin_y - b.bin_y, 2)) / 2)), 6) AS rate FROM s a JOIN s b ON abs(a.bin_x - b.bin_x) <= 3 AND abs(a.bin_y - b.bin_y) <= 3 GROUP BY a.bin_x, a.bin_y",
        "place_fields": f"WITH RECURSIVE {signals._MAP}, h AS (SELECT CAST(bin_x AS BIGINT) * 1000000 + bin_y AS id, bin_x, bin_y, rate FROM map, mean WHERE rate > 1.1 * m), r AS (SELECT id, id AS o FROM h UNION SELECT r.id, b.id FROM r JOIN h a ON a.id = r.o JOIN h b ON abs(a.bin_x - b.bin_x) + abs(a.bin_y - b.bin_y) = 1), c AS (SELECT id, min(o) AS field FROM r GROUP BY id) SELECT field, count(*) AS bins, round(max(rate), 6) AS peak, round(sum(rate * bin_x) / sum(rate), 6) AS centre_x, round(sum(rate * bin_y) / sum(rate), 6) AS centre_y FROM c JOIN h USING (id) GROUP BY field HAVING count(*) >= 2 AND max(rate) >= 0.05",
        "cross_correlations": f"WITH {HOURLY} SELECT a.series AS key_a, b.series AS key_b, round(corr(a.value, CAST(b.n AS DOUBLE)), 6) AS r FROM hourly a JOIN hourly b ON a.t = b.t GROUP BY ALL",
        "multivariate": f"WITH {selective.SCORES}, k AS (SELECT series, row_number() OVER (ORDER BY series) AS k FROM (SELECT DISTINCT series FROM scores)), x AS (SELECT t, max(z) FILTER (WHERE k = 1) AS a, max(z) FILTER (WHERE k = 2) AS b, max(z) FILTER (WHERE k = 3) AS c, max(z) FILTER (WHERE k = 4) AS d FROM scores JOIN k USING (series) GROUP BY t), m AS (SELECT count(*) AS n, {tc} AS tc, {dtc} AS dtc FROM x) SELECT n, round(tc, 6) AS tc, round(dtc, 6) AS dtc, round(tc - dtc, 6) AS o_information FROM m",
        "radius_neighbours": f"WITH {_P}, n AS ({e2}) SELECT query, id, round(distance, 6) AS distance FROM n WHERE distance <= 1.3",
        "radius_counts": f"WITH {_P}, n AS ({e2}), r AS (SELECT unnest([1.2, 1.4]::DOUBLE[]) AS radius) SELECT query, radius, count(*) FILTER (WHERE distance <= radius) AS n FROM n, r GROUP BY ALL",
        "knn_cityblock": ranked(block, 5),
        "knn_callable": ranked(top8, 5),
        "knn_graph": f"WITH {_P}, n AS ({e2}), o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance ** 2, 12), id) AS k FROM n) SELECT least(query, id) AS a, greatest(query, id) AS b, round(min(distance), 6) AS distance FROM o WHERE k <= 10 GROUP BY ALL",
        "correlation_dimension": f"WITH {_P}, n AS ({e2}), c AS (SELECT count(*) FILTER (WHERE distance <= 1.2) AS near, count(*) FILTER (WHERE distance <= 1.4) AS far FROM n) SELECT near, far, round(ln(far / near) / ln(1.4 / 1.2), 5) AS dimension FROM c",
        "stress": f"WITH {_P}, n AS (SELECT list_distance(a.f, b.f) AS h, list_distance(a.f[1:8], b.f[1:8]) AS l FROM p a JOIN p b ON a.id % 20 = 0 AND a.id <> b.id) SELECT count(*) AS n, round(sqrt(sum(power(h - l, 2)) / sum(h * h)), 6) AS stress FROM n",
        "eps_graph": f"WITH {_P} SELECT a.id AS a, b.id AS b, round(list_distance(a.f, b.f), 6) AS distance FROM p a JOIN p b ON a.id < b.id WHERE list_distance(a.f, b.f) <= 1.1",
        "procrustes": f"WITH {_P}, x AS (SELECT f[1] AS a, f[2] AS b, f[3] AS c, f[4] AS d FROM p), m AS (SELECT count(*) AS n, covar_pop(a, c) AS ac, covar_pop(a, d) AS ad, covar_pop(b, c) AS bc, covar_pop(b, d) AS bd, (var_pop(a) + var_pop(b)) * (var_pop(c) + var_pop(d)) AS z FROM x) SELECT n, round(1 - (ac * ac + ad * ad + bc * bc + bd * bd + 2 * abs(ac * bd - ad * bc)) / z, 6) AS disparity FROM m",
        "reconstruction": f"WITH e AS (SELECT hour(ts) * {2 * math.pi / 24!r} AS a, (event_id % 24) * {2 * math.pi / 24!r} AS b FROM events WHERE ts IS NOT NULL), m AS (SELECT avg(acos(least(1, greatest(-1, cos(a - b))))) / pi() AS error, (corr(cos(a), cos(b)) + corr(sin(a), sin(b))) / 2 AS r FROM e) SELECT round(error, 6) AS error, round(r, 6) AS correlation, round(0.4 * greatest(0, 1 - error) + 0.3 * greatest(0, r) + 0.3 * 0.5, 6) AS score FROM m",
        "neighbour_entropies": f"WITH {HOURLY}, v AS (SELECT series, t, value + 1e-10 * ((t * 0.6180339887) % 1) * stddev_pop(value) OVER (PARTITION BY series) AS x, count(*) OVER (PARTITION BY series) AS n FROM hourly), d AS (SELECT a.series, a.t, any_value(a.n) AS n, list(abs(a.x - b.x) ORDER BY abs(a.x - b.x))[5] AS eps FROM v a JOIN v b ON a.series = b.series AND a.t <> b.t GROUP BY a.series, a.t) SELECT series, round(({digamma_sql('any_value(n) * 1.0')} - {digamma_sql('5.0')} + avg(ln(2 * eps))) / ln(2.0), 6) AS entropy FROM d GROUP BY series",
        "reconstructed_steps": f"WITH {HOURLY} SELECT series, CAST(t AS BIGINT) AS t, round(greatest(0, value - coalesce(lag(value) OVER (PARTITION BY series ORDER BY t), value)), 6) AS value FROM hourly",
        "frames_joined": f"WITH {selective._BASE} SELECT a.series AS unit, b.feature, round(corr(a.z, b.z), 6) AS r FROM scores a JOIN fc b ON a.t = b.t GROUP BY ALL",
        "event_minutes": f"WITH {signals._EVENTS} SELECT unit_id, \"start\", round(\"start\" / (20 * 60), 6) AS minute, strftime(make_timestamp(CAST((\"end\" // 20) * 1000000 AS BIGINT)), '%H:%M:%S') AS \"at\" FROM ev",
        "rdm_euclidean": dissimilar("sqrt(sum(power(a.v - b.v, 2)))"),
        "rdm_manhattan": dissimilar("sum(abs(a.v - b.v))"),
        "rdm_cosine": dissimilar("1 - sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v)))"),
        "rdm_of_medians": dissimilar("1 - corr(a.v, b.v)", _PAT.replace("avg(x) AS v", "median(x) AS v")),
        # of queries that stand in other modules
        "smoothed_savitzky_golay": f"WITH {smooth} SELECT c.series, c.t, round(sum(h.value * w.c), 6) AS value FROM c JOIN hourly h ON h.series = c.series AND h.t BETWEEN c.f AND c.f + 6 JOIN w ON w.p = c.t - c.f AND w.j = h.t - c.f GROUP BY c.series, c.t",
        "approximate_entropies": f"WITH {HOURLY}, e AS (SELECT series, t, value AS x0, lead(value, 1) OVER w AS x1, lead(value, 2) OVER w AS x2, 0.2 * stddev_pop(value) OVER (PARTITION BY series) AS r, count(*) OVER (PARTITION BY series) AS n FROM hourly WINDOW w AS (PARTITION BY series ORDER BY t)), a AS ({phi(2).replace('any_value(a.cnt)', '(any_value(a.n) - 1)')}), b AS ({phi(3).replace('any_value(a.cnt)', '(any_value(a.n) - 2)')}) SELECT series, round(a.p - b.p, 6) AS apen FROM a JOIN b USING (series)",
        "mi_ksg": f"WITH {HOURLY}, s AS (SELECT series, t, value, stddev_pop(value) OVER (PARTITION BY series) AS sd, count(*) OVER (PARTITION BY series) AS n FROM hourly), v AS (SELECT series, t, n, value + 1e-10 * ((t * 0.6180339887) % 1) * sd AS x, value + 1e-10 * ((t * 0.7548776662) % 1) * sd AS y FROM s), p AS (SELECT a.series AS key_a, b.series AS key_b, a.t, a.n, a.x, b.y FROM v a JOIN v b ON a.t = b.t AND a.series < b.series), d AS (SELECT i.key_a, i.key_b, i.t, any_value(i.n) AS n, list(greatest(abs(i.x - j.x), abs(i.y - j.y)) ORDER BY greatest(abs(i.x - j.x), abs(i.y - j.y)))[5] AS eps FROM p i JOIN p j ON i.key_a = j.key_a AND i.key_b = j.key_b AND i.t <> j.t GROUP BY ALL), c AS (SELECT d.key_a, d.key_b, d.t, any_value(d.n) AS n, count(*) FILTER (WHERE abs(i.x - j.x) < eps) - 1 AS nx, count(*) FILTER (WHERE abs(i.y - j.y) < eps) - 1 AS ny FROM d JOIN p i ON i.key_a = d.key_a AND i.key_b = d.key_b AND i.t = d.t JOIN p j ON j.key_a = d.key_a AND j.key_b = d.key_b GROUP BY ALL) SELECT key_a, key_b, round(greatest(0, ({digamma_sql('5.0')} + {digamma_sql('any_value(n) * 1.0')} - avg({digamma_sql('nx + 1.0')} + {digamma_sql('ny + 1.0')})) / ln(2.0)), 6) AS mi FROM c GROUP BY key_a, key_b",
        "false_neighbours": f"WITH {HOURLY}, e AS (SELECT series, t, value AS x0, lead(value, 1) OVER w AS x1, lead(value, 2) OVER w AS x2, lead(value, 3) OVER w AS x3, stddev_pop(value) OVER (PARTITION BY series) AS sd FROM hourly WINDOW w AS (PARTITION BY series ORDER BY t)), {fnn(1)}, {fnn(2)}, {fnn(3)} {share(1)} UNION ALL {share(2)} UNION ALL {share(3)}",
        "aligned_angles": f"WITH e AS (SELECT hour(ts) * {2 * math.pi / 24!r} AS a, (event_id % 24) * {2 * math.pi / 24!r} AS b FROM events WHERE ts IS NOT NULL), k AS (SELECT a, b, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT id, (id % 360) * {2 * math.pi / 360!r} AS \"offset\", id >= 360 AS reflected FROM (SELECT unnest(range(720)) AS id)), m AS (SELECT id, \"offset\", reflected, n, (CASE WHEN reflected THEN -b ELSE b END) + \"offset\" - a + pi() AS x FROM g, k), z AS (SELECT id, any_value(\"offset\") AS \"offset\", any_value(reflected) AS reflected, round(sum(n * abs((x - floor(x / (2 * pi())) * 2 * pi()) - pi())) / sum(n), 9) AS error FROM m GROUP BY id) SELECT round(\"offset\", 6) AS \"offset\", reflected, round(error, 6) AS error FROM z ORDER BY z.error, id LIMIT 1",
        "alignment_held_out": f"WITH e AS (SELECT hour(ts) * {2 * math.pi / 24!r} AS a, (event_id % 24) * {2 * math.pi / 24!r} AS b, event_id % 5 = 0 AS held FROM events WHERE ts IS NOT NULL), k AS (SELECT a, b, count(*) FILTER (WHERE NOT held) AS n, count(*) FILTER (WHERE held) AS m FROM e GROUP BY ALL), g AS (SELECT id, (id % 360) * {2 * math.pi / 360!r} AS \"offset\", id >= 360 AS reflected FROM (SELECT unnest(range(720)) AS id)), m AS (SELECT id, \"offset\", reflected, n, k.m, (CASE WHEN reflected THEN -b ELSE b END) + \"offset\" - a + pi() AS x FROM g, k), z AS (SELECT id, any_value(\"offset\") AS \"offset\", any_value(reflected) AS reflected, round(sum(n * abs((x - floor(x / (2 * pi())) * 2 * pi()) - pi())) / sum(n), 9) AS error, sum(m.m * abs((x - floor(x / (2 * pi())) * 2 * pi()) - pi())) / sum(m.m) AS test FROM m GROUP BY id) SELECT round(\"offset\", 6) AS \"offset\", reflected, round(error, 6) AS train_error, round(test, 6) AS test_error FROM z ORDER BY z.error, id LIMIT 1",
    }
