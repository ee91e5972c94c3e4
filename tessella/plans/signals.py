"""Queries of signals, recurrence and space, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import recurrence as Q
from tessella.operators import signal as G
from tessella.operators import wavelet as W
from tessella.plans.series import HOURLY, hourly
from tessella.session import cut, read


def _rows(spark, d):
    return hourly(spark, d).select(F.col("series").alias("key"), F.col("t").cast("long").alias("t"), "value")


def _units(spark, d):
    return cut(G.clean(read(spark, d, "signals"), "unit_id", "t", "calcium"))


def _out(df, *names, nd=6):
    df = df.withColumnRenamed("key", "series") if "key" in df.columns else df
    return df.select(*[F.round(c, nd).alias(c) if c in names else F.col(c) for c in df.columns])


def events_threshold(spark, d):
    return G.threshold_events(_units(spark, d)).withColumnRenamed("key", "unit_id")


def event_amplitude(spark, d):
    s = _units(spark, d)
    return _out(G.event_amplitudes(s, G.threshold_events(s)), "amplitude").withColumnRenamed("series", "unit_id")


def events_ridges(spark, d):
    return _out(W.events(_units(spark, d)), "scale", "height").withColumnRenamed("series", "unit_id")


def minmax_scaled(spark, d):
    return _out(G.minmax(_rows(spark, d)), "value")


def robust_scales(spark, d):
    return _out(G.robust_scale(_units(spark, d)), "median", "mad").withColumnRenamed("series", "unit_id")


def smoothed_gaussian(spark, d):
    return _out(G.gaussian_smooth(_rows(spark, d), 2.0), "value", nd=5)


def moving_median(spark, d):
    return _out(G.moving_median(_rows(spark, d), 3), "value")


def smoothed_savitzky_golay(spark, d):
    return _out(G.savitzky_golay(_rows(spark, d), 7, 2), "value")


def first_difference(spark, d):
    return _out(G.differences(_rows(spark, d)), "value")


def rolled_series(spark, d):
    return _out(G.rolled(_rows(spark, d), F.lit(17)))


def shuffled_blocks(spark, d):
    return _out(G.shuffled_blocks(_rows(spark, d), 100))


def kernel_response(spark, d):
    ev = read(spark, d, "events").select("event_id", (F.col("value") % 10).alias("lag"))
    return ev.select("event_id", F.round(G.double_exponential(F.col("lag"), 0.25, 2.0), 6).alias("response"))


def takens_embedding(spark, d):
    return _out(Q.takens(_rows(spark, d), 3, 2).select("key", "t", *[F.col("point")[k].alias(f"x{k}") for k in range(3)]))


def ordinal_pattern_counts(spark, d):
    return Q.ordinal_patterns(_rows(spark, d), 3, 1).groupBy(F.col("key").alias("series"), "pattern").agg(F.count("*").alias("n"))


def permutation_entropy(spark, d):
    return _out(Q.permutation_entropy(Q.ordinal_patterns(_rows(spark, d), 3, 1), 3), "entropy")


def opn_transitions(spark, d):
    return _out(Q.pattern_transitions(Q.ordinal_patterns(_rows(spark, d), 3, 1)), "p")


def hvg_edges(spark, d):
    return _out(Q.visibility(_rows(spark, d)))


def nvg_edges(spark, d):
    return _out(Q.visibility(_rows(spark, d), "natural"))


def _counts(spark, d):
    return hourly(spark, d).select(F.col("series").alias("key"), F.col("t").cast("long").alias("t"), F.col("n").cast("double").alias("value"))


def recurrence_edges(spark, d):
    return Q.recurrences(_counts(spark, d), 0.5, 2).groupBy(F.col("key").alias("series")).agg(F.count("*").alias("edges"), F.sum(F.col("j") - F.col("i")).alias("distance"))


def rqa_lines(spark, d):
    return _out(Q.line_measures(Q.recurrences(_counts(spark, d), 0.5, 1)), "det", "l_mean", "divergence", "entropy", "laminarity", "trapping")


def population_joint_graph(spark, d):
    return Q.joint_graph(Q.visibility(_rows(spark, d)), 0.8)


def graph_jaccard(spark, d):
    return _out(Q.edge_jaccard(Q.visibility(_rows(spark, d))), "jaccard")


def _positions(spark, d):
    e = read(spark, d, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])


def _map(spark, d):
    return G.occupancy(_positions(spark, d).withColumn("v", F.abs("z")), "x", "y", 8, -0.4, 0.4, "v")


def occupancy_map(spark, d):
    return _out(_map(spark, d), "rate")


def spatial_information(spark, d):
    return _out(G.spatial_information(_map(spark, d)), "information")


def place_field_bins(spark, d):
    return _out(G.place_fields(_map(spark, d), 1.1), "rate")


_NAMES = [
    events_threshold, event_amplitude, events_ridges, minmax_scaled, robust_scales, smoothed_gaussian, moving_median, smoothed_savitzky_golay, first_difference, rolled_series, shuffled_blocks, kernel_response,
    takens_embedding, ordinal_pattern_counts, permutation_entropy, opn_transitions, hvg_edges, nvg_edges, recurrence_edges, rqa_lines, population_joint_graph, graph_jaccard, occupancy_map,
    spatial_information, place_field_bins,
]


def queries():
    return {f.__name__: f for f in _NAMES}


_UNITS = "units AS (SELECT unit_id, t, max(calcium) AS v FROM signals WHERE calcium IS NOT NULL AND NOT isnan(calcium) AND NOT isinf(calcium) GROUP BY ALL)"
_EVENTS = f"""{_UNITS},
rob AS (SELECT unit_id, median(v) AS m, mad(v) AS s FROM units GROUP BY unit_id),
high AS (SELECT unit_id, t, t - row_number() OVER (PARTITION BY unit_id ORDER BY t) AS g FROM (SELECT unit_id, t, v AS x FROM units) JOIN rob USING (unit_id) WHERE x > m + 4 * 1.4826 * s),
isl AS (SELECT unit_id, min(t) AS a, max(t) + 1 AS b FROM high GROUP BY unit_id, g HAVING count(*) >= 3),
gaps AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY unit_id ORDER BY a) <= 2 THEN 0 ELSE 1 END AS o FROM isl),
ids AS (SELECT *, sum(o) OVER (PARTITION BY unit_id ORDER BY a) AS id FROM gaps),
ev AS (SELECT unit_id, min(a) AS "start", max(b) AS "end" FROM ids GROUP BY unit_id, id)"""

_PATTERNS = f"""{HOURLY}, emb AS (SELECT series, t, value AS a, lead(value, 1) OVER w AS b, lead(value, 2) OVER w AS c FROM hourly WINDOW w AS (PARTITION BY series ORDER BY t)),
pat AS (SELECT series, t, array_to_string(list_transform(list_sort([struct_pack(v := a, i := 0), struct_pack(v := b, i := 1), struct_pack(v := c, i := 2)]), lambda s: CAST(s.i AS VARCHAR)), '') AS pattern FROM emb WHERE c IS NOT NULL)"""

_HVG = f"""{HOURLY}, pts AS (SELECT series, t, value AS v FROM hourly),
edges AS (SELECT x.series, x.t AS a, y.t AS b FROM pts x JOIN pts y ON x.series = y.series AND x.t < y.t
  WHERE NOT EXISTS (SELECT 1 FROM pts z WHERE z.series = x.series AND z.t > x.t AND z.t < y.t AND (CASE WHEN x.v < y.v THEN z.v > x.v ELSE z.v >= y.v END)))"""

_REC = f"""{HOURLY}, rec AS (SELECT x.series, x.t AS i, y.t AS j FROM hourly x JOIN hourly y ON x.series = y.series AND abs(x.n - y.n) <= 0.5 AND y.t - x.t >= {{theiler}})"""

_MAP = """pos AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, abs(CAST(embedding[3] AS DOUBLE)) AS v FROM embeddings),
map AS (SELECT CAST(least(floor((x + 0.4) / 0.8 * 8), 7) AS INT) AS bin_x, CAST(least(floor((y + 0.4) / 0.8 * 8), 7) AS INT) AS bin_y, count(*) AS n, avg(v) AS rate FROM pos WHERE x BETWEEN -0.4 AND 0.4 AND y BETWEEN -0.4 AND 0.4 GROUP BY ALL),
mean AS (SELECT sum(n) AS total, sum(n * rate) / sum(n) AS m FROM map)"""


def oracle_sql():
    import math

    peak = 0.25 * 2.0 / 1.75 * math.log(8.0)
    top = math.exp(-peak / 2.0) - math.exp(-peak / 0.25)
    w = [math.exp(-0.5 * (k / 2.0) ** 2) for k in range(-8, 9)]
    w = [x / sum(w) for x in w]
    length = "(SELECT max(t) + 1 FROM hourly)"
    return {
        "events_threshold": f'WITH {_EVENTS} SELECT unit_id, "start", "end" FROM ev',
        "event_amplitude": f'WITH {_EVENTS}, amp AS (SELECT e.unit_id, e."start", e."end", max(v) FILTER (WHERE t >= e."start") AS p, median(v) FILTER (WHERE t < e."start") AS f0 FROM ev e JOIN units u ON u.unit_id = e.unit_id AND t >= e."start" - 20 AND t < e."end" GROUP BY ALL) SELECT unit_id, "start", "end", round(CASE WHEN f0 > 0 THEN greatest(0, (p - f0) / f0) ELSE 0 END, 6) AS amplitude FROM amp',
        "minmax_scaled": f"WITH {HOURLY} SELECT series, t, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS value FROM hourly WINDOW w AS (PARTITION BY series)",
        "robust_scales": f"WITH {_UNITS} SELECT unit_id, round(median(v), 6) AS median, round(mad(v), 6) AS mad FROM units GROUP BY unit_id",
        "smoothed_gaussian": f"WITH {HOURLY}, k AS (SELECT unnest({list(range(-8, 9))}) AS o, unnest({w}) AS w), p AS (SELECT h.series, h.t, w, CASE WHEN h.t + o < 0 THEN -(h.t + o) - 1 WHEN h.t + o >= {length} THEN 2 * {length} - 1 - (h.t + o) ELSE h.t + o END AS s FROM hourly h, k) SELECT p.series, p.t, round(sum(w * value), 5) AS value FROM p JOIN hourly h ON h.series = p.series AND h.t = p.s GROUP BY p.series, p.t",
        "moving_median": f"WITH {HOURLY} SELECT series, t, round(median(value) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS value FROM hourly",
        "first_difference": f"WITH {HOURLY}, x AS (SELECT series, t, value - lag(value) OVER (PARTITION BY series ORDER BY t) AS v FROM hourly) SELECT series, t, round(v, 6) AS value FROM x WHERE v IS NOT NULL",
        "rolled_series": f"WITH {HOURLY} SELECT series, (t + 17) % {length} AS t, value FROM hourly",
        "shuffled_blocks": f"WITH {HOURLY}, w AS (SELECT *, {length} // 100 AS w FROM hourly) SELECT series, CASE WHEN t // w < 100 THEN ((t // w) * 7 + 3) % 100 * w + t % w ELSE t END AS t, value FROM w",
        "kernel_response": f"SELECT event_id, round(CASE WHEN value % 10 < 0 THEN 0 ELSE (exp(-(value % 10) / 2.0) - exp(-(value % 10) / 0.25)) / {top!r} END, 6) AS response FROM events",
        "takens_embedding": f"WITH {HOURLY}, e AS (SELECT series, t, value AS x0, lead(value, 2) OVER w AS x1, lead(value, 4) OVER w AS x2 FROM hourly WINDOW w AS (PARTITION BY series ORDER BY t)) SELECT * FROM e WHERE x2 IS NOT NULL",
        "ordinal_pattern_counts": f"WITH {_PATTERNS} SELECT series, pattern, count(*) AS n FROM pat GROUP BY ALL",
        "permutation_entropy": f"WITH {_PATTERNS}, p AS (SELECT series, count(*) / sum(count(*)) OVER (PARTITION BY series) AS p FROM pat GROUP BY series, pattern) SELECT series, round(-sum(p * log2(p)) / log2(6.0), 6) AS entropy FROM p GROUP BY series",
        "opn_transitions": f"WITH {_PATTERNS}, m AS (SELECT series, pattern AS src, lead(pattern) OVER (PARTITION BY series ORDER BY t) AS dst FROM pat), c AS (SELECT series, src, dst, count(*) AS n FROM m WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL) SELECT series, src, dst, round(n / sum(n) OVER (PARTITION BY series, src), 6) AS p FROM c",
        "hvg_edges": f"WITH {_HVG} SELECT * FROM edges",
        "nvg_edges": f"WITH {HOURLY}, pts AS (SELECT series, t, value AS v FROM hourly), s AS (SELECT x.series, x.t AS a, y.t AS b, (y.v - x.v) / (y.t - x.t) AS slope FROM pts x JOIN pts y ON x.series = y.series AND x.t < y.t), r AS (SELECT *, max(slope) OVER (PARTITION BY series, a ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM s) SELECT series, a, b FROM r WHERE best IS NULL OR slope > best",
        "recurrence_edges": f"WITH {_REC.format(theiler=2)} SELECT series, count(*) AS edges, CAST(sum(j - i) AS BIGINT) AS distance FROM rec GROUP BY series",
        "rqa_lines": f"WITH {_REC.format(theiler=1)}, g AS (SELECT series, j - i AS d, i - row_number() OVER (PARTITION BY series, j - i ORDER BY i) AS g FROM rec), l AS (SELECT series, count(*) AS len FROM g GROUP BY series, d, g), p AS (SELECT series, count(*) AS points FROM rec GROUP BY series), k AS (SELECT series, len, count(*) AS k, count(*) / sum(count(*)) OVER (PARTITION BY series) AS q FROM l WHERE len >= 2 GROUP BY series, len), vg AS (SELECT series, i, j - row_number() OVER (PARTITION BY series, i ORDER BY j) AS g FROM (SELECT series, i, j FROM rec UNION ALL SELECT series, j, i FROM rec)), v AS (SELECT series, count(*) AS len FROM vg GROUP BY series, i, g), lam AS (SELECT series, sum(len) FILTER (WHERE len >= 2) AS onv, sum(len) AS allv, count(*) FILTER (WHERE len >= 2) AS nv FROM v GROUP BY series) SELECT k.series, points, round(sum(k * len) / points, 6) AS det, round(sum(k * len) / sum(k), 6) AS l_mean, max(len) AS l_max, round(1.0 / max(len), 6) AS divergence, round(-sum(q * ln(q)), 6) AS entropy, round(any_value(onv / allv), 6) AS laminarity, round(any_value(onv / nv), 6) AS trapping FROM k JOIN p USING (series) JOIN lam USING (series) GROUP BY k.series, points",
        "population_joint_graph": f"WITH {_HVG} SELECT a, b, count(DISTINCT series) AS n FROM edges GROUP BY a, b HAVING count(DISTINCT series) >= 0.8 * (SELECT count(DISTINCT series) FROM edges)",
        "graph_jaccard": f"WITH {_HVG}, z AS (SELECT series, count(*) AS n FROM edges GROUP BY series), c AS (SELECT x.series AS key_a, y.series AS key_b, count(*) AS c FROM edges x JOIN edges y ON x.a = y.a AND x.b = y.b AND x.series < y.series GROUP BY ALL) SELECT key_a, key_b, round(c / (p.n + q.n - c), 6) AS jaccard FROM c JOIN z p ON p.series = key_a JOIN z q ON q.series = key_b",
        "occupancy_map": f"WITH {_MAP} SELECT bin_x, bin_y, n, round(rate, 6) AS rate FROM map",
        "spatial_information": f"WITH {_MAP} SELECT round(greatest(0, sum(n / total * rate / m * log2(rate / m))), 6) AS information FROM map, mean WHERE rate > 0",
        "place_field_bins": f"WITH {_MAP} SELECT bin_x, bin_y, n, round(rate, 6) AS rate FROM map, mean WHERE rate > 1.1 * m",
    }
