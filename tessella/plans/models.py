"""Queries of types, circular features, reduction, trials and shapes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import circular as C
from tessella.operators import embedding as E
from tessella.operators import kinetics as K
from tessella.operators import manifold as M
from tessella.operators import selectivity as S
from tessella.operators import signal as G
from tessella.operators import typing as Y
from tessella.operators.ordering import global_rank
from tessella.plans import signals
from tessella.plans.series import HOURLY, hourly
from tessella.session import cut, read


def _r(df, *names, nd=6):
    return df.select(*[F.round(c, nd).alias(c) if c in names else F.col(c) for c in df.columns])


def _readings(spark, d):
    f = read(spark, d, "features").filter("feat_value is not null and not isnan(feat_value)")
    return f.groupBy(F.col("series_id").alias("key"), "t").agg(F.max("feat_value").alias("value"), F.max("feature").alias("name"))


def type_features(spark, d):
    return _r(Y.type_features(_readings(spark, d)), "mean", "std", "skewness", "kurtosis", "integers", nd=7).withColumnRenamed("key", "series_id")


def series_types(spark, d):
    return Y.infer_types(_readings(spark, d)).withColumnRenamed("key", "series_id")


def circular_mean_hour(spark, d):
    ev = read(spark, d, "events").select("event_type", (F.hour(F.col("ts").cast("timestamp")) * (C.TAU / 24)).alias("a"))
    return _r(ev.groupBy("event_type").agg(C.mean(F.col("a")).alias("direction"), C.resultant(F.col("a")).alias("length")), "direction", "length", nd=5)


def circular_steps(spark, d):
    ev = read(spark, d, "events").select("event_id", (F.col("value") % 24).alias("a"))
    nxt = ev.select((F.col("event_id") - 1).alias("event_id"), F.col("a").alias("b"))
    return ev.join(nxt, "event_id").select("event_id", F.round(C.difference(F.col("b"), F.col("a"), 24.0), 6).alias("step"))


def feature_substitution(spark, d):
    twins = {"headdirection": "headdirection_2d", "bodydirection": "bodydirection_2d"}
    pairs = spark.createDataFrame(list(twins.items()), "feature string, twin string")
    f = read(spark, d, "selectivity").select("session", "feature").distinct()
    return f.join(F.broadcast(pairs), "feature", "left").select("session", F.coalesce("twin", "feature").alias("feature")).distinct()


def bad_frames_removed(spark, d):
    s = read(spark, d, "signals").filter("unit_id is not null").select("unit_id", "t").distinct()
    bad = s.filter("t % 97 < 3").select("t").distinct()
    kept = global_rank(s.join(bad, "t", "left_anti").select("unit_id", "t"), ["unit_id"], ["t"], "frame")
    return kept.groupBy("unit_id").agg(F.count("*").alias("frames"), F.sum(F.col("t") - F.col("frame")).alias("moved"))


def session_parts(spark, d):
    s = read(spark, d, "signals").filter("unit_id is not null").select("unit_id", "t").distinct()
    width, overlap = 300, 60
    part = F.floor(F.col("t") / width)
    # a part begins `overlap` frames before its place, so the end of one is in the next as well
    both = s.withColumn("part", F.explode(F.when(F.pmod("t", F.lit(width)) >= width - overlap, F.array(part, part + 1)).otherwise(F.array(part))))
    return both.groupBy("unit_id", "part").agg(F.count("*").alias("frames"), F.min("t").alias("first"), F.max("t").alias("last"))


def rdm_trials(spark, d):
    """Days are trials, weekdays their labels; the pattern is the mean of each series in a trial."""
    h = hourly(spark, d)
    trials = h.select(F.floor(F.col("t") / 24).alias("trial")).distinct().withColumn("start", F.col("trial") * 24).withColumn("label", F.col("trial") % 7)
    frames = trials.select("trial", "label", F.explode(F.sequence(F.col("start") + 8, F.col("start") + 19)).alias("t"))
    per = frames.join(h, "t").groupBy("trial", "label", "series").agg(F.avg("value").alias("v"))
    return _r(M.rdm(per.groupBy("label", F.col("series").alias("i")).agg(F.avg("v").alias("v"))), "dissimilarity")


def interpolated_frames(spark, d):
    import numpy as np

    s = cut(G.clean(read(spark, d, "signals"), "unit_id", "t", "calcium"))
    ends = s.groupBy("key").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    spine = ends.select("key", F.explode(F.sequence("a", "b")).alias("t")).join(s, ["key", "t"], "left").withColumn("value", F.coalesce("value", F.lit(float("nan"))))
    filled = G.with_margin(spine, lambda t, v: np.interp(t, t[~np.isnan(v)], v[~np.isnan(v)]), 64)
    missing = spine.filter(F.isnan("value")).select("key", "t")
    return _r(filled.join(missing, ["key", "t"], "left_semi"), "value", nd=5).withColumnRenamed("key", "unit_id")


def decay_constants(spark, d):
    s = cut(G.clean(read(spark, d, "signals"), "unit_id", "t", "calcium"))
    return _r(K.decay_constants(s, G.threshold_events(s), 20.0), "tau", "r2").withColumnRenamed("key", "unit_id")


def _arrays(spark, d):
    return S.as_arrays(hourly(spark, d), "series", "t", "value")


def mi_ksg(spark, d):
    a = _arrays(spark, d)
    x, y = a.select(F.col("series").alias("key_a"), F.col("values").alias("x")), a.select(F.col("series").alias("key_b"), F.col("values").alias("y"))
    return x.join(y, F.col("key_a") < F.col("key_b")).select("key_a", "key_b", F.round(K.ksg_information("x", "y"), 6).alias("mi"))


def approximate_entropies(spark, d):
    return _arrays(spark, d).select("series", F.round(K.approximate_entropy("values", F.lit(2), F.lit(0.2)), 6).alias("apen"))


def _cloud(spark, d):
    p = M.points(read(spark, d, "embeddings"), "vec_id", "embedding")
    return p, p.filter("id % 20 = 0")


def _embedded(spark, d, method):
    p, _ = _cloud(spark, d)
    return E.embed(p, E.landmarks_of(p), method, 2).select("id", F.round(F.col("features")[0], 6).alias("x"), F.round(F.col("features")[1], 6).alias("y"))


def embedding_mds(spark, d):
    return _embedded(spark, d, "mds")


def embedding_isomap(spark, d):
    return _embedded(spark, d, "isomap")


def embedding_le(spark, d):
    return _embedded(spark, d, "le")


def embedding_dmaps(spark, d):
    return _embedded(spark, d, "dmaps")


def embedding_lle(spark, d):
    return _embedded(spark, d, "lle")


def label_decoder(spark, d):
    e = read(spark, d, "embeddings")
    p = M.points(e, "vec_id", "embedding").join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    return _r(E.linear_decoder(p, "label"), "r2", "mean_error", nd=4)


def aligned_angles(spark, d):
    ev = read(spark, d, "events").select((F.hour(F.col("ts").cast("timestamp")) * (C.TAU / 24)).alias("a"), (F.pmod("event_id", F.lit(24)) * (C.TAU / 24)).alias("b"))
    return E.circular_alignment(ev, "a", "b").select(F.round("offset", 6).alias("offset"), "reflected", F.round("error", 6).alias("error"))


def _low(x):
    return x.select("id", F.slice("features", 1, 8).alias("features"))


def trustworthiness(spark, d):
    p, q = _cloud(spark, d)
    return _r(E.trustworthiness(p, M.nearest(_low(p), _low(q), 10), 10), "score")


def continuity(spark, d):
    p, q = _cloud(spark, d)
    return _r(E.trustworthiness(_low(p), M.nearest(p, q, 10), 10), "score")


_NAMES = [
    type_features, series_types, circular_mean_hour, circular_steps, feature_substitution, bad_frames_removed, session_parts, rdm_trials, interpolated_frames, decay_constants, mi_ksg,
    approximate_entropies, embedding_mds, embedding_isomap, embedding_le, embedding_dmaps, embedding_lle, label_decoder, aligned_angles, trustworthiness, continuity,
]


def queries():
    return {f.__name__: f for f in _NAMES}


def _types_sql(read_: str) -> str:
    """Every piece of evidence by its definition over each series, then the same rules."""
    near = " OR ".join(f"(abs(lo - {a!r}) < {0.1 * (b - a)!r} AND abs(hi - {b!r}) < {0.1 * (b - a)!r})" for a, b in Y.CIRCULAR_RANGES)
    steps = []
    for k, (column, sql) in enumerate(Y.rule_columns()):
        steps.append(f"s{k} AS (SELECT *, {sql} AS {column} FROM {f's{k - 1}' if k else 'evidence'})")
    return f"""WITH {read_}, names AS (SELECT series_id, max(feature) AS name FROM features WHERE feat_value IS NOT NULL AND NOT isnan(feat_value) GROUP BY series_id),
m AS (SELECT series_id, count(*) AS n, count(DISTINCT v) AS n_unique, avg(v) AS mean, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi, avg(CASE WHEN abs(v - round(v)) < 1e-10 THEN 1.0 ELSE 0.0 END) AS integers FROM r GROUP BY series_id),
g AS (SELECT series_id, avg(power((v - mean) / sd, 3)) AS skewness, avg(power((v - mean) / sd, 4)) - 3 AS kurtosis FROM r JOIN m USING (series_id) WHERE sd > 0 GROUP BY series_id),
o AS (SELECT r.*, m.* EXCLUDE (series_id), row_number() OVER (PARTITION BY r.series_id ORDER BY v, t) AS k, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) END AS u, lead(v) OVER (PARTITION BY r.series_id ORDER BY t, v) AS nxt FROM r JOIN m USING (series_id)),
ks AS (SELECT series_id, greatest(max(k / n - u), max(u - (k - 1) / n)) AS d, sum(CASE WHEN nxt < v THEN 1 ELSE 0 END) AS falls, sum(CASE WHEN abs(nxt - v) > 0.8 * (hi - lo) AND (v > mean) <> (nxt > mean) THEN 1 ELSE 0 END) AS jumps,
  power(avg(cos(2 * pi() * u)), 2) + power(avg(sin(2 * pi() * u)), 2) AS r2 FROM o GROUP BY series_id),
z AS (SELECT series_id, any_value(n) AS n, any_value(d) AS d FROM ks JOIN m USING (series_id) GROUP BY series_id),
ku AS (SELECT series_id, greatest(0, least(1, sum(CASE WHEN i % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * i * i * power((sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d, 2))))) AS p_uniform FROM z, (SELECT unnest(range(1, 101)) AS i) WHERE d IS NOT NULL GROUP BY series_id),
gaps AS (SELECT series_id, stddev_pop(x) / (avg(x) + 1e-10) AS cv_gap FROM (SELECT series_id, lead(v) OVER (PARTITION BY series_id ORDER BY v) - v AS x FROM (SELECT DISTINCT series_id, v FROM r)) WHERE x IS NOT NULL GROUP BY series_id),
h AS (SELECT series_id, -sum(c / n * ln(c / n)) / nullif(ln(count(*)), 0) AS entropy FROM (SELECT series_id, least(floor(coalesce(u, 0) * greatest(1, least(n_unique, floor(sqrt(n))))), greatest(1, least(n_unique, floor(sqrt(n)))) - 1) AS b, count(*) AS c, any_value(n) AS n FROM o GROUP BY ALL) GROUP BY series_id),
p AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY t, v) AS i, (v - mean) / sd AS x, n FROM o WHERE sd > 0 AND n >= 20),
ac AS (SELECT series_id, max(abs(c)) AS autocorrelation FROM (SELECT a.series_id, b.i - a.i AS lag, sum(a.x * b.x) / any_value(a.n) AS c FROM p a JOIN p b ON a.series_id = b.series_id AND b.i > a.i AND b.i - a.i < a.n // 2 GROUP BY ALL) GROUP BY series_id),
evidence AS (SELECT m.series_id, name, m.n, n_unique, n_unique / m.n AS uniqueness, coalesce(entropy, 0) AS entropy, integers, coalesce(cv_gap, 0) AS cv_gap, falls, jumps, coalesce(autocorrelation, 0) AS autocorrelation,
  CASE WHEN hi - lo > 1e-10 AND m.n >= 50 AND n_unique > 10 THEN sqrt(r2) * (2 - r2) / greatest(1e-12, 1 - r2) ELSE 0 END AS kappa, {Y.normality_sql('m.n', 'skewness', 'kurtosis')} AS p_normal, coalesce(p_uniform, 0) AS p_uniform,
  ({near}) AS in_range, coalesce(regexp_matches(lower(name), '{"|".join(Y.CIRCULAR_WORDS)}'), false) AS named
  FROM m JOIN names USING (series_id) LEFT JOIN g USING (series_id) LEFT JOIN ks USING (series_id) LEFT JOIN ku USING (series_id) LEFT JOIN gaps USING (series_id) LEFT JOIN h USING (series_id) LEFT JOIN ac USING (series_id)),
{", ".join(steps)}
SELECT series_id, name, primary_type, subtype, round(confidence, 6) AS confidence FROM s{len(steps) - 1}"""


def oracle_sql():
    read_ = "r AS (SELECT series_id, t, max(feat_value) AS v FROM features WHERE feat_value IS NOT NULL AND NOT isnan(feat_value) GROUP BY ALL)"
    p = "p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings WHERE embedding IS NOT NULL)"

    def trust(high, low):
        dist = "round(list_distance({a}, {b}) ** 2, 12)"
        h, lo = (dist.format(a=x.format("a"), b=x.format("b")) for x in (high, low))
        return f"WITH {p}, n AS (SELECT a.id AS q, b.id AS i, row_number() OVER (PARTITION BY a.id ORDER BY {h}, b.id) AS rh, row_number() OVER (PARTITION BY a.id ORDER BY {lo}, b.id) AS rl FROM p a JOIN p b ON a.id % 20 = 0 AND a.id <> b.id) SELECT round(greatest(0, 1 - sum(CASE WHEN rh > 10 THEN rh - 10 ELSE 0 END) / (count(DISTINCT q) * 10 * ((SELECT count(*) FROM p) - 11))), 6) AS score FROM n WHERE rl <= 10"

    return {
        "series_types": _types_sql(read_),
        "type_features": f"WITH {read_}, m AS (SELECT series_id, avg(v) AS m, stddev_pop(v) AS s FROM r GROUP BY series_id) SELECT series_id, count(*) AS n, count(DISTINCT v) AS n_unique, round(any_value(m), 7) AS mean, round(any_value(s), 7) AS std, min(v) AS lo, max(v) AS hi, round(CASE WHEN any_value(s) > 0 THEN avg(power((v - m) / s, 3)) END, 7) AS skewness, round(CASE WHEN any_value(s) > 0 THEN avg(power((v - m) / s, 4)) - 3 END, 7) AS kurtosis, round(avg(CASE WHEN abs(v - round(v)) < 1e-10 THEN 1.0 ELSE 0.0 END), 7) AS integers FROM r JOIN m USING (series_id) GROUP BY series_id",
        "circular_mean_hour": "WITH e AS (SELECT event_type, hour(ts) * 2 * pi() / 24 AS a FROM events) SELECT event_type, round(atan2(avg(sin(a)), avg(cos(a))), 5) AS direction, round(sqrt(power(avg(sin(a)), 2) + power(avg(cos(a)), 2)), 5) AS length FROM e GROUP BY event_type",
        "circular_steps": "WITH s AS (SELECT a.event_id, b.value % 24 - a.value % 24 + 12 AS x FROM events a JOIN events b ON b.event_id = a.event_id + 1) SELECT event_id, round(((x % 24) + 24) % 24 - 12, 6) AS step FROM s",
        "feature_substitution": "SELECT DISTINCT session, CASE WHEN feature IN ('headdirection', 'bodydirection') THEN feature || '_2d' ELSE feature END AS feature FROM selectivity",
        "bad_frames_removed": "WITH s AS (SELECT DISTINCT unit_id, t FROM signals WHERE unit_id IS NOT NULL AND t % 97 >= 3), k AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY t) - 1 AS f FROM s) SELECT unit_id, count(*) AS frames, CAST(sum(t - f) AS BIGINT) AS moved FROM k GROUP BY unit_id",
        "session_parts": "WITH s AS (SELECT DISTINCT unit_id, t FROM signals WHERE unit_id IS NOT NULL), p AS (SELECT unit_id, t, t // 300 AS part FROM s UNION ALL SELECT unit_id, t, t // 300 + 1 FROM s WHERE t % 300 >= 240) SELECT unit_id, part, count(*) AS frames, min(t) AS first, max(t) AS last FROM p GROUP BY unit_id, part",
        "rdm_trials": f"WITH {HOURLY}, f AS (SELECT t // 24 AS trial, (t // 24) % 7 AS label, series, value FROM hourly WHERE t % 24 BETWEEN 8 AND 19), a AS (SELECT trial, label, series, avg(value) AS v FROM f GROUP BY ALL), pat AS (SELECT label, series, avg(v) AS v FROM a GROUP BY ALL), r AS (SELECT x.label AS label_a, y.label AS label_b, 1 - corr(x.v, y.v) AS dissimilarity FROM pat x JOIN pat y ON x.series = y.series AND x.label < y.label GROUP BY ALL) SELECT label_a, label_b, round(dissimilarity, 6) AS dissimilarity FROM r",
        "interpolated_frames": f"WITH {signals._UNITS}, e AS (SELECT unit_id, min(t) AS a, max(t) AS b FROM units GROUP BY unit_id), g AS (SELECT unit_id, unnest(range(a, b + 1)) AS t FROM e), j AS (SELECT g.unit_id, g.t, v, CASE WHEN v IS NOT NULL THEN g.t END AS s FROM g LEFT JOIN units u ON u.unit_id = g.unit_id AND u.t = g.t), w AS (SELECT *, last_value(s IGNORE NULLS) OVER p AS t0, last_value(v IGNORE NULLS) OVER p AS v0, first_value(s IGNORE NULLS) OVER n AS t1, first_value(v IGNORE NULLS) OVER n AS v1 FROM j WINDOW p AS (PARTITION BY unit_id ORDER BY t ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY unit_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT unit_id, t, round(v0 + (v1 - v0) * (t - t0) / (t1 - t0), 5) AS value FROM w WHERE v IS NULL",
        "decay_constants": f'WITH {signals._EVENTS}, h AS (SELECT e.unit_id, e."start" AS a, e."end" AS b, t, v FROM ev e JOIN units u ON u.unit_id = e.unit_id AND t BETWEEN e."start" AND e."end" + 20 WHERE v > 0), pk AS (SELECT unit_id, a, b, t AS p FROM h WHERE t < b QUALIFY row_number() OVER (PARTITION BY unit_id, a, b ORDER BY v DESC, t) = 1), f AS (SELECT unit_id, a, b, regr_slope(ln(v), (t - p) / 20.0) AS m, regr_r2(ln(v), (t - p) / 20.0) AS r2, count(*) AS n FROM h JOIN pk USING (unit_id, a, b) WHERE t BETWEEN p AND p + 20 GROUP BY ALL) SELECT unit_id, a AS "start", b AS "end", round(-1 / m, 6) AS tau, round(r2, 6) AS r2 FROM f WHERE n >= 3 AND m <> 0 AND -1 / m BETWEEN 0.1 AND 30 AND r2 >= 0.8',
        "trustworthiness": trust("{}.f", "{}.f[1:8]"),
        "continuity": trust("{}.f[1:8]", "{}.f"),
    }
