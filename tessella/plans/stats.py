"""Queries of entropies, information, shifts and corrections, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.special import digamma_sql, ppf_sql
from tessella.operators import information as I
from tessella.operators import pairing as P
from tessella.operators import selectivity as S
from tessella.plans.series import HOURLY, hourly
from tessella.session import read

ND = 6
TWO_STAGE = P.Plan(first=100, second=500, tail="norm")


def _r(df, *names):
    return df.select(*[F.round(c, ND).alias(c) if c in names else F.col(c) for c in df.columns])


def entropy_discrete(spark, d):
    return _r(I.entropy(read(spark, d, "lineitem"), ["l_linenumber"], ["l_returnflag"]), "entropy")


def entropy_joint(spark, d):
    return _r(I.entropy(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], name="joint"), "joint")


def mi_discrete(spark, d):
    return _r(I.mutual_information(read(spark, d, "lineitem"), ["l_returnflag"], ["l_linestatus"], ["l_linenumber"]), "hx", "hy", "hxy", "mi")


def mi_binary(spark, d):
    li = read(spark, d, "lineitem").select((F.col("l_quantity") > 25).alias("a"), (F.col("l_discount") > 0.05).alias("b"))
    return _r(I.mutual_information(li, ["a"], ["b"]), "hx", "hy", "hxy", "mi")


def cmi_discrete(spark, d):
    return _r(I.conditional_mi(read(spark, d, "lineitem"), ["l_returnflag"], ["l_linestatus"], ["l_linenumber"]), "cmi", "mi", "interaction")


def _scores(spark, d):
    return I.normal_scores(hourly(spark, d), ["series"], "value", ["t"])


def copula_rank(spark, d):
    return _r(_scores(spark, d).select("series", "t", "rank", "z"), "z")


def mi_gaussian(spark, d):
    return _r(I.pair_mi(_scores(spark, d), "series", "t"), "r", "mi")


def mi_gaussian_class(spark, d):
    z = _scores(spark, d).withColumn("hour", F.col("t") % 24)
    return _r(I.class_mi(z, ["series"], "z", "hour"), "mi")


def gaussian_triple(spark, d):
    h = hourly(spark, d)
    w = h.groupBy("t").agg(F.sum("value").alias("a"), F.sum("n").cast("double").alias("b"), F.max("value").alias("c"))
    return _r(I.gaussian_triple(w, "a", "b", "c"), "mi", "cmi", "mi_vector", "interaction", "tc", "dtc", "o_information")


def correlation_matrix(spark, d):
    return _r(I.correlation_table(hourly(spark, d), "series", "t", "value"), "r")


def on_off_ratio(spark, d):
    return _r(I.signal_ratio(hourly(spark, d).withColumn("busy", (F.col("t") % 24).between(8, 19)), ["series"], "value", "busy"), "mean_on", "mean_off", "ratio")


def _shifts(spark, d):
    """(key_a, key_b, n, r): correlations of every two series at every shift."""
    u = P.tagged(_scores(spark, d), F.col("series"), F.col("t"), F.col("z"), "continuous")
    return P.at_all_shifts(u, u, "pearson", same=True).select(F.col("unit").alias("key_a"), F.col("feature").alias("key_b"), "n", F.col("values").alias("r"))


def mi_all_shifts(spark, d):
    s = _shifts(spark, d).select("key_a", "key_b", "n", F.posexplode("r").alias("shift", "r"))
    return s.select("key_a", "key_b", "shift", F.round(I.gaussian_mi(F.col("r"), F.col("n")), ND).alias("mi"))


def mi_best_shift(spark, d):
    return _r(S.best_shift(_shifts(spark, d), 48), "mi")


def stage1_rank(spark, d):
    return _r(S.rank_test(_shifts(spark, d), 100).select("key_a", "key_b", "mi", "rank", "passed"), "mi", "rank")


def significance_two_stage(spark, d):
    """Every two series, tested with the tail of a normal distribution; a zero-inflated gamma one is
    the default of the operator."""
    u = P.tagged(_scores(spark, d), F.col("series"), F.col("t"), F.col("z"), "continuous")
    r = P.significance(u, u, TWO_STAGE, same=True)
    return r.select(F.col("unit").alias("key_a"), F.col("feature").alias("key_b"), F.round("mi", ND).alias("mi"), F.round("pre_rank", ND).alias("pre_rank"), "stage1", F.round("pval", 8).alias("pval"), F.round("p_threshold", 9).alias("p_threshold"), "significant")


def _pvals(spark, d):
    f = read(spark, d, "selectivity").filter("pval is not null and not isnan(pval)")
    return f.groupBy("mouse", "feature").agg(F.min("pval").alias("p"))


def holm_threshold(spark, d):
    return S.thresholds(_pvals(spark, d), "p", 0.05, ["mouse", "feature"], "holm").select("mouse", "feature", F.round("p_threshold", 9).alias("p_threshold"), (F.col("p") < F.col("p_threshold")).alias("passes"))


def bh_threshold(spark, d):
    return S.thresholds(_pvals(spark, d), "p", 0.05, ["mouse", "feature"], "bh").select("mouse", "feature", F.round("p_threshold", 9).alias("p_threshold"), (F.col("p") < F.col("p_threshold")).alias("passes"))


def bonferroni_threshold(spark, d):
    return S.thresholds(_pvals(spark, d), "p", 0.05, ["mouse", "feature"], "bonferroni").select("mouse", "feature", F.round("p_threshold", 9).alias("p_threshold"), (F.col("p") < F.col("p_threshold")).alias("passes"))


_NAMES = [
    entropy_discrete, entropy_joint, mi_discrete, mi_binary, cmi_discrete, copula_rank, mi_gaussian, mi_gaussian_class, gaussian_triple, correlation_matrix, on_off_ratio, mi_all_shifts, mi_best_shift,
    stage1_rank, significance_two_stage, holm_threshold, bh_threshold, bonferroni_threshold,
]


def queries():
    return {f.__name__: f for f in _NAMES}


def _h(cols: str, src: str, by: str = "") -> str:
    """Entropy by its definition: - sum p log2 p."""
    g, j, c = (f"{by}, ", f"PARTITION BY {by}", f"GROUP BY {by}") if by else ("", "", "")
    return f"SELECT {g}-sum(p * log2(p)) AS h FROM (SELECT {g}count(*) / sum(count(*)) OVER ({j}) AS p FROM {src} GROUP BY {g}{cols}) {c}"


SCORES = f"""{HOURLY},
ranked AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY value, t) AS rank, count(*) OVER (PARTITION BY series) AS len FROM hourly),
scores AS (SELECT series, t, rank, len, {ppf_sql('(rank / (len + 1))')} AS z FROM ranked)"""

_BIAS = f"({digamma_sql('(n - 2) / 2')} - {digamma_sql('(n - 1) / 2')}) / (2 * ln(2.0))"
_SHIFTS = f"""{SCORES},
shifts AS (SELECT unnest(range((SELECT max(len) FROM scores))) AS shift),
rolled AS (SELECT a.series AS key_a, b.series AS key_b, shift, corr(a.z, b.z) AS r, count(*) AS n
  FROM shifts, scores a JOIN scores b ON a.series < b.series WHERE a.t = (b.t + shift) % b.len GROUP BY ALL),
mis AS (SELECT key_a, key_b, shift, n, greatest(0, -0.5 * log2(1 - r * r) + {_BIAS}) AS mi FROM rolled)"""


def normal_sf_sql(z: str, steps: int = 4000) -> str:
    """Upper tail of the normal distribution, by Simpson's rule over the next twelve deviations."""
    return f"list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-power({z} + i * {12 / steps!r}, 2) / 2))) * {12 / steps / 3!r} / sqrt(2 * pi())"


def _two_stage_sql() -> str:
    t = TWO_STAGE
    null = lambda k, seed: f"SELECT key_a, key_b, round(m.mi, 9) AS mi FROM mis m JOIN (SELECT unnest(range(1, {k + 1})) AS i) ON m.shift = (i * 7919 + i * i * 104729 + {seed}) % m.n"
    return f"""WITH {_SHIFTS}, o AS (SELECT key_a, key_b, round(mi, 9) AS mi FROM mis WHERE shift = 0),
one AS ({null(t.first, 7)}), two AS ({null(t.second, 11)}),
st AS (SELECT o.*, (count(*) FILTER (WHERE one.mi < o.mi) + 1) / {t.first + 1} AS pre_rank FROM o JOIN one USING (key_a, key_b) GROUP BY ALL),
stay AS (SELECT * FROM st WHERE pre_rank > 1 - {t.top} / {t.first + 1}),
pv AS (SELECT stay.key_a, stay.key_b, (count(*) FILTER (WHERE two.mi < stay.mi) + 1) / {t.second + 1} AS rank, (any_value(stay.mi) - avg(two.mi)) / stddev_pop(two.mi) AS zs FROM stay JOIN two USING (key_a, key_b) GROUP BY ALL),
p AS (SELECT key_a, key_b, rank, {normal_sf_sql('zs')} AS pval FROM pv),
r AS (SELECT *, row_number() OVER (ORDER BY pval, key_a, key_b) - 1 AS i, count(*) OVER () AS c FROM p),
f AS (SELECT coalesce(min(i) FILTER (WHERE pval > {t.alpha} / (c - i)), max(c)) AS f, max(c) AS c FROM r),
thr AS (SELECT {t.alpha} / least(c - f + 1, c) AS thr FROM f)
SELECT st.key_a, st.key_b, round(mi, 6) AS mi, round(pre_rank, 6) AS pre_rank, pre_rank > 1 - {t.top} / {t.first + 1} AS stage1, round(pval, 8) AS pval, round(CASE WHEN pval IS NOT NULL THEN thr END, 9) AS p_threshold,
  coalesce(rank > 1 - {t.top2} / {t.second + 1} AND pval < thr, false) AS significant FROM st LEFT JOIN p USING (key_a, key_b) LEFT JOIN thr ON true"""


def oracle_sql():
    li = "lineitem"
    both = "(SELECT l_quantity > 25 AS a, l_discount > 0.05 AS b FROM lineitem)"

    def mi(x, y, src, by=""):
        on = f"USING ({by})" if by else "ON true"
        cols = f"{by}, " if by else ""
        return f"SELECT {cols}round(x.h, 6) AS hx, round(y.h, 6) AS hy, round(xy.h, 6) AS hxy, round(greatest(0, x.h + y.h - xy.h), 6) AS mi FROM ({_h(x, src, by)}) x JOIN ({_h(y, src, by)}) y {on} JOIN ({_h(x + ', ' + y, src, by)}) xy {on}"

    flag, status, line = "l_returnflag", "l_linestatus", "l_linenumber"
    hs = {"hx": flag, "hy": status, "hz": line, "hxy": f"{flag}, {status}", "hxz": f"{flag}, {line}", "hyz": f"{status}, {line}", "hxyz": f"{flag}, {status}, {line}"}
    parts = ", ".join(f"{k} AS ({_h(v, li)})" for k, v in hs.items())
    w = "SELECT corr(a, b) AS a, corr(a, c) AS b, corr(b, c) AS c, count(*) AS n FROM (SELECT t, sum(value) AS a, CAST(sum(n) AS DOUBLE) AS b, max(value) AS c FROM hourly GROUP BY t)"
    det = "(1 + 2 * a * b * c - a * a - b * b - c * c)"
    nats = lambda e: f"(0.5 * log2({e}))"
    pv = "pv AS (SELECT mouse, feature, min(pval) AS p FROM selectivity WHERE pval IS NOT NULL AND NOT isnan(pval) GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY p, mouse, feature) - 1 AS i, count(*) OVER () AS m FROM pv)"
    return {
        "entropy_discrete": f"SELECT l_returnflag, round(h, 6) AS entropy FROM ({_h(line, li, flag)})",
        "entropy_joint": f"SELECT round(h, 6) AS joint FROM ({_h(hs['hxyz'], li)})",
        "mi_discrete": mi(flag, status, li, line),
        "mi_binary": mi("a", "b", both),
        "cmi_discrete": f"WITH {parts}, e AS (SELECT greatest(0, hxz.h + hyz.h - hxyz.h - hz.h) AS cmi, greatest(0, hx.h + hy.h - hxy.h) AS mi FROM hx, hy, hz, hxy, hxz, hyz, hxyz) SELECT round(cmi, 6) AS cmi, round(mi, 6) AS mi, round(cmi - mi, 6) AS interaction FROM e",
        "copula_rank": f"WITH {SCORES} SELECT series, t, rank, round(z, 6) AS z FROM scores",
        "mi_gaussian": f"WITH {SCORES}, p AS (SELECT a.series AS key_a, b.series AS key_b, corr(a.z, b.z) AS r, count(*) AS n FROM scores a JOIN scores b ON a.t = b.t AND a.series < b.series GROUP BY ALL) SELECT key_a, key_b, round(r, 6) AS r, n, round(greatest(0, -0.5 * log2(1 - r * r) + {_BIAS}), 6) AS mi FROM p",
        "mi_gaussian_class": f"WITH {SCORES}, c AS (SELECT series, t % 24 AS h, count(*) AS n, var_samp(z) AS v FROM scores GROUP BY ALL HAVING count(*) > 1), w AS (SELECT series, sum(n * (0.5 * ln(v) - (ln(2.0) - ln(n - 1)) / 2 - {digamma_sql('(n - 1) / 2')} / 2)) AS s FROM c GROUP BY series), u AS (SELECT series, count(*) AS n, var_samp(z) AS v FROM scores GROUP BY series) SELECT series, n, round(greatest(0, (0.5 * ln(v) - (ln(2.0) - ln(n - 1)) / 2 - {digamma_sql('(n - 1) / 2')} / 2 - s / n) / ln(2.0)), 6) AS mi FROM u JOIN w USING (series)",
        "gaussian_triple": f"WITH {HOURLY}, w AS ({w}), m AS (SELECT n, -{nats('1 - a * a')} AS mi, {nats('1 - b * b')} + {nats('1 - c * c')} - {nats(det)} AS cmi, {nats('1 - c * c')} - {nats(det)} AS mv, -{nats(det)} AS tc, {nats('1 - a * a')} + {nats('1 - b * b')} + {nats('1 - c * c')} - 2 * {nats(det)} AS dtc FROM w) SELECT n, round(mi, 6) AS mi, round(cmi, 6) AS cmi, round(mv, 6) AS mi_vector, round(cmi - mi, 6) AS interaction, round(tc, 6) AS tc, round(dtc, 6) AS dtc, round(tc - dtc, 6) AS o_information FROM m",
        "correlation_matrix": f"WITH {HOURLY} SELECT a.series AS key_a, b.series AS key_b, round(corr(a.value, b.value), 6) AS r FROM hourly a JOIN hourly b ON a.t = b.t GROUP BY a.series, b.series",
        "on_off_ratio": f"WITH {HOURLY}, m AS (SELECT series, avg(value) FILTER (WHERE t % 24 BETWEEN 8 AND 19) AS x, avg(value) FILTER (WHERE t % 24 NOT BETWEEN 8 AND 19) AS y FROM hourly GROUP BY series) SELECT series, round(x, 6) AS mean_on, round(y, 6) AS mean_off, CASE WHEN y <> 0 THEN round(x / y, 6) END AS ratio FROM m",
        "mi_all_shifts": f"WITH {_SHIFTS} SELECT key_a, key_b, CAST(shift AS INT) AS shift, round(mi, 6) AS mi FROM mis",
        "mi_best_shift": f"WITH {_SHIFTS}, w AS (SELECT key_a, key_b, CASE WHEN shift > n / 2 THEN shift - n ELSE shift END AS s, round(mi, 9) AS mi FROM mis) SELECT key_a, key_b, CAST(s AS INT) AS shift, round(mi, 6) AS mi FROM w WHERE s BETWEEN -48 AND 48 QUALIFY row_number() OVER (PARTITION BY key_a, key_b ORDER BY w.mi DESC, s) = 1",
        "stage1_rank": f"WITH {_SHIFTS}, k AS (SELECT unnest(range(1, 101)) AS i), null_mi AS (SELECT m.key_a, m.key_b, m.mi FROM k, mis m WHERE m.shift = (i * 7919 + i * i * 104729 + 7) % m.n), o AS (SELECT key_a, key_b, mi FROM mis WHERE shift = 0), f AS (SELECT o.key_a, o.key_b, o.mi, (count(*) FILTER (WHERE round(x.mi, 9) < round(o.mi, 9)) + 1) / 101 AS rank FROM o JOIN null_mi x USING (key_a, key_b) GROUP BY ALL) SELECT key_a, key_b, round(mi, 6) AS mi, round(rank, 6) AS rank, rank > 1 - 1 / 101 AS passed FROM f",
        "significance_two_stage": _two_stage_sql(),
        "holm_threshold": f"WITH {pv}, f AS (SELECT min(i) AS f FROM o WHERE p > 0.05 / (m - i)) SELECT mouse, feature, round(CASE WHEN coalesce(f.f, m) > 0 THEN 0.05 / (m - coalesce(f.f, m) + 1) ELSE 0.05 / m END, 9) AS p_threshold, p < CASE WHEN coalesce(f.f, m) > 0 THEN 0.05 / (m - coalesce(f.f, m) + 1) ELSE 0.05 / m END AS passes FROM o, f",
        "bh_threshold": f"WITH {pv}, f AS (SELECT coalesce(max(p), 0) AS f FROM o WHERE p <= 0.05 * (i + 1) / m) SELECT mouse, feature, round(f.f, 9) AS p_threshold, p < f.f AS passes FROM o, f",
        "bonferroni_threshold": f"WITH {pv} SELECT mouse, feature, round(0.05 / m, 9) AS p_threshold, p < 0.05 / m AS passes FROM o",
    }
