"""Queries of units against features: measures at all shifts, the two-stage test, conditional
information and disentanglement, and their SQL.

The units are the event types' hourly sums; the features of each hour are the number and the sum of
all events (continuous), the hour of the day and whether the day is one of the week's last two.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessella.functions.special import digamma_sql, ppf_sql
from tessella.operators import conditional as C
from tessella.operators import information as I
from tessella.operators import pairing as P
from tessella.operators import selectivity as S
from tessella.plans.series import hourly
from tessella.plans.stats import SCORES
from tessella.session import cut

ND = 6
TEST = P.Plan(first=100, second=500, window=12, margin=10, tail="norm")


def _scores(spark, d):
    return cut(I.normal_scores(hourly(spark, d), ["series"], "value", ["t"]).select("series", "t", "value", "n", "z"))


def _units(scores):
    return P.tagged(scores, F.col("series"), F.col("t"), F.col("z"), "continuous")


def _wide(scores):
    """Per hour the number and sum of all events, as normal scores."""
    per = scores.groupBy("t").agg(F.sum("n").cast("double").alias("load"), F.round(F.sum("value"), 4).alias("spend"))
    long = per.select("t", F.explode(F.create_map(F.lit("load"), F.col("load"), F.lit("spend"), F.col("spend"))).alias("feature", "value"))
    return I.normal_scores(long, ["feature"], "value", ["t"]).select("feature", "t", "z")


def _continuous(scores):
    return P.tagged(_wide(scores), F.col("feature"), F.col("t"), F.col("z"), "continuous")


def _classes(scores):
    t = scores.select("t").distinct()
    hour, late = P.tagged(t, F.lit("hour"), F.col("t"), F.col("t") % 24, "discrete"), P.tagged(t, F.lit("late"), F.col("t"), (F.floor(F.col("t") / 24) % 7 >= 5).cast("int"), "discrete")
    return hour.unionByName(late)


def _both(scores, c=True):
    """The features as one two-dimensional vector: scores of number and sum, or the hour's place on a circle."""
    if c:
        one = F.when(F.col("feature") == "spend", 1).otherwise(0)
        return P.tagged(_wide(scores).withColumn("_d", one), F.lit("both"), F.col("t"), F.col("z"), "continuous", F.col("_d"))
    t, a = scores.select("t").distinct(), F.col("t") * (2 * math.pi / 24)
    return P.tagged(t, F.lit("clock"), F.col("t"), F.cos(a), "continuous", 0).unionByName(P.tagged(t, F.lit("clock"), F.col("t"), F.sin(a), "continuous", 1))


def _vectors(spark, d, scores):
    """Units of two components: scores of the sums and of the numbers of their events."""
    n = I.normal_scores(hourly(spark, d).select("series", "t", F.col("n").cast("double").alias("value")), ["series"], "value", ["t"])
    return _units(scores).unionByName(P.tagged(n, F.col("series"), F.col("t"), F.col("z"), "continuous", 1))


def _levels(scores):
    """Units as classes: how many events an hour has, up to 3."""
    return P.tagged(scores, F.col("series"), F.col("t"), F.least(F.col("n"), F.lit(3)), "discrete")


def _shifts(units, features, metric="mi"):
    v = P.at_all_shifts(units, features, metric).select("unit", "feature", F.posexplode("values").alias("shift", "value"))
    return v.select("unit", "feature", "shift", F.round("value", ND).alias("value"))


def shifts_gd(spark, d):
    s = _scores(spark, d)
    return _shifts(_units(s), _classes(s))


def shifts_dd(spark, d):
    s = _scores(spark, d)
    return _shifts(_levels(s), _classes(s))


def shifts_mts(spark, d):
    s = _scores(spark, d)
    return _shifts(_units(s), _both(s))


def shifts_mts_mts(spark, d):
    s = _scores(spark, d)
    return _shifts(_vectors(spark, d, s), _both(s, False))


def shifts_mts_discrete(spark, d):
    s = _scores(spark, d)
    return _shifts(_vectors(spark, d, s), _classes(s).filter("key = 'late'"))


def shifts_pearson(spark, d):
    s = _scores(spark, d)
    return _shifts(_units(s), _continuous(s), "pearson")


def shifts_av(spark, d):
    s = _scores(spark, d)
    return _shifts(P.tagged(s, F.col("series"), F.col("t"), F.col("value"), "plain"), _classes(s).filter("key = 'late'"), "av")


def _tested(s):
    return P.significance(_units(s), _continuous(s).unionByName(_classes(s)), TEST)


def unit_feature_significance(spark, d):
    r = _tested(_scores(spark, d))
    return r.select("unit", "feature", "delay", F.round("mi", ND).alias("mi"), F.round("pre_rank", ND).alias("pre_rank"), "stage1", F.round("rank", ND).alias("rank"), F.round("pval", 8).alias("pval"), F.round("p_threshold", 9).alias("p_threshold"), "significant")


def unit_feature_finished(spark, d):
    s = _scores(spark, d)
    features = _continuous(s).unionByName(_classes(s))
    raw = P.tagged(s, F.col("series"), F.col("t"), F.col("value"), "continuous")
    r = P.finished(cut(_tested(s)), _units(s), features, raw)
    return r.select("unit", "feature", F.round("rel_me_beh", ND).alias("rel_me_beh"), F.round("rel_me_ca", ND).alias("rel_me_ca"), F.round("signal_ratio", ND).alias("signal_ratio"), "significant")


def _pairs(scores):
    return S.feature_pairs(scores.select("series", "t", "z"), "series", "t", "z")


def redundancy_decision(spark, d):
    """Every series as a unit, every two others as its features: their information about the unit,
    alone and given each other, from normal scores, and which of the two is primary."""
    r = P.disentangled(_pairs(_scores(spark, d)))
    return r.select("unit", "f1", "f2", *[F.round(c, ND).alias(c) for c in ("mi_1", "mi_2", "cmi_1", "cmi_2", "interaction")], "outcome")


def disentanglement(spark, d):
    return P.disentanglement_matrix(P.disentangled(_pairs(_scores(spark, d))))


def disentanglement_filtered(spark, d):
    """Only units that tell something about both features before, only decided pairs after."""
    kept = P.disentangled(_pairs(_scores(spark, d)), before=[P.composed(lambda p: p.filter("mi_1 > 0.00001"), lambda p: p.filter("mi_2 > 0.00001"))], after=[lambda p: p.filter("outcome <> 0.5")])
    return P.losers(kept)


def _mixed(spark, d):
    s = _scores(spark, d)
    w = _wide(s)
    f = w.groupBy("t").agg(F.max(F.when(F.col("feature") == "load", F.col("z"))).alias("load"), F.max(F.when(F.col("feature") == "spend", F.col("z"))).alias("spend"))
    return s.join(f, "t").withColumn("hour", F.col("t") % 24).withColumn("late", F.floor(F.col("t") / 24) % 7 >= 5)


def cmi_ccc(spark, d):
    return C.given_normal(_mixed(spark, d), ["series"], "z", "load", "spend").select("series", F.round("cmi", ND).alias("cmi"))


def cmi_ccd(spark, d):
    return C.given_class(_mixed(spark, d), ["series"], "z", "spend", "hour").select("series", F.round("cmi", ND).alias("cmi"))


def cmi_cdc(spark, d):
    return C.class_given_normal(_mixed(spark, d), ["series"], "z", "hour", "spend").select("series", F.round("cmi", ND).alias("cmi"))


def cmi_cdd(spark, d):
    return C.class_given_class(_mixed(spark, d), ["series"], "z", "late", "hour").select("series", F.round("cmi", ND).alias("cmi"))


def entropy_gaussian(spark, d):
    m = _mixed(spark, d)
    one, two = C.gaussian_entropy(m, ["series"], ["z"], "one"), C.gaussian_entropy(m, ["series"], ["z", "spend"], "two")
    return one.join(two, "series").select("series", F.round("one", ND).alias("one"), F.round("two", ND).alias("two"))


_NAMES = [
    shifts_gd, shifts_dd, shifts_mts, shifts_mts_mts, shifts_mts_discrete, shifts_pearson, shifts_av, unit_feature_significance, unit_feature_finished, redundancy_decision, disentanglement,
    disentanglement_filtered, cmi_ccc, cmi_ccd, cmi_cdc, cmi_cdd, entropy_gaussian,
]


def queries():
    return {f.__name__: f for f in _NAMES}


_BASE = f"""{SCORES},
per AS (SELECT t, CAST(sum(n) AS DOUBLE) AS load, round(sum(value), 4) AS spend FROM hourly GROUP BY t),
long AS (SELECT t, 'load' AS feature, load AS value FROM per UNION ALL SELECT t, 'spend', spend FROM per),
fr AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value, t) AS k, count(*) OVER (PARTITION BY feature) AS len FROM long),
fc AS (SELECT feature, t, value, len, {ppf_sql('(k / (len + 1))')} AS z FROM fr),
fd AS (SELECT 'hour' AS feature, t, t % 24 AS c FROM per UNION ALL SELECT 'late', t, CASE WHEN (t // 24) % 7 >= 5 THEN 1 ELSE 0 END FROM per),
sh AS (SELECT unnest(range((SELECT max(len) FROM scores))) AS shift)"""

_MEET = "b.t = (a.t - shift + a.len) % a.len"


def _h(v: str, n: str) -> str:
    """Entropy of a normal variable of variance v over n values, in nats, less its constant."""
    return f"(0.5 * ln({v}) - (ln(2.0) - ln({n} - 1)) / 2 - {digamma_sql(f'({n} - 1) / 2.0')} / 2)"


def _bias(n: str, d: int) -> str:
    return "(" + " + ".join(f"{digamma_sql(f'({n} - {i}) / 2.0')} / 2" for i in range(1, d + 1)) + f" + {d} * (ln(2.0) - ln({n} - 1)) / 2)"


def _det_sql(names: list[str], cov) -> str:
    def det(rows: list[str], cols: list[str]) -> str:
        if len(rows) == 1:
            return cov(rows[0], cols[0])
        return "(" + " + ".join(f"({'-' if k % 2 else ''}{cov(rows[0], c)}) * {det(rows[1:], cols[:k] + cols[k + 1:])}" for k, c in enumerate(cols)) + ")"

    return det(names, names)


def _normal(of: list[str], n: str, constant: bool = False) -> str:
    """Entropy of columns of the group at hand, jointly normal, in nats."""
    c = f" + {len(of) * math.log(2 * math.pi * math.e) / 2!r}" if constant else ""
    return f"(0.5 * ln({_det_sql(of, lambda a, b: f'covar_samp({a}, {b})')}) - {_bias(n, len(of))}{c})"


_GD = f"""gm AS (SELECT series AS unit, feature, shift, c, count(*) AS m, var_samp(z) AS v FROM sh, scores a JOIN fd b ON {_MEET} GROUP BY ALL),
tot AS (SELECT series AS unit, count(*) AS n, var_samp(z) AS v FROM scores GROUP BY series),
gd AS (SELECT gm.unit, feature, shift, greatest(0, (any_value({_h('tot.v', 'tot.n')}) - sum(m / n * {_h('gm.v', 'm')}) FILTER (WHERE m >= 2)) / ln(2.0)) AS mi FROM gm JOIN tot USING (unit) GROUP BY ALL)"""
_CC = f"""cr AS (SELECT series AS unit, feature, shift, corr(a.z, b.z) AS r, count(*) AS n FROM sh, scores a JOIN fc b ON {_MEET} GROUP BY ALL),
cc AS (SELECT unit, feature, shift, greatest(0, -0.5 * log2(1 - r * r) + ({digamma_sql('(n - 2) / 2')} - {digamma_sql('(n - 1) / 2')}) / (2 * ln(2.0))) AS mi FROM cr)"""


def _significance_sql() -> str:
    def nulls(name: str, k: int, seed: int, pairs: str) -> str:
        ok = f"((s - delay + {720 * 100}) % n BETWEEN {TEST.margin} AND n - {TEST.margin + 1})"
        return f"""{name}_s AS (SELECT unit, feature, k, coalesce(arg_min(s, j) FILTER (WHERE {ok}), arg_max(s, j)) AS shift FROM
  (SELECT p.unit, p.feature, delay, n, k, j, (k * 7919 + k * k * 104729 + j * 15485863 + {seed}) % n AS s FROM {pairs} p, (SELECT unnest(range(1, {k + 1})) AS k), (SELECT unnest(range(0, {P.REDRAWS})) AS j)) GROUP BY unit, feature, k),
{name} AS (SELECT unit, feature, m.mi FROM {name}_s JOIN m USING (unit, feature, shift))"""

    steps = 4000
    sf = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-power(zs + i * {12 / steps!r}, 2) / 2))) * {12 / steps / 3!r} / sqrt(2 * pi())"
    return f"""{_BASE}, {_GD}, {_CC},
m AS (SELECT unit, feature, shift, round(mi, 9) AS mi, (SELECT max(len) FROM scores) AS n FROM (SELECT * FROM gd UNION ALL SELECT * FROM cc)),
best AS (SELECT unit, feature, n, mi, CASE WHEN shift > n / 2 THEN shift - n ELSE shift END AS delay FROM m WHERE shift <= {TEST.window} OR shift >= n - {TEST.window} QUALIFY row_number() OVER (PARTITION BY unit, feature ORDER BY m.mi DESC, delay) = 1),
{nulls('one', TEST.first, 7, 'best')},
st AS (SELECT best.*, (count(*) FILTER (WHERE one.mi < best.mi) + 1) / {TEST.first + 1} AS pre_rank FROM best JOIN one USING (unit, feature) GROUP BY ALL),
stay AS (SELECT * FROM st WHERE pre_rank > 1 - {TEST.top} / {TEST.first + 1}),
{nulls('two', TEST.second, 11, 'stay')},
pv AS (SELECT unit, feature, (count(*) FILTER (WHERE two.mi < stay.mi) + 1) / {TEST.second + 1} AS rank, (any_value(stay.mi) - avg(two.mi)) / stddev_pop(two.mi) AS zs FROM stay JOIN two USING (unit, feature) GROUP BY unit, feature),
p AS (SELECT unit, feature, rank, CASE WHEN zs IS NULL THEN 1.0 ELSE {sf} END AS pval FROM pv),
o AS (SELECT *, row_number() OVER (ORDER BY pval, unit, feature) - 1 AS i, count(*) OVER () AS c FROM p),
f AS (SELECT coalesce(min(i) FILTER (WHERE pval > {TEST.alpha} / (c - i)), max(c)) AS f, max(c) AS c FROM o),
thr AS (SELECT {TEST.alpha} / least(c - f + 1, c) AS thr FROM f),
tested AS (SELECT st.unit, st.feature, delay, st.mi, pre_rank, pre_rank > 1 - {TEST.top} / {TEST.first + 1} AS stage1, rank, pval, CASE WHEN pval IS NOT NULL THEN thr END AS p_threshold,
  coalesce(rank > 1 - {TEST.top2} / {TEST.second + 1} AND pval < thr, false) AS significant FROM st LEFT JOIN p USING (unit, feature) LEFT JOIN thr ON true)"""


def oracle_sql():
    vec = f"""nr AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY n, t) AS k2, count(*) OVER (PARTITION BY series) AS l2 FROM hourly),
v2 AS (SELECT s.series, s.t, s.len, s.z AS x1, {ppf_sql('(k2 / (l2 + 1))')} AS x2 FROM scores s JOIN nr USING (series, t)),
w2 AS (SELECT t, max(z) FILTER (WHERE feature = 'load') AS y1, max(z) FILTER (WHERE feature = 'spend') AS y2 FROM fc GROUP BY t),
ck AS (SELECT t, cos(t * 2 * pi() / 24) AS y1, sin(t * 2 * pi() / 24) AS y2 FROM per)"""
    out = "SELECT unit, feature, CAST(shift AS INT) AS shift, round(value, 6) AS value"

    def vectors(a: str, xs: list[str], b: str, label: str) -> str:
        ys = ["y1", "y2"]
        raw = f"({_normal(xs, 'n')} + {_normal(ys, 'n')} - {_normal([*xs, *ys], 'n')}) / ln(2.0)".replace("n - ", "count(*) - ").replace("(n)", "(count(*))")
        return f"WITH {_BASE}, {vec}, j AS (SELECT a.series AS unit, shift, {', '.join(xs)}, y1, y2 FROM sh, {a} a JOIN {b} b ON {_MEET}), g AS (SELECT unit, '{label}' AS feature, shift, greatest(0, {raw}) AS value FROM j GROUP BY unit, shift) {out} FROM g"

    mixed = f"{_BASE}, {vec}, mx AS (SELECT s.series, s.t, s.z, y1 AS load, y2 AS spend, s.t % 24 AS hour, (s.t // 24) % 7 >= 5 AS late FROM scores s JOIN w2 USING (t))"
    h = lambda *of: _normal(list(of), "count(*)", True)
    pairs = "c AS (SELECT x.series AS unit, a.series AS f1, b.series AS f2, corr(x.z, a.z) AS p, corr(x.z, b.z) AS q, corr(a.z, b.z) AS r FROM scores x JOIN scores a ON a.t = x.t AND a.series <> x.series JOIN scores b ON b.t = x.t AND b.series <> x.series AND a.series < b.series GROUP BY ALL), m AS (SELECT *, -0.5 * log2(1 - p * p) AS mi_1, -0.5 * log2(1 - q * q) AS mi_2, -0.5 * log2(1 - power((p - q * r) / sqrt((1 - q * q) * (1 - r * r)), 2)) AS cmi_1, -0.5 * log2(1 - power((q - p * r) / sqrt((1 - p * p) * (1 - r * r)), 2)) AS cmi_2 FROM c), g AS (SELECT *, (cmi_1 - mi_1 + cmi_2 - mi_2) / 2 AS interaction FROM m)"
    decided = f"{SCORES}, {pairs}, dc AS (SELECT *, CAST({P.outcome_sql()} AS DOUBLE) AS outcome FROM g)"
    return {
        "shifts_gd": f"WITH {_BASE}, {_GD} SELECT unit, feature, CAST(shift AS INT) AS shift, round(mi, 6) AS value FROM gd",
        "shifts_dd": f"WITH {_BASE}, lv AS (SELECT series AS unit, t, len, least(n, 3) AS k FROM scores JOIN hourly USING (series, t)), j AS (SELECT unit, feature, shift, k, c, count(*) AS m FROM sh, lv a JOIN fd b ON {_MEET} GROUP BY ALL), s AS (SELECT *, sum(m) OVER (PARTITION BY unit, feature, shift) AS n, sum(m) OVER (PARTITION BY unit, feature, shift, k) AS mk, sum(m) OVER (PARTITION BY unit, feature, shift, c) AS mc FROM j) SELECT unit, feature, CAST(shift AS INT) AS shift, round(greatest(0, sum(m / n * log2(m * n / (mk * mc)))), 6) AS value FROM s GROUP BY unit, feature, shift",
        "shifts_mts": vectors("v2", ["x1"], "w2", "both"),
        "shifts_mts_mts": vectors("v2", ["x1", "x2"], "ck", "clock"),
        "shifts_mts_discrete": f"WITH {_BASE}, {vec}, j AS (SELECT a.series AS unit, feature, shift, c, x1, x2 FROM sh, v2 a JOIN fd b ON {_MEET} WHERE feature = 'late'), k AS (SELECT unit, feature, shift, c, count(*) AS m, {_normal(['x1', 'x2'], 'count(*)')} AS h FROM j GROUP BY ALL), t AS (SELECT series AS unit, count(*) AS n, {_normal(['x1', 'x2'], 'count(*)')} AS h FROM v2 GROUP BY series), g AS (SELECT k.unit, feature, shift, greatest(0, (any_value(t.h) - sum(m / n * k.h)) / ln(2.0)) AS value FROM k JOIN t USING (unit) GROUP BY ALL) {out} FROM g",
        "shifts_pearson": f"WITH {_BASE}, {_CC} SELECT unit, feature, CAST(shift AS INT) AS shift, round(r, 6) AS value FROM cr",
        "shifts_av": f"WITH {_BASE}, j AS (SELECT a.series AS unit, feature, shift, c, a.value AS x FROM sh, (SELECT h.*, len FROM hourly h JOIN scores USING (series, t)) a JOIN fd b ON {_MEET} WHERE feature = 'late'), g AS (SELECT unit, feature, shift, avg(x) FILTER (WHERE c = 1) / nullif(avg(x) FILTER (WHERE c = 0), 0) AS value FROM j GROUP BY ALL) {out} FROM g",
        "unit_feature_significance": f"WITH {_significance_sql()} SELECT unit, feature, CAST(delay AS INT) AS delay, round(mi, 6) AS mi, round(pre_rank, 6) AS pre_rank, stage1, round(rank, 6) AS rank, round(pval, 8) AS pval, round(p_threshold, 9) AS p_threshold, significant FROM tested",
        "unit_feature_finished": f"""WITH {_significance_sql()},
hf AS (SELECT feature, -sum(m / n * log2(m / n)) AS h FROM (SELECT feature, c, count(*) AS m, sum(count(*)) OVER (PARTITION BY feature) AS n FROM fd GROUP BY feature, c) GROUP BY feature UNION ALL SELECT feature, {h('z')} / ln(2.0) FROM fc GROUP BY feature),
hu AS (SELECT series AS unit, {h('z')} / ln(2.0) AS h FROM scores GROUP BY series),
onoff AS (SELECT feature, t, c = 1 AS is_on FROM fd WHERE feature = 'late' UNION ALL SELECT feature, t, z > (SELECT median(z) FROM fc y WHERE y.feature = fc.feature) FROM fc),
rt AS (SELECT tested.unit, tested.feature, avg(x.value) FILTER (WHERE is_on) / nullif(avg(x.value) FILTER (WHERE NOT is_on), 0) AS signal_ratio FROM tested JOIN onoff o ON o.feature = tested.feature JOIN (SELECT h.*, len FROM hourly h JOIN scores USING (series, t)) x ON x.series = tested.unit AND x.t = (o.t + delay + x.len) % x.len GROUP BY ALL)
SELECT unit, feature, round(mi / hf.h, 6) AS rel_me_beh, round(mi / hu.h, 6) AS rel_me_ca, round(signal_ratio, 6) AS signal_ratio, significant AND NOT coalesce(signal_ratio <= 1, false) AS significant FROM tested LEFT JOIN hf USING (feature) LEFT JOIN hu USING (unit) LEFT JOIN rt USING (unit, feature)""",
        "redundancy_decision": f"WITH {decided} SELECT unit, f1, f2, round(mi_1, 6) AS mi_1, round(mi_2, 6) AS mi_2, round(cmi_1, 6) AS cmi_1, round(cmi_2, 6) AS cmi_2, round(interaction, 6) AS interaction, outcome FROM dc",
        "disentanglement": f"WITH {decided}, b AS (SELECT f1 AS feature_a, f2 AS feature_b, outcome FROM dc UNION ALL SELECT f2, f1, 1 - outcome FROM dc) SELECT feature_a, feature_b, sum(outcome) AS score, count(*) AS n FROM b GROUP BY ALL",
        "disentanglement_filtered": f"WITH {decided} SELECT DISTINCT unit, CASE WHEN outcome = 1 THEN f1 ELSE f2 END AS feature FROM dc WHERE mi_1 > 0.00001 AND mi_2 > 0.00001 AND outcome <> 0.5",
        "cmi_ccc": f"WITH {mixed} SELECT series, round(greatest(0, ({h('z', 'spend')} + {h('load', 'spend')} - {h('z', 'load', 'spend')} - {h('spend')}) / ln(2.0)), 6) AS cmi FROM mx GROUP BY series",
        "cmi_ccd": f"WITH {mixed}, k AS (SELECT series, hour, count(*) AS m, greatest(0, {h('z')} + {h('spend')} - {h('z', 'spend')}) AS i FROM mx GROUP BY ALL) SELECT series, round(sum(m * i) FILTER (WHERE m > 4) / sum(m) / ln(2.0), 6) AS cmi FROM k GROUP BY series",
        "cmi_cdc": f"WITH {mixed}, a AS (SELECT series, count(*) AS n, {h('z', 'spend')} - {h('spend')} AS h FROM mx GROUP BY series), k AS (SELECT series, hour, count(*) AS m, {h('z', 'spend')} - {h('spend')} AS w FROM mx GROUP BY ALL) SELECT a.series, round(greatest(0, (any_value(h) - sum(m * w) FILTER (WHERE m > 3) / any_value(n)) / ln(2.0)), 6) AS cmi FROM a JOIN k USING (series) GROUP BY a.series",
        "cmi_cdd": f"WITH {mixed}, a AS (SELECT series, sum(m * h) / sum(m) AS h FROM (SELECT series, hour, count(*) AS m, {h('z')} AS h FROM mx GROUP BY ALL) WHERE m > 2 GROUP BY series), b AS (SELECT series, sum(m * h) / sum(m) AS h2 FROM (SELECT series, hour, late, count(*) AS m, {h('z')} AS h FROM mx GROUP BY ALL) WHERE m > 2 GROUP BY series) SELECT series, round(greatest(0, (h - h2) / ln(2.0)), 6) AS cmi FROM a JOIN b USING (series)",
        "entropy_gaussian": f"WITH {mixed} SELECT series, round({h('z')} / ln(2.0), 6) AS one, round({h('z', 'spend')} / ln(2.0), 6) AS two FROM mx GROUP BY series",
    }
