"""Known answers for the engine's own operators."""

import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import special
from tessella.operators import graph, information, manifold, pairing, recurrence, selectivity, signal


def series(spark, **values):
    return spark.createDataFrame([(k, t, float(v)) for k, x in values.items() for t, v in enumerate(x)], "key string, t bigint, value double")


def test_special_functions(spark):
    p = [1e-6, 0.01, 0.3, 0.5, 0.77, 0.999]
    got = [r.z for r in spark.createDataFrame([(x,) for x in p], "p double").select(special.normal_ppf(F.col("p")).alias("z")).collect()]
    assert np.allclose(got, [statistics.NormalDist().inv_cdf(x) for x in p], atol=5e-9)
    d = spark.createDataFrame([(1.0,), (0.5,), (10.0,)], "x double").select(special.digamma(F.col("x")).alias("d")).collect()
    assert np.allclose([r.d for r in d], [-0.5772156649015329, -1.9635100260214235, 2.251752589066721], atol=1e-9)
    assert special.gamma_sf(2.0, 1.0, 1.0) == pytest.approx(math.exp(-2)) and special.gamma_sf(3.0, 2.0, 1.0) == pytest.approx(4 * math.exp(-3))
    rng = np.random.default_rng(0)
    assert np.allclose(special.fit_gamma(rng.gamma(3.0, 2.0, 20_000)), (3.0, 2.0), rtol=0.05)


def test_information(spark):
    df = spark.createDataFrame([(i % 2, i % 2, i % 4) for i in range(64)], "x int, y int, z int")
    assert information.entropy(df, ["z"]).first().entropy == pytest.approx(2)
    assert information.mutual_information(df, ["x"], ["y"]).first().mi == pytest.approx(1)
    assert information.conditional_mi(df, ["x"], ["y"], ["z"]).first().cmi == pytest.approx(0)
    rng = np.random.default_rng(1)
    a = rng.normal(size=2000)
    b = 0.7 * a + math.sqrt(1 - 0.49) * rng.normal(size=2000)
    z = information.normal_scores(series(spark, a=a, b=b), ["key"], "value", ["t"])
    assert information.pair_mi(z, "key", "t").first().mi == pytest.approx(-0.5 * math.log2(1 - 0.49), abs=0.05)


def test_shifts_and_two_stages_find_planted_dependence(spark):
    rng = np.random.default_rng(2)
    a = np.convolve(rng.normal(size=600), np.ones(3), "same")
    z = information.normal_scores(series(spark, a=a, b=np.roll(a, -7) + 0.3 * rng.normal(size=600), c=rng.normal(size=600), d=a + 0.2 * rng.normal(size=600)), ["key"], "value", ["t"])
    u = pairing.tagged(z, F.col("key"), F.col("t"), F.col("z"), "continuous")
    shifts = pairing.at_all_shifts(u, u, "pearson", same=True).select(F.col("unit").alias("key_a"), F.col("feature").alias("key_b"), "n", F.col("values").alias("r"))
    best = {(r.key_a, r.key_b): r.shift for r in selectivity.best_shift(shifts, 20).collect()}
    assert best[("a", "b")] == 7 and best[("a", "d")] == 0 and best[("b", "d")] == -7
    got = {(r.unit, r.feature) for r in pairing.significance(u, u, pairing.Plan(first=50, second=200), same=True).collect() if r.significant}
    assert got == {("a", "d")}


def test_corrections(spark):
    df = spark.createDataFrame([(k, p) for k, p in enumerate([0.001, 0.012, 0.02, 0.04, 0.5])], "k int, p double")
    t = lambda m: selectivity.thresholds(df, "p", 0.05, ["k"], m).first().p_threshold
    assert t("holm") == pytest.approx(0.05 / 4) and t("bh") == pytest.approx(0.04) and t("bonferroni") == pytest.approx(0.01) and t("none") == 0.05
    none = df.withColumn("p", F.lit(0.9))
    assert selectivity.thresholds(none, "p", 0.05, ["k"], "holm").first().p_threshold == pytest.approx(0.01)
    assert selectivity.thresholds(df.limit(0), "p", 0.05, ["k"], "holm").count() == 0


def test_events_and_islands(spark):
    x = np.zeros(200)
    x[20:25], x[26:30], x[60:62], x[100:110] = 5, 5, 5, 5
    x += np.tile([0, 0.01, 0.02, 0.01], 50)
    got = {(r.start, r.end) for r in signal.threshold_events(series(spark, a=x)).collect()}
    assert got == {(20, 30), (100, 110)}
    assert signal.threshold_events(series(spark, a=x).limit(0)).count() == 0


def test_margin_does_not_change_smoothing(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=500)
    s = series(spark, a=x)
    w = np.exp(-0.5 * (np.arange(-8, 9) / 2) ** 2)
    want = np.convolve(np.pad(x, 8, mode="symmetric"), w / w.sum(), "valid")
    f = signal.with_margin(s, lambda t, v: np.array([np.median(v[max(0, i - 3) : i + 4]) for i in range(len(v))]), 3, chunk=64).toPandas().sort_values("t")
    assert np.allclose(signal.gaussian_smooth(s, 2.0).toPandas().sort_values("t").value, want)
    assert np.allclose(f.value, [np.median(x[max(0, i - 3) : i + 4]) for i in range(500)])
    sg = signal.savitzky_golay(series(spark, a=np.arange(50) ** 2), 7, 2).toPandas().sort_values("t")
    assert np.allclose(sg.value, np.arange(50) ** 2)


def test_recurrence(spark):
    ramp = recurrence.ordinal_patterns(series(spark, a=range(20)), 3, 1)
    assert {r.pattern for r in ramp.collect()} == {"012"} and recurrence.permutation_entropy(ramp, 3).first().entropy == pytest.approx(0)
    assert recurrence.visibility(series(spark, a=range(20)), "natural").count() == 19
    e = {(r.a, r.b) for r in recurrence.visibility(series(spark, a=[1, 1, 2])).collect()}
    assert e == {(0, 1), (1, 2), (0, 2)}
    assert {(r.a, r.b) for r in recurrence.visibility(series(spark, a=[1, 1, 2]), strict=True).collect()} == {(0, 1), (1, 2)}
    line = spark.createDataFrame([("a", i, i + 5) for i in range(3, 8)], "key string, i bigint, j bigint")
    m = recurrence.line_measures(line).first()
    assert (m.det, m.l_mean, m.l_max, m.divergence, m.entropy) == (1.0, 5.0, 5, 0.2, 0.0)


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 1.0), (7, 8, 1.0), (9, 8, 2.0)], "src bigint, dst bigint, w double")
    assert {r.id: r.component for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7}
    assert {r.id for r in graph.giant_component(e).collect()} == {1, 2, 3, 4}
    c = {r.id: (r.triangles, r.coefficient) for r in graph.clustering(e).collect()}
    assert c[1] == (1, 1.0) and c[3] == (1, pytest.approx(1 / 3)) and c[8] == (0, 0.0)
    path = spark.createDataFrame([(i, i + 1, 1.0) for i in range(60)], "src bigint, dst bigint, w double")
    assert graph.components(path).select("component").distinct().count() == 1
    assert {r.id: r.hops for r in graph.hops(path.filter("src < 24"), path.filter("src = 0").select(F.col("src").alias("id"))).collect()} == {k: k for k in range(25)}
    k4 = spark.createDataFrame([(i, j, 1.0) for i in range(4) for j in range(4) if i != j], "src bigint, dst bigint, w double")
    assert np.allclose([r.eigenvalue for r in graph.spectrum(k4, False).orderBy("rank").collect()], [0, 4, 4, 4])


def test_manifold(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5))
    x[10] = x[11]
    p = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "features": x.tolist()})).repartition(4)
    got = manifold.nearest(p, p.filter("id % 20 = 0 or id = 10"), 4).toPandas()
    for q, g in got.groupby("query"):
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        assert g.sort_values("rank").id.tolist() == np.lexsort((np.arange(300), d.round(9)))[:4].tolist()
    assert np.allclose(manifold.covariance(p), np.cov(x.T))
    coords, spec = manifold.pca(p, 2)
    assert np.allclose(sorted([r.variance for r in spec.collect()], reverse=True), np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2])
    one_hot = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (4, [1.0, 0.0, 0.0])], "l int, v array<double>")
    r = {(x.label_a, x.label_b): x.dissimilarity for x in manifold.rdm(manifold.patterns(one_hot, "l", "v")).collect()}
    assert r[(1, 4)] == pytest.approx(0) and r[(1, 2)] == pytest.approx(1.5)
