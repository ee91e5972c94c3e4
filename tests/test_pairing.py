import numpy as np
import pandas as pd
import pytest

from tessella.operators import pairing as P


def frame(spark, series, kind="continuous"):
    rows = [(k, kind if isinstance(kind, str) else kind[k], d, t, float(v)) for k, x in series.items() for d, line in enumerate(np.atleast_2d(x)) for t, v in enumerate(line)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["key", "kind", "dim", "t", "x"]))


def plain(metric, a, b, kind_a, kind_b):
    """Shift by shift, from the rolled series."""
    out = []
    for s in range(a.shape[1]):
        x, y = P.Series.of(kind_a, a), P.Series.of(kind_b, np.roll(b, s, axis=1))
        out.append(metric(x, y)[0])
    return np.array(out)


@pytest.mark.parametrize("kinds, dims", [(("continuous", "continuous"), (1, 1)), (("continuous", "discrete"), (1, 1)), (("discrete", "continuous"), (1, 2)), (("discrete", "discrete"), (1, 1)), (("continuous", "continuous"), (2, 3)), (("continuous", "discrete"), (3, 1))])
def test_all_shifts_are_those_of_rolled_series(kinds, dims):
    rng = np.random.default_rng(5)
    make = lambda k, d: rng.integers(0, 3, (1, 90)).astype(float) if k == "discrete" else np.cumsum(rng.normal(size=(d, 90)), axis=1)
    a, b = make(kinds[0], dims[0]), make(kinds[1], dims[1])
    got = P.information(P.Series.of(kinds[0], a), P.Series.of(kinds[1], b))
    assert np.allclose(got, plain(P.information, a, b, *kinds), atol=1e-9)


def test_known_dependence_delay_and_independence(spark):
    rng = np.random.default_rng(1)
    n = 600
    f, g = rng.normal(size=n), (rng.random(n) > 0.6).astype(float)
    units = {"follows": np.roll(f, 5) + 0.5 * rng.normal(size=n), "switched": g * 2 + rng.normal(size=n), "noise": rng.normal(size=n), "flat": np.ones(n), "short": np.arange(4.0)}
    features = frame(spark, {"f": f}).unionByName(frame(spark, {"g": g}, "discrete"))
    plan = P.Plan(second=400, window=10, margin=15)
    r = {(x.unit, x.feature): x for x in P.significance(frame(spark, units), features, plan).collect()}
    assert {u for u, _ in r} == {"follows", "switched", "noise"}
    assert {("follows", "f"), ("switched", "g")} <= {k for k, x in r.items() if x.significant} and r[("follows", "f")].delay == 5
    still = P.significance(frame(spark, units), features, P.Plan(second=400)).filter("significant").collect()
    assert {(x.unit, x.feature) for x in still} == {("switched", "g")}
    skipped = P.significance(frame(spark, units), features, P.Plan(second=400, window=10, skip_delays=("f",)))
    assert {x.delay for x in skipped.filter("feature = 'f'").collect()} == {0}
    same = P.significance(frame(spark, units), frame(spark, units), P.Plan(first=20, second=50), same=True).select("unit", "feature").collect()
    assert {tuple(x) for x in same} == {("follows", "noise"), ("follows", "switched"), ("noise", "switched")}
    raw = frame(spark, {k: np.abs(v) for k, v in units.items()})
    done = {(x.unit, x.feature): x for x in P.finished(P.significance(frame(spark, units), features, plan), frame(spark, units), features, raw).collect()}
    assert done[("switched", "g")].signal_ratio > 1 and 0 < done[("switched", "g")].rel_me_beh < 1


def test_anti_selective_pairs_are_revoked(spark):
    rng = np.random.default_rng(2)
    g = (rng.random(500) > 0.5).astype(float)
    u = {"less": 3 - 2 * g + 0.3 * rng.normal(size=500)}
    features = frame(spark, {"g": g}, "discrete")
    t = P.significance(frame(spark, u), features, P.Plan(second=300))
    assert t.first().significant
    x = P.finished(t, frame(spark, u), features, frame(spark, u)).first()
    assert x.signal_ratio < 1 and not x.significant


def test_many_blocks_give_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 3)
    rng = np.random.default_rng(3)
    u, f = {f"u{k}": rng.normal(size=40) for k in range(10)}, {f"f{k}": rng.normal(size=40) for k in range(7)}
    got = P.at_all_shifts(frame(spark, u), frame(spark, f), "pearson").collect()
    assert len(got) == 70 == len({(x.unit, x.feature) for x in got})
    for x in got[:5]:
        assert np.allclose(x["values"], [np.corrcoef(u[x.unit], np.roll(f[x.feature], s))[0, 1] for s in range(40)])


def test_shifts():
    assert sorted(P.drawn(50, 80, 7)) == list(range(50))  # no more shuffles than places
    s = P.drawn(500, 200, 7, delay=30, margin=40)
    assert (((s - 30) % 500 >= 40) & ((s - 30) % 500 < 460)).all()
    with pytest.raises(ValueError):
        P.metric_by_name("none such")
    P.register("twice", lambda a, b: 2 * P.pearson(a, b))
    assert P.metric_by_name("twice")


def test_gaps_missing_values_and_empty(spark):
    df = spark.createDataFrame([("a", "continuous", 0, t, float(t * t % 7)) for t in range(20)] + [("gap", "continuous", 0, t, 1.0 * t) for t in (0, 1, 3)] + [("null", "continuous", 0, 0, None)], "key string, kind string, dim int, t bigint, x double")
    assert {x.unit for x in P.at_all_shifts(df, df).collect()} == {"a"}
    assert P.significance(df.limit(0), df).count() == 0


def test_outcomes(spark):
    #      mi_1, mi_2, cmi_1, cmi_2
    cases = {
        "shared, first beaten": ((0.1, 0.5, 0.01, 0.3), 1.0), "shared, second beaten": ((0.5, 0.1, 0.3, 0.01), 0.0), "both stay": ((0.5, 0.5, 0.45, 0.45), 0.5),
        "first left with little": ((0.5, 0.6, 0.04, 0.5), 1.0), "both left with little": ((0.5, 0.4, 0.01, 0.01), 0.0), "second tells nothing": ((0.3, 0.0, 0.4, 0.1), 0.0),
        "second dominates": ((0.1, 0.4, 0.1, 0.5), 1.0), "nothing": ((0.0, 0.0, 0.0, 0.0), 0.5),
    }
    df = spark.createDataFrame([(k, "a", "b", *map(float, v)) for k, (v, _) in cases.items()], "unit string, f1 string, f2 string, mi_1 double, mi_2 double, cmi_1 double, cmi_2 double")
    d = P.disentangled(df)
    assert {x.unit: x.outcome for x in d.collect()} == {k: w for k, (_, w) in cases.items()}
    m = {(x.feature_a, x.feature_b): (x.score, x.n) for x in P.disentanglement_matrix(d).collect()}
    assert m[("a", "b")][0] + m[("b", "a")][0] == len(cases) == m[("a", "b")][1]
    free = spark.createDataFrame([("a", "b")], "f1 string, f2 string")
    assert {x.outcome for x in P.disentangled(df, free).collect()} == {0.5}
    assert ("second dominates", "a") in {tuple(x) for x in P.losers(d).collect()}
