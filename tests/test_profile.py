from datetime import datetime

from tessella.operators.profile import PLAIN, Rule, profile, suspect_loads

RULES = {"n": Rule(1), "d": Rule(0, low_open=True, pattern=PLAIN)}


def test_profile_counts_and_suspects(spark):
    rows = [(1, 10 + i % 20, f"{100 + i}.5", datetime(2014, 1, 1)) for i in range(40)]
    rows += [(2, 10 + i % 20, "nan" if i < 10 else f"{100 + i}.5", None) for i in range(40)]
    rows += [(3, 0 if i == 0 else 10 + i % 20, "2 min" if i == 1 else f"{100 + i}", None) for i in range(40)]
    rows += [(4, 100 + i, str(300 + i), None) for i in range(40)]
    rows += [(None, None, " ", None)]
    df = spark.createDataFrame(rows, "load int, n bigint, d string, column_name timestamp_ntz").withColumnRenamed("column_name", "value")
    p = profile(df, "load", rules=RULES)
    got = {(r.load, r.column_name): r for r in p.collect()}
    assert got[(1, "n")].n_distinct == 20 and got[(1, "n")].median == 19.5 and got[(2, "d")].missing_rate == 0.25
    assert got[(3, "d")].n_violations == 1 and got[(3, "n")].n_violations == 1 and got[(None, "n")].n_missing == 1
    assert got[(4, "n")].psi > got[(1, "n")].psi and got[(None, "d")].psi is None
    assert {tuple(r) for r in suspect_loads(p, ["n", "d"], "load").collect()} == {(2, "d"), (3, "n"), (3, "d"), (4, "n"), (4, "d"), (None, "n"), (None, "d")}


def test_psi_equals_definition(spark):
    import math

    rows = [(1, "a1") for _ in range(6)] + [(1, "b") for _ in range(2)] + [(2, "b") for _ in range(4)]
    p = {r.load: r.psi for r in profile(spark.createDataFrame(rows, "load int, s string"), "load").collect()}
    shapes = {1: {"a9": 6, "a": 2}, 2: {"a9": 0, "a": 4}}
    both = {"a9": 6, "a": 6}
    for load, own in shapes.items():
        want = 0.0
        for k in both:
            a, b = (own[k] + 0.5) / (sum(own.values()) + 1), (both[k] + 0.5) / 13
            want += (a - b) * math.log(a / b)
        assert abs(p[load] - want) < 1e-9


def test_empty(spark):
    assert profile(spark.createDataFrame([], "load int, n bigint"), "load").count() == 0
