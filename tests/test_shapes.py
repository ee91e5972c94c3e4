import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import names
from tessella.operators import conditional, manifold, relational, shapes
from tessella.operators import pairing as P
from tessella.session import shared_dir
from tessella.sources import arrays, synthetic, tables


def test_masks_are_widened_and_cut(spark):
    ev = spark.createDataFrame([("a", 10, 12), ("a", 1, 2), ("a", 40, 80), ("b", 5, 11)], "key string, start long, end long")
    m = {k: sorted(r.t for r in x) for k, x in __import__("itertools").groupby(sorted(shapes.event_mask(ev, 6, 15).collect(), key=lambda r: r.key), lambda r: r.key)}
    assert m["a"] == [*range(0, 4), *range(8, 14), *range(40, 55)] and m["b"] == list(range(5, 11))
    assert shapes.event_mask(ev.limit(0), 6, 15).count() == 0


def test_intervals_and_values_change_places_only(spark):
    t = np.cumsum(np.random.default_rng(0).integers(1, 9, 40))
    ev = spark.createDataFrame([("a", int(k), float(v)) for v, k in enumerate(t)], "key string, t long, value double")
    got = shapes.shuffled_intervals(ev, 10_000).toPandas().sort_values("t")
    assert sorted(np.diff(got.t)) == sorted(np.diff(t)) and sorted(got.value) == list(range(40)) and got.value.tolist() != list(range(40))
    assert shapes.shuffled_intervals(ev, 50).toPandas().t.max() < 50


def test_phase_of_a_sine(spark):
    t = np.arange(101)
    df = spark.createDataFrame(pd.DataFrame({"key": "a", "t": t, "value": np.cos(2 * np.pi * 5 * t / 101)}))
    p = shapes.phases(df).toPandas().sort_values("t")
    assert np.allclose(p.amplitude, 1, atol=1e-9) and np.allclose(np.cos(p.phase), np.cos(2 * np.pi * 5 * t / 101), atol=1e-9)


def test_a_small_event_beside_large_ones_is_found_in_a_later_pass(spark):
    rng = np.random.default_rng(3)
    x, k = 0.02 * rng.normal(size=2000), np.array(shapes.unit_kernel(100, 20.0, 0.25, 2.0))
    for s, a in ((200, 3.0), (700, 3.0), (1300, 3.0), (745, 1.5), (1340, 1.5)):
        x[s : s + 100] += a * k
    df = spark.createDataFrame(pd.DataFrame({"key": "a", "t": np.arange(2000), "value": x}))
    one, three = shapes.iterative_events(df, 1, n_mad=12), shapes.iterative_events(df, 3, n_mad=12)
    assert one.count() >= 3 and three.count() > one.count() and {r["pass"] for r in three.collect()} > {1}


def test_fields_are_connected_in_four_directions(spark):
    cells = [(0, 0), (0, 1), (1, 1), (3, 3), (4, 4), (4, 5)]
    rows = [(x, y, 10, 5.0 if (x, y) in cells else 0.1) for x in range(7) for y in range(7)]
    m = spark.createDataFrame(rows, "bin_x int, bin_y int, n long, rate double")
    f = {r.bins: r for r in shapes.connected_fields(m, 1.5, 1, 1.0).collect()}
    assert set(f) == {3, 1, 2} and f[3].centre_x == pytest.approx(1 / 3)
    assert shapes.connected_fields(m, 1.5, 3, 1.0).count() == 1 and shapes.connected_fields(m.limit(0)).count() == 0
    s = shapes.smoothed_rates(m.filter("bin_x < 3"), 1.0, 1).toPandas()
    assert len(s) == 21 and s.rate.max() < 5


def test_neighbours_within_a_radius_and_by_any_metric(spark):
    x = np.random.default_rng(1).normal(size=(60, 3))
    p = spark.createDataFrame(pd.DataFrame({"id": np.arange(60), "features": x.tolist()})).repartition(4)
    q = p.filter("id < 10")
    d = np.abs(x[:10, None] - x[None]).sum(2)
    d[np.arange(10), np.arange(10)] = np.inf
    got = {(r.query, r.rank): r.id for r in manifold.nearest_by(p, q, 3, "cityblock").collect()}
    assert got == {(i, r + 1): int(np.argsort(d[i])[r]) for i in range(10) for r in range(3)}
    assert manifold.within(p, q, 1.5, "cityblock").count() == (d <= 1.5).sum()
    assert {(r.query, r.n) for r in manifold.counts_within(p, q, [1.5], lambda a, b: np.abs(a[:, None] - b[None]).sum(2)).collect()} == {(i, int((d[i] <= 1.5).sum())) for i in range(10)}
    assert manifold.nearest_by(p, q.limit(0), 3, "cosine").count() == 0
    with pytest.raises(ValueError):
        manifold.within(p, q, 1.0, "none such")
    assert manifold.stress(p, p, q).first().stress == 0
    plane = np.random.default_rng(2).uniform(size=(400, 2))
    z = spark.createDataFrame(pd.DataFrame({"id": np.arange(400), "features": plane.tolist()}))
    assert abs(manifold.correlation_dimension(z, z.filter("id % 4 = 0"), 0.05, 0.15).first().dimension - 2) < 0.25


def test_conditional_information_of_known_cases(spark):
    rng = np.random.default_rng(4)
    n = 4000
    z, k = rng.normal(size=n), rng.integers(0, 3, n)
    x, y = z + rng.normal(size=n), z + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": z, "k": k, "w": x + y + k, "g": (x > 0).astype(int)}))
    assert conditional.given_normal(df, [], "x", "y", "z").first().cmi < 0.01  # only z joins them
    assert conditional.given_normal(df, [], "x", "w", "z").first().cmi > 0.2
    assert conditional.given_class(df, [], "x", "y", "k").first().cmi == pytest.approx(-0.5 * math.log2(1 - 0.25), abs=0.05)
    assert conditional.class_given_normal(df, [], "x", "k", "z").first().cmi < 0.01 < 0.3 < conditional.class_given_normal(df, [], "x", "g", "z").first().cmi
    assert conditional.class_given_class(df, [], "w", "k", "g").first().cmi > 0.1 > 0.02 > conditional.class_given_class(df, [], "x", "k", "g").first().cmi
    with pytest.raises(ValueError):
        conditional.correlations_of_many(df, ["x", "y"])


def test_predicates_exclusions_sheets(spark, tmp_path):
    fact = spark.createDataFrame([("A", 1, 0.5), ("A", 2, float("nan")), ("B", 1, None), ("C", 3, 0.1)], "mouse string, matched_id int, me double")
    assert relational.where_all(fact, [("me", ">", 0.2)]).count() == 1
    assert relational.where_all(fact, [("gone", "=", 1)], allow_missing=True).count() == 0
    with pytest.raises(KeyError):
        relational.where_all(fact, [("gone", "=", 1)])
    with pytest.raises(ValueError):
        relational.where_all(fact, [("me", "~", 1)])
    x = relational.Exclusions(spark).add(fact.filter("mouse = 'A' and matched_id = 1")).add(spark.createDataFrame([("B", None)], "mouse string, matched_id int"))
    x.save(str(tmp_path / "x"))
    back = relational.Exclusions.load(spark, str(tmp_path / "x"))
    assert {(r.mouse, r.matched_id) for r in back.applied(fact).collect()} == {("A", 2), ("C", 3)}
    assert back.remove(spark.createDataFrame([("B", None)], "mouse string, matched_id int")).applied(fact).count() == 3
    sheet = spark.createDataFrame([("A", "left"), ("A", "also"), (None, "none")], "mouse string, side string")
    assert sorted((r.mouse, r.side) for r in relational.annotated(fact, sheet, ["mouse"]).select("mouse", F.coalesce("side", F.lit("")).alias("side")).collect()) == [("A", "also"), ("A", "also"), ("B", ""), ("C", "")]


def test_sources(spark, tmp_path):
    df = arrays.from_arrays(spark, {"a": np.arange(3.0), "b": np.array([[1.0, np.nan], [2.0, 3.0]])})
    assert {(r.name, r.component, r.t, r.value) for r in df.collect()} == {("a", 0, 0, 0.0), ("a", 0, 1, 1.0), ("a", 0, 2, 2.0), ("b", 0, 0, 1.0), ("b", 1, 0, 2.0), ("b", 1, 1, 3.0)}
    with pytest.raises(ValueError):
        arrays.from_arrays(spark, {"c": np.zeros((2, 2, 2))})
    calls = []
    for _ in range(2):
        assert tables.built(spark, str(tmp_path / "t"), lambda: calls.append(1) or df).count() == 6
    assert calls == [1]
    tables.write_json(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), str(tmp_path / "j"))
    assert '{"a":1,"b":null}' in "".join(r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    (tmp_path / "M1.csv").write_text("1;0\n2;3\n")
    assert {(r.session, r.neuron_idx) for r in tables.matching_table(spark, str(tmp_path / "M1.csv"), ["1D", "2D"]).collect()} == {("1D", 1), ("1D", 2), ("2D", 3)}
    row = spark.createDataFrame([("place_2d", None)], "f string, g string").select(names.twin_name(F.col("f")), names.parent_name(F.col("f")), names.row_hash(F.col("f"), F.col("g")), names.row_hash(F.col("f"), F.lit(""))).first()
    assert row[0] == "place_2d" and row[1] == "place" and row[2] != row[3]


def test_a_cluster_without_shared_folder_is_an_error():
    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_a_synthetic_population_is_found_again(spark):
    units, features = synthetic.tuned_units(spark, 8, 20_000), synthetic.feature_rows(spark, 20_000)
    u = P.tagged(units, F.col("unit_id").cast("string"), F.col("t"), F.col("value"), "continuous")
    kind = lambda f, k: P.tagged(features.filter(F.col("feature") == f), F.col("feature"), F.col("t"), F.col("value"), k)
    a = features.filter("feature = 'direction'")
    turn = P.tagged(a, F.col("feature"), F.col("t"), F.cos("value"), "continuous", 0).unionByName(P.tagged(a, F.col("feature"), F.col("t"), F.sin("value"), "continuous", 1))
    found = P.significance(u, kind("speed", "continuous").unionByName(kind("rest", "discrete")).unionByName(turn), P.Plan(second=400)).filter("significant").select("unit", "feature")
    truth = units.select(F.col("unit_id").cast("string").alias("unit"), F.col("tuned_to").alias("feature")).distinct().filter("feature <> 'none'")
    s = synthetic.score(found, truth, ["unit", "feature"]).first()
    assert s.sensitivity >= 0.5 and s.precision >= 0.7, s
