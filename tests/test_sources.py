import numpy as np

from tessella.sources import synthetic, tables
from tessella.sources.arrays import ArrayArchive


def test_array_archives(spark, tmp_path):
    np.savez(tmp_path / "a.npz", calcium=np.arange(12.0).reshape(2, 6), speed=np.arange(6), label=np.array(["x"]), bad=np.array([{}], dtype=object))
    spark.dataSource.register(ArrayArchive)
    df = spark.read.format("arrays").load(str(tmp_path)).toPandas()
    assert set(df.name) == {"calcium", "speed"} and len(df) == 18
    assert df[(df.name == "calcium") & (df.component == 1)].sort_values("t").value.tolist() == [6, 7, 8, 9, 10, 11]


def test_cell_tables(spark, tmp_path):
    (tmp_path / "EXP_M1_1D.csv").write_text('neuron,place,speed\n0,"{\'me\': np.float64(0.5), \'pval\': 1e-4, \'opt_delay\': -3, \'signal_ratio\': nan}",\n1,"{\'me\': 0.1}","broken"\n')
    stats = tables.cell_table(spark, str(tmp_path), tables.STATS)
    got = {(r.mouse, r.session, r.neuron_idx, r.feature): r.cell for r in stats.collect()}
    assert got[("M1", "1D", 0, "place")].me == 0.5 and got[("M1", "1D", 0, "place")].signal_ratio is None
    sig = stats.limit(0)
    sig = tables.cell_table(spark, str(tmp_path), tables.SIGNIFICANCE)
    rows = tables.tidy_pairs(stats, sig).filter("neuron_idx = 0 and feature = 'place'").collect()
    assert rows[0].significant is False and rows[0].delay_sign == -1


def test_matching_and_results(spark, tmp_path):
    (tmp_path / "M1.csv").write_text("1,0\n2,3\n\n0,4\n")
    m = tables.matching_table(spark, str(tmp_path / "*.csv"), ["1D", "2D"])
    assert {(r.mouse, r.matched_id, r.session, r.neuron_idx) for r in m.collect()} == {("M1", 0, "1D", 1), ("M1", 1, "1D", 2), ("M1", 1, "2D", 3), ("M1", 3, "2D", 4)}
    tables.write_results({"m": m}, str(tmp_path / "out"), {"m": ["session"]})
    tables.write_results({"m": m.limit(0)}, str(tmp_path / "out"))  # there already: left alone
    assert tables.read_results(spark, str(tmp_path / "out"), ["m"])["m"].count() == 4


def test_synthetic_population_is_seeded_and_scored(spark):
    a, b = synthetic.tuned_units(spark, 4, 200).toPandas(), synthetic.tuned_units(spark, 4, 200).toPandas()
    key = ["unit_id", "t"]
    assert np.allclose(a.sort_values(key).value, b.sort_values(key).value) and set(a.tuned_to) == {"direction", "speed", "rest", "none"}
    f = spark.createDataFrame([(1,), (2,)], "k int")
    s = synthetic.score(f, spark.createDataFrame([(2,), (3,)], "k int"), ["k"]).first()
    assert (s.tp, s.fp, s.fn, s.f1) == (1, 1, 1, 0.5)
