import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import embedding, kinetics, typing


def test_types(spark):
    r = np.random.default_rng(0)
    series = {
        "lick": ((r.random(400) > 0.6).astype(float), ("discrete", "binary")),
        "state": (r.integers(0, 5, 400).astype(float), ("discrete", "categorical")),
        "laps": (np.cumsum(r.integers(0, 2, 400)).astype(float), ("discrete", "count")),
        "speed": (5 * r.normal(size=400), ("continuous", "linear")),
        "headdirection": (np.mod(np.cumsum(np.full(400, 0.11)), 2 * np.pi), ("continuous", "circular")),
        "clock": (np.arange(400) * 0.05, ("discrete", "timeline")),
        "constant": (np.full(60, 3.0), ("discrete", "count")),
        "single": (np.array([0.5]), None),
    }
    df = spark.createDataFrame([(k, t, float(v), k) for k, (x, _) in series.items() for t, v in enumerate(x)], "key string, t bigint, value double, name string").repartition(5)
    got = {x.key: (x.primary_type, x.subtype) for x in typing.infer_types(df).collect()}
    assert set(got) == set(series) and {k: v for k, v in got.items() if k != "single"} == {k: w for k, (_, w) in series.items() if w}
    assert typing.infer_types(df.limit(0)).count() == 0


def test_types_of_rows(spark):
    df = spark.createDataFrame([("a", t, float(t % 2), "x") for t in range(50)] + [("b", 0, None, "y"), ("c", 0, float("nan"), "y")], "key string, t bigint, value double, name string")
    assert [tuple(r)[:4] for r in typing.infer_types(df).collect()] == [("a", "x", "discrete", "binary")]


def cloud(n=400):
    rng = np.random.default_rng(1)
    a = rng.uniform(0, 3, n)
    return np.column_stack([a, rng.uniform(0, 1, n), np.zeros(n)])


def test_scaling_keeps_distances(spark):
    x = cloud()
    p = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "features": x.tolist()}))
    got = embedding.embed(p, p.filter("id % 10 = 0"), "mds", 2).toPandas().sort_values("id")
    y = np.array(got.features.tolist())
    assert np.allclose(embedding.distances(x, x), embedding.distances(y, y), atol=1e-4)


@pytest.mark.parametrize("method", ["isomap", "le", "dmaps", "lle"])
def test_reduction_orders_a_curve(spark, method):
    t = np.linspace(0, 1.5 * np.pi, 300)
    x = np.column_stack([np.cos(t), np.sin(t), 0.01 * np.sin(9 * t)])
    p = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "features": x.tolist()}))
    y = np.array(embedding.embed(p, p.filter("id % 3 = 0"), method, 1, neighbours=6).toPandas().sort_values("id").features.tolist())[:, 0]
    order = np.argsort(np.argsort(y))
    assert abs(np.corrcoef(order, np.arange(300))[0, 1]) > 0.95


@pytest.mark.parametrize("method", ["mds", "isomap", "le", "dmaps", "lle"])
def test_queries_fit_all_rows(spark, tmp_path, method):
    from tessella.plans import models

    x = np.random.default_rng(3).normal(size=(120, 5)) * [4, 3, 1, 1, 1]
    spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(120), "embedding": x.tolist()})).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = getattr(models, f"embedding_{method}")(spark, str(tmp_path)).toPandas().sort_values("id")
    want, _ = embedding.fit(x, method, 2)
    assert np.allclose(got[["x", "y"]].to_numpy(), want, atol=1e-5)


def test_more_points_than_landmarks_are_placed(spark, monkeypatch):
    monkeypatch.setattr(embedding, "MOST_LANDMARKS", 50)
    x = cloud()
    p = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "features": x.tolist()}))
    y = np.array(embedding.embed(p, embedding.landmarks_of(p), "mds", 2).toPandas().sort_values("id").features.tolist())
    assert np.allclose(embedding.distances(x, x), embedding.distances(y, y), atol=1e-4)


def test_kinetics(spark):
    t = np.arange(400)
    k = lambda s: np.where(t >= s, np.exp(-(t - s) / 30.0), 0)
    df = spark.createDataFrame([("a", int(i), float(v)) for i, v in zip(t, 3 * k(100) + 0.0)], "key string, t bigint, value double")
    ev = spark.createDataFrame([("a", 98, 112)], "key string, start bigint, end bigint")
    r = kinetics.decay_constants(df, ev, 20.0).first()
    assert r.tau == pytest.approx(1.5, abs=1e-6) and r.r2 == pytest.approx(1)
    x = np.arange(0, 10, 1 / 20)
    kern = np.exp(-x / 2.0) - np.exp(-x / 0.25)
    kern /= kern.max()
    y = np.zeros(400)
    for s, a in ((50, 2.0), (70, 1.0), (300, 0.5)):
        m = min(len(kern), 400 - s)
        y[s : s + m] += a * kern[:m]
    sig = spark.createDataFrame([("a", int(i), float(v)) for i, v in enumerate(y)], "key string, t bigint, value double")
    on = spark.createDataFrame([("a", 50), ("a", 70), ("a", 200), ("a", 300)], "key string, onset bigint")
    got = {r.onset: r.amplitude for r in kinetics.onset_amplitudes(sig, on, 20.0).collect()}
    assert got[50] == pytest.approx(2, abs=0.1) and got[70] == pytest.approx(1, abs=0.1) and got[200] == pytest.approx(0, abs=0.05)


def test_nearest_neighbour_information():
    rng = np.random.default_rng(0)
    x = rng.normal(size=1500)
    y = 0.8 * x + 0.6 * rng.normal(size=1500)
    assert kinetics.ksg(x, y) == pytest.approx(-0.5 * math.log2(1 - 0.64), abs=0.1)
    assert kinetics.ksg(x, rng.normal(size=1500)) < 0.05


def test_streaming_equals_batch(spark, tmp_path):
    from tessella.streaming import windows

    rows = [(i, f"2024-01-01 {i % 24:02d}:{i % 60:02d}:00", i % 3, "a" if i % 2 else "b", float(i % 100)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    (f,) = (tmp_path / "events.parquet").glob("part-*.parquet")
    f.rename(tmp_path / "one.parquet")
    for x in (tmp_path / "events.parquet").iterdir():
        x.unlink()
    (tmp_path / "events.parquet").rmdir()
    (tmp_path / "one.parquet").rename(tmp_path / "events.parquet")
    s = windows.tumbling(windows.events_stream(spark, str(tmp_path)), "6 hours", "1 hour", ["event_type"])
    got = {(str(r.window.start), r.event_type): r.n for r in windows.caught_up(s, ["window", "event_type"]).collect()}
    want = {(str(r.window.start), r.event_type): r.n for r in df.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want
    ses = windows.caught_up(windows.sessions(windows.events_stream(spark, str(tmp_path)), "2 hours", "1 hour", ["user_id"]), ["session_window", "user_id"], "append")
    assert ses.columns[:2] == ["session_window", "user_id"]


def test_decoder_and_alignment(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 3))
    y = x @ [1.0, -2.0, 0.5] + 3
    p = spark.createDataFrame(pd.DataFrame({"id": np.arange(500), "features": x.tolist(), "y": y}))
    r = embedding.linear_decoder(p, "y").first()
    assert (r.n_train, r.n_test) == (400, 100) and r.r2 == pytest.approx(1, abs=1e-6) and r.mean_error < 1e-4
    a = rng.uniform(0, 2 * np.pi, 200)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": -(a - np.pi / 3)}))
    r = embedding.circular_alignment(df, "a", "b").first()
    assert r.reflected and r.offset == pytest.approx(np.pi / 3) and r.error < 1e-6


def test_hyperbolicity_of_a_tree_and_a_ring(spark):
    from tessella.operators.graph import hyperbolicity

    tree = spark.createDataFrame([(k, k // 2, 1.0) for k in range(2, 16)], "src bigint, dst bigint, w double")
    assert hyperbolicity(tree, 3000).first().mean == 0
    ring = spark.createDataFrame([(k, (k + 1) % 12, 1.0) for k in range(12)], "src bigint, dst bigint, w double")
    assert hyperbolicity(ring, 3000).first().mean > 0.5


def test_ridge_events_find_transients_and_not_noise(spark):
    from tessella.operators import wavelet

    rng = np.random.default_rng(6)
    t = np.arange(1500)
    x = 0.02 * rng.normal(size=1500)
    onsets = (200, 520, 900, 1250)
    for s in onsets:
        x += np.where(t >= s, np.exp(-(t - s) / 25.0) - np.exp(-(t - s) / 4.0), 0)
    df = spark.createDataFrame(pd.DataFrame({"key": "a", "t": t, "value": x}))
    whole = wavelet.events(df).toPandas()
    assert len(whole) >= 4 and all(((whole.peak > s) & (whole.peak < s + 40)).any() for s in onsets)
    assert all(min(abs(p - s - 12) for s in onsets) < 45 for p in whole.peak)
    cut = wavelet.events(df, chunk=600, margin=300).toPandas()
    assert set(cut.peak) == set(whole.peak)
    assert wavelet.events(df.limit(0)).count() == 0


def test_small_world_of_a_ring_lattice(spark):
    from tessella.operators.graph import small_world

    ring = spark.createDataFrame([(k, (k + d) % 60, 1.0) for k in range(60) for d in (1, 2)], "src bigint, dst bigint, w double")
    r = small_world(ring).first()
    assert r.clustering == pytest.approx(0.5) and r.length == pytest.approx(sum(-(-d // 2) for d in [*range(1, 31), *range(1, 30)]) / 59)
    assert r["index"] > 1
    assert small_world(ring.limit(0)).first()["index"] is None


def test_rise_hooks_and_entropy(spark):
    t = np.arange(200)
    x = np.where(t >= 100, 2 * (1 - np.exp(-(t - 100) / 6.0)), 0.0) * np.exp(-np.maximum(t - 100, 0) / 60.0)
    df = spark.createDataFrame(pd.DataFrame({"key": "a", "t": t, "value": x}))
    ev = spark.createDataFrame([("a", 101, 140)], "key string, start bigint, end bigint")
    assert 0.05 < kinetics.rise_constants(df, ev, 20.0, 30).first().tau < 0.9
    assert kinetics.rise_constants(df, ev.limit(0), 20.0).count() == 0
    out = kinetics.reconstructed(df, lambda t, v: v * 2).toPandas().sort_values("t")
    assert np.allclose(out.value, 2 * x)
    with pytest.raises(Exception, match="one value per place"):
        kinetics.reconstructed(df, lambda t, v: v[:3]).count()
    rng = np.random.default_rng(0)
    e = spark.createDataFrame([(rng.uniform(0, 4, 3000).tolist(),), (rng.normal(size=3000).tolist(),), ([1.0],)], "v array<double>").select(kinetics.neighbour_entropy("v", F.lit(5)).alias("e")).collect()
    assert abs(e[0].e - 2) < 0.1 and abs(e[1].e - 0.5 * math.log2(2 * math.pi * math.e)) < 0.1 and e[2].e is None


def test_clusters_and_curves_by_the_iterative_methods(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(3, 6)) * 8
    x = np.concatenate([c + rng.normal(size=(40, 6)) for c in centres])
    label = np.repeat(range(3), 40)
    p = spark.createDataFrame(pd.DataFrame({"id": np.arange(120), "features": x.tolist()}))
    for method in ("tsne", "umap"):
        y = np.array(embedding.embed(p, embedding.landmarks_of(p), method, 2, neighbours=10).toPandas().sort_values("id").features.tolist())
        d = embedding.distances(y, y) + np.diag(np.full(120, np.inf))
        assert np.isfinite(y).all() and (label[d.argmin(axis=1)] == label).mean() > 0.95
    t = rng.uniform(0, 1.5 * np.pi, 300)
    curve = np.column_stack([np.cos(t), np.sin(t), 0.3 * t])
    y = embedding.fit(curve, "hlle", 1, neighbours=16)[0][:, 0]
    assert abs(np.corrcoef(np.argsort(np.argsort(y)), np.argsort(np.argsort(t)))[0, 1]) > 0.95


def test_decoders(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(-1, 1, size=(1200, 3))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(1200), "features": x.tolist(), "px": (x[:, 0] > 0).astype(float), "py": rng.normal(size=1200)}))
    r = {v.target: v for v in embedding.forest_decoder(df, ["px", "py"]).collect()}
    assert r["px"].r2 > 0.7 and r["py"].r2 < 0.1 and r["px"].n_train + r["px"].n_test == 1200
    a = rng.uniform(0, 2 * np.pi, 500)
    turned = spark.createDataFrame(pd.DataFrame({"a": a, "b": np.mod(1.0 - a, 2 * np.pi), "held": np.arange(500) % 4 == 0}))
    q = embedding.alignment_quality(turned, "a", "b", "held").first()
    assert q.reflected and q.train_error < 0.01 and q.test_error < 0.01 and abs(q.offset - 1.0) < 0.02
