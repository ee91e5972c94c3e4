import numpy as np
import pandas as pd

from tessella.operators.spikes import BINS, CHUNK, Limits, binned, cutoffs, faults, heights, noise, peaks, season_of


def signal(n, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n) * scale
    for at in range(50, n - 60, 150):  # transients: up at once, slowly back
        x[at:] += 25 * scale * np.exp(-np.arange(n - at) / 20)
    return x


def test_spikes_stuck_and_impossible_are_found_and_nothing_else(spark):
    rows, want = [], set()
    for u in range(6):
        n = CHUNK + 300 if u == 0 else 900
        x = signal(n, u, 10.0**-u)
        x[n // 2 :] += 40 * 10.0**-u  # a lasting shift
        for at, run in ((30, 1), (140, 2), (230, 3), (CHUNK - 1 if u == 0 else 700, 2)):
            x[at : at + run] += (-1) ** run * 60 * 10.0**-u
            want |= {(str(u), t) for t in range(at, at + run)}
        x[320:335] = x[320]
        want |= {(str(u), t) for t in range(320, 335)}
        x[850] = np.inf
        want.add((str(u), 850))
        rows += [(u, t, v) for t, v in enumerate(x)]
        rows += [(u, 30, x[30]), (u, 100, None), (u, 325, float("nan"))]  # delivered twice, missing
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["unit", "t", "v"]), "unit int, t bigint, v double")
    got = {(r.source_id, r.t) for r in faults(df, "unit", "t", "v", Limits()).collect()}
    assert got == want


def test_constant_short_and_empty_sources(spark):
    rows = [("const", t, 5.0) for t in range(60)] + [("one", 0, 1.0)] + [(None, 1, 1.0), ("x", None, 1.0), ("gone", 1, None)]
    rows += [("spiky", t, 20.0 if t != 30 else 55.0) for t in range(60)]
    df = spark.createDataFrame(rows, "s string, t bigint, v double")
    assert {(r.source_id, r.t) for r in faults(df, "s", "t", "v", Limits(stuck=6)).collect()} == {("spiky", 30)}
    assert faults(df.limit(0), "s", "t", "v").count() == 0


def test_a_season_is_found_and_taken_off(spark):
    rng = np.random.default_rng(0)
    t = np.arange(2000)
    x = 50.0 * (t % 4 == 0) + rng.normal(size=2000)
    y = 30.0 * (t % 24 == 5) - 40.0 * (t % 24 == 6) + rng.normal(size=2000)
    x[1001] += 30
    y[700] += 25
    y[1400] -= 40
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"s": s, "t": t, "v": v}) for s, v in (("a", x), ("b", y))]))
    want = {("a", 1001), ("b", 700), ("b", 1400)}
    assert {(r.source_id, r.t) for r in faults(df, "s", "t", "v").collect()} == want
    assert {(r.source_id, r.t) for r in faults(df.filter("s = 'a'"), "s", "t", "v", season=4).collect()} == {("a", 1001)}
    noise = rng.normal(size=2000)
    assert season_of(t, noise, 1.0) == 0 and season_of(t, x, 1.0) % 4 == 0 and season_of(t, y, 1.0) == 24


def test_the_cutoff_follows_the_tail_of_the_source_and_not_its_spikes():
    rng = np.random.default_rng(3)
    n = 200_000
    at = {}
    for name, x in {"uniform": rng.uniform(-1, 1, n), "normal": rng.normal(size=n), "laplace": rng.laplace(size=n)}.items():
        dirty = x.copy()
        dirty[rng.choice(n, 600, replace=False)] += 60 * noise(x, 0.0)
        for kind, v in (("", x), ("dirty", dirty)):
            bins, k = binned(peaks(heights(v, noise(v, 0.0), 0.35)))
            at[name + kind] = cutoffs(bins, k, n, np.zeros(BINS), 1e-6)
        sound = heights(x, noise(x, 0.0), 0.35)
        assert (sound > at[name]).mean() < 2e-5  # the risk, told from a fifth of a million readings
        assert abs(at[name + "dirty"] / at[name] - 1) < 0.1
    assert at["uniform"] < at["normal"] < at["laplace"]
    # with lower risk the cutoff rises
    assert cutoffs(bins, k, n, np.zeros(BINS), 1e-4) < cutoffs(bins, k, n, np.zeros(BINS), 1e-8)


def test_short_sources_lean_on_their_field(spark):
    rng = np.random.default_rng(4)
    rows = [(f"long{u}", t, v) for u in range(20) for t, v in enumerate(rng.laplace(size=1500))]
    rows += [(f"short{u}", t, v) for u in range(8) for t, v in enumerate(np.append(rng.laplace(size=4), np.append([200.0], rng.laplace(size=4))))]
    rows += [("three", 0, 1.0), ("three", 1, 2.0), ("three", 2, 1.0), ("two", 0, 1.0), ("two", 1, 900.0)]
    df = spark.createDataFrame([(s, t, float(v)) for s, t, v in rows], "s string, t bigint, v double")
    got = {(r.source_id, r.t) for r in faults(df, "s", "t", "v").collect()}
    assert {(f"short{u}", 4) for u in range(8)} <= got and not {s for s, _ in got} & {"three", "two"} and len(got) <= 9
