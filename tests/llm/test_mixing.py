import math
import random

import pytest

from tessella.llm import mixing, queries, tokens

TARGETS = [("big", 0.6, 1), ("mid", 0.3, 2), ("tiny", 0.1, 4), ("gone", 0.05, 3)]


def docs(spark):
    rows = [(i, f"the speech number {i} " * (1 + i % 7), "big" if i % 3 else "mid") for i in range(600)] + [(1000 + i, "short words here " * 5, "tiny") for i in range(6)]
    rows += [(2000, "", "big"), (2001, None, "mid"), (2002, "x y z", None), (2003, "x y z", "other")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as tokens", "2 as place")


def test_a_scarce_source_stays_at_its_limit_and_holds_nothing_back(spark):
    d, t = docs(spark), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    r = {x.source: x for x in mixing.reached(d, t).collect()}
    assert r["gone"].taken == 0 and r["gone"].bound == "absent" and set(r) == {"big", "mid", "tiny", "gone"}
    assert r["tiny"].bound == "repeats" and 0 < r["tiny"].exponent < 1 and r["tiny"].most_repeats == 4 and r["tiny"].taken == 4 * r["tiny"].available
    assert r["mid"].bound == r["big"].bound == "target" and abs(r["big"].taken / r["mid"].taken - 2) < 0.05
    total, there = sum(x.taken for x in r.values()), sum(r[s].available for s in ("big", "mid", "tiny"))
    assert abs(total / there - 1) < 0.01  # as many tokens as there are
    assert abs(r["big"].share - (1 - (r["mid"].taken + r["tiny"].taken) / total)) < 1e-9 and all(abs(x.share - x.weight) < 0.005 for x in r.values())
    assert r["big"].left_out == r["big"].available - r["big"].taken
    m = mixing.mix(d, t).toPandas()
    assert m.groupby(["doc_id", "pass"]).size().max() == 1 and m.groupby("doc_id").size().max() <= 4
    m = m.sort_values("place")
    half = m.iloc[: len(m) // 2].groupby("source").tokens.sum()
    assert abs(half["big"] / half.sum() - r["big"].share) < 0.05  # every stretch is mixed
    again = mixing.mix(d.repartition(3), t).toPandas().sort_values("place")
    assert again.doc_id.tolist() == m.doc_id.tolist()


def test_exact_shares_on_demand(spark):
    d, t = docs(spark), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    r = {x.source: x for x in mixing.reached(d, t, exact=True).collect()}
    for s, share, most in TARGETS[:3]:
        assert abs(r[s].share - share) < 0.005 and r[s].most_repeats <= most and r[s].bound == "target"
    m = mixing.mix(d, t, exact=True).toPandas()
    assert m[m.source == "tiny"].groupby("doc_id").size().min() >= 2


def level(sizes, targets, repeats, budget):
    """Brute force: shares min(limit, c * target) that add up to 1."""
    s_ = [s for s in targets if sizes.get(s, 0) > 0]
    lim = {s: repeats[s] * sizes[s] / budget for s in s_}
    lo, hi = 0.0, 1e9
    for _ in range(300):
        c = (lo + hi) / 2
        lo, hi = (c, hi) if sum(min(lim[s], c * targets[s]) for s in s_) < 1 else (lo, c)
    return {s: min(lim[s], lo * targets[s]) for s in s_}


def test_weights_are_the_nearest_to_the_targets_that_the_limits_allow():
    rng = random.Random(1)
    for _ in range(300):
        names = "abcdefg"[: rng.randint(1, 7)]
        sizes, repeats = {s: int(10 ** rng.uniform(1, 6)) for s in names}, {s: rng.randint(1, 6) for s in names}
        targets = {s: rng.random() + 0.01 for s in names}
        budget = sum(sizes.values()) * rng.choice([1, 0.5, 1.3])
        w, b = mixing.mix_weights(sizes, targets, repeats, budget)
        b0 = min(budget, sum(repeats[s] * sizes[s] for s in names))
        want = level(sizes, targets, repeats, b0)
        assert b == pytest.approx(b0) and sum(x.share for x in w.values()) == pytest.approx(1)
        for s in names:
            assert w[s].share == pytest.approx(want[s], rel=1e-6) and w[s].share * b <= repeats[s] * sizes[s] * (1 + 1e-9)


def test_the_registered_queries_bisect(spark, monkeypatch):
    seen = []
    real = mixing.mix_weights
    monkeypatch.setattr(mixing, "mix_weights", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    assert queries.p8_shares(spark, "/root/testdata/sf0.001").count() == 7
    assert any(0 < x.exponent < 1 and x.bound == "repeats" for x in seen[0][0].values())


def test_budgets():
    sizes, targets, repeats = {"a": 1000, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}
    w, b = mixing.mix_weights(sizes, targets, repeats, exact=True)
    assert w["a"].share == w["b"].share == 0.5 and b == 400
    w, b = mixing.mix_weights(sizes, targets, repeats, 800)
    assert b == 800 and w["b"].share * b == pytest.approx(200) and w["b"].bound == "repeats" and 0 < w["b"].exponent < 1
    w, b = mixing.mix_weights(sizes, targets, repeats, 1e9)
    assert b == 1200 and w["a"].share * b == pytest.approx(1000) and w["b"].share * b == pytest.approx(200)
    assert mixing.mix_weights({}, targets, repeats) == ({}, 0.0)


def test_entropy_is_met():
    w = mixing.temperature_weights({"a": 0.9, "b": 0.09, "c": 0.01}, 0.8)
    assert abs(mixing.entropy(w) - 0.8) < 1e-9 and w["a"] > w["b"] > w["c"]
    assert mixing.temperature_weights({"a": 0.9, "b": 0.1}, math.log(2))["a"] == pytest.approx(0.5, abs=1e-6)


def test_empty(spark):
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    assert mixing.mix(docs(spark).limit(0), t).count() == 0
    assert mixing.mix(docs(spark), t.limit(0)).count() == 0


def test_tokens_of_odd_texts():
    path = f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"
    for text in ("", "a", "naïve 日本 😀", "x" * 250_000, "ab cd " * 40_000, "\n \t" * 50):
        at = tokens.offsets(text, path)
        assert len(at) == len(tokens.encode(text, path)) and at == sorted(at) and (not at or at[-1] <= len(text))
