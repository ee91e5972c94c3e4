"""Sources mixed to target shares of tokens.

Weights come from temperature mixing: between the sources' natural token shares q and the targets t
lies the family w(x) ~ q (t / q)^x, natural at x = 0, the targets at x = 1. The budget is the number
of tokens there are, unless another is given. From the natural shares on the exponent is raised as
far as the repetition limits allow, by bisection; a source that reaches its limit stays at it and
the exponent goes on rising over the others, until these have their targets or are at their limits
too. So a scarce source neither holds back the others nor the size of the mix. With exact=True the
mix is instead the largest one in which every source has just its target. The same bisection meets
a target entropy with w(x) ~ q^x (temperature_weights).

The weights are realised as permutations of blocks: every pass over a source takes its blocks in an
order of its own, and passes go on until the source's budget of tokens is used up; only the last
pass is partial. Running token sums come from the distributed order, so no source passes through
one task.

Defined results
- documents without source, of a source without target, or without tokens take no part
- a source without documents has no share; the others' targets are raised in proportion
- a source ends with the document that brings its sum closest to its budget
- the same rows, targets and seed give the same mix; an empty table gives an empty mix
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import tokens
from tessella.operators.ordering import _join, offsets, sorted_runs
from tessella.session import cut

#: Tokens of a block.
BLOCK_TOKENS = 50_000
#: Sources that one mix may have; their sums are held by the driver.
MAX_SOURCES = 10_000


def _normal(w: Mapping[str, float]) -> dict[str, float]:
    total = sum(w.values())
    return {k: v / total for k, v in w.items()} if total > 0 else {}


def entropy(w: Mapping[str, float]) -> float:
    return -sum(p * math.log(p) for p in w.values() if p > 0)


def temperature_weights(shares: Mapping[str, float], target_entropy: float, steps: int = 200) -> dict[str, float]:
    """Shares raised to the exponent at which their entropy is the target (0 to log of their number)."""
    q = _normal({k: v for k, v in shares.items() if v > 0})
    lo, hi = 0.0, 64.0  # entropy falls as the exponent grows
    for _ in range(steps):
        mid = (lo + hi) / 2
        if entropy(_normal({k: math.exp(mid * math.log(v)) for k, v in q.items()})) > target_entropy:
            lo = mid
        else:
            hi = mid
    return _normal({k: math.exp(lo * math.log(v)) for k, v in q.items()})


@dataclass(frozen=True)
class Weight:
    """Share of a source, the exponent up to which it was raised towards its target, and what bound
    it: target, repeats (its limit) or nothing there (absent)."""

    share: float
    exponent: float
    bound: str


def mix_weights(sizes: Mapping[str, int], targets: Mapping[str, float], repeats: Mapping[str, int], budget: float | None = None, exact: bool = False, steps: int = 100) -> tuple[dict[str, Weight], float]:
    """Weights of the sources and the size of the mix in tokens."""
    there = [s for s in sorted(targets) if sizes.get(s, 0) > 0 and targets[s] > 0 and repeats.get(s, 1) > 0]
    t, q = _normal({s: targets[s] for s in there}), _normal({s: float(sizes[s]) for s in there})
    if not t:
        return {}, 0.0
    most = {s: float(repeats.get(s, 1) * sizes[s]) for s in there}
    if exact:
        largest = min(most[s] / t[s] for s in there)
        return {s: Weight(t[s], 1.0, "target") for s in there}, largest if budget is None else min(budget, largest)
    budget = min(float(sum(sizes[s] for s in there)) if budget is None else budget, sum(most.values()))
    limit = {s: most[s] / budget for s in there}
    full: dict[str, float] = {}

    def at(x: float) -> dict[str, float]:
        """Shares at the exponent: full sources at their limit, the rest divided among the others."""
        rest = 1 - sum(limit[s] for s in full)
        return {s: limit[s] for s in full} | {s: p * rest for s, p in _normal({s: q[s] * (t[s] / q[s]) ** x for s in there if s not in full}).items()}

    def beyond(w: Mapping[str, float]) -> list[str]:
        return [s for s in there if s not in full and w[s] > limit[s] * (1 + 1e-12)]

    x = 0.0
    while True:
        # a budget beyond the natural sizes may fill sources before the exponent rises at all
        while over := beyond(at(x)):
            full |= dict.fromkeys(over, x)
        if not beyond(at(1.0)):
            w = at(1.0)
            # the way to the targets isn't straight: a source filled on it may end below its limit
            free = [s for s in there if s not in full]
            scale = sum(w[s] for s in free) / sum(t[s] for s in free) if free else math.inf
            early = [s for s in full if t[s] * scale < limit[s] * (1 - 1e-12)]
            if not early:
                return {s: Weight(w[s], full.get(s, 1.0), "repeats" if s in full else "target") for s in there}, budget
            for s in early:
                del full[s]
            x = 1.0
            continue
        lo, hi = x, 1.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if beyond(at(mid)) else (mid, hi)
        # at lo all limits hold, just after it at least one doesn't
        full |= dict.fromkeys(beyond(at(hi)), lo)
        x = lo


def sized(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of the documents that can take part, written out."""
    some = documents.filter(F.col("source").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "source", "text")
    counted = some.repartition(F.xxhash64("doc_id")).select("doc_id", "source", tokens.count(F.col("text"), path).alias("tokens"))
    return cut(counted.filter(F.col("tokens") > 0))


def plan(docs: DataFrame, targets: DataFrame, budget: float | None = None, exact: bool = False) -> list[tuple]:
    """A row per source, as in _PLAN."""
    rows = targets.filter(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    want = {r.source: float(r.target_share or 0.0) for r in rows}
    most = {r.source: int(r.max_repeats if r.max_repeats is not None else 1) for r in rows}
    sizes = {r.source: int(r.n) for r in docs.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    weights, total = mix_weights(sizes, want, most, budget, exact)
    none = Weight(0.0, 0.0, "absent")
    return [(s, want[s], most[s], sizes.get(s, 0), w.share, w.share * total, w.exponent, w.bound) for s in sorted(want) for w in [weights.get(s, none)]]


_PLAN = "source string, target_share double, max_repeats int, available long, weight double, take double, exponent double, bound string"


def realise(docs: DataFrame, sources: list[tuple], seed: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, source, pass, tokens, place): each copy of a document in the mix; place in [0, 1] is
    where it stands: sorting by it gives a mix whose every stretch has the weights."""
    spark = docs.sparkSession
    small = spark.createDataFrame(sources, _PLAN).filter("take > 0")
    joined = docs.join(F.broadcast(small), "source")
    passes = F.least(F.ceil(F.col("take") / F.col("available") - 1e-9).cast("int"), F.col("max_repeats"))
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.greatest(F.lit(1), F.ceil(F.col("available") / block_tokens)).cast("long"))
    copies = joined.withColumn("pass", F.explode(F.sequence(F.lit(0), passes - 1))).select(
        "source", "pass", F.xxhash64(block, F.lit(seed), "pass").alias("_block"), F.xxhash64("doc_id", F.lit(seed), "pass").alias("_place"), "doc_id", "tokens", "take"
    )
    runs = sorted_runs(copies, ["source"], ["pass", "_block", "_place", "doc_id"], "tokens")
    before = cut(offsets(runs, ["source"])).select("_pid", "source", "_before")
    placed = _join(runs, before, ["_pid", "source"]).withColumn("_sum", F.col("_before") + F.col("_end"))
    # the copy that crosses the budget stays if that brings the sum closer to it
    kept = placed.filter(F.col("_sum") - F.col("tokens") / 2 <= F.col("take"))
    return kept.select("doc_id", "source", "pass", "tokens", F.least(F.lit(1.0), (F.col("_sum") - F.col("tokens") / 2) / F.col("take")).alias("place"))


def mix(documents: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 0, path: str | None = None, exact: bool = False) -> DataFrame:
    docs = sized(documents, path)
    return realise(docs, plan(docs, targets, budget, exact), seed)


def reached(documents: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 0, path: str | None = None, exact: bool = False) -> DataFrame:
    """Of each source its target, the weight aimed at, the exponent and limit that led to it, and
    what was really reached: taken tokens, share of the mix, greatest number of repeats, and the
    tokens of its documents that are not in the mix at all (left_out)."""
    docs = sized(documents, path)
    sources = plan(docs, targets, budget, exact)
    spark: SparkSession = documents.sparkSession
    got = realise(docs, sources, seed).groupBy("source").agg(
        F.sum("tokens").alias("taken"), (F.max("pass") + 1).alias("most_repeats"), F.sum(F.when(F.col("pass") == 0, F.col("tokens"))).alias("once")
    )
    every = spark.createDataFrame(sources, _PLAN).join(got, "source", "left").na.fill(0, ["taken", "most_repeats", "once"])
    total = got.agg(F.sum("taken").alias("_all"))
    return every.join(F.broadcast(total), how="cross").select(
        "source", "target_share", "max_repeats", "available", "weight", "exponent", "bound", "taken", F.coalesce(F.col("taken") / F.col("_all"), F.lit(0.0)).alias("share"),
        F.col("most_repeats").cast("int").alias("most_repeats"), (F.col("available") - F.col("once")).alias("left_out"),
    )
