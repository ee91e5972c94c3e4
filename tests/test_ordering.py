import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessella.operators.ordering import nested_order_statistics, global_rank, order_statistics


def test_order_statistics_equal_numpy_with_hot_group_and_ties(spark):
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 20, n).astype(str)), "v": np.round(rng.normal(size=n), 1)})
    got = order_statistics(spark.createDataFrame(pdf).repartition(7), ["g"], "v", [0.0, 0.1, 0.5, 0.99, 1.0]).toPandas()
    assert len(got) == pdf.g.nunique() * 5
    for g, x in pdf.groupby("g"):
        for p in (0.0, 0.1, 0.5, 0.99, 1.0):
            r = got[(got.g == g) & (got.prob == p)]
            assert abs(r.result.iloc[0] - np.quantile(x.v, p)) < 1e-9 and r.n.iloc[0] == len(x)


def test_order_statistics_missing_infinite_null_keys_empty(spark):
    rows = [(None, 1.0), (None, None), (None, float("nan")), ("a", float("inf")), ("a", float("-inf")), ("a", 0.0), ("a", -0.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.prob): (r.n, r.result) for r in order_statistics(df, ["g"], "v", [0.0, 0.5, 1.0]).collect()}
    assert got[(None, 0.5)] == (1, 1.0)
    assert got[("a", 0.0)] == (4, float("-inf")) and got[("a", 0.5)] == (4, 0.0) and got[("a", 1.0)] == (4, float("inf"))
    assert not any(k[0] == "b" for k in got)
    assert order_statistics(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_global_rank_counts_within_groups(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.hash("id").alias("o"), "id")
    got = global_rank(df, ["g"], ["o", "id"]).toPandas()
    for _, x in got.groupby("g"):
        x = x.sort_values(["o", "id"])
        assert x._rank.tolist() == list(range(len(x)))


def test_nested_statistics_are_those_of_two_sorts(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice([rng.random(), 0.0, -0.0, 3.0, float("inf"), None, float("nan")])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, s int, v double").repartition(7)
    outer, inner = nested_order_statistics(df, ["k"], ["s"], "v", [0.1, 0.5], [0.5, 1.0])
    key = lambda r: str(tuple(r))
    assert sorted(outer.collect(), key=key) == sorted(order_statistics(df, ["k"], "v", [0.1, 0.5]).collect(), key=key)
    assert sorted(inner.collect(), key=key) == sorted(order_statistics(df, ["k", "s"], "v", [0.5, 1.0]).collect(), key=key)
