from datetime import datetime, timedelta

import numpy as np
import pandas as pd

from tessella.llm import percentiles as P

RECORD = ["mouse", "neuron"]


def table(spark, n=2000, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "row_id": np.arange(n),
            "mouse": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 5, n).astype(str)),
            "neuron": np.arange(n),
            "feature": rng.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1]),
            "me": np.where(rng.random(n) < 0.1, 0.0, rng.pareto(1.5, n)),
            "loaded_at": [datetime(2014, 1, 1) + timedelta(hours=int(h)) for h in rng.integers(0, 100, n)],
            "value": 1,
            "n": 2,
        }
    )
    pdf.loc[::17, "me"] = np.nan
    again = pdf.iloc[::9].assign(row_id=lambda x: x.row_id + n, loaded_at=lambda x: x.loaded_at + timedelta(days=30))
    return pdf, spark.createDataFrame(pd.concat([pdf, again]))


def test_equal_numpy_and_put_together_days(spark):
    pdf, df = table(spark)
    whole = P.percentiles(df, ["feature"], "me", RECORD).toPandas()
    parts = P.day_parts(df, ["feature"], "me", RECORD)
    first, second = parts.filter("day <= '2014-01-02'"), parts.filter("day > '2014-01-02'")
    together = P.from_parts(second.unionByName(first), ["feature"]).toPandas()
    key = ["feature", "prob"]
    pd.testing.assert_frame_equal(whole.sort_values(key, ignore_index=True), together.sort_values(key, ignore_index=True))
    for f, x in pdf.dropna(subset=["me"]).groupby("feature"):
        for p in P.PROBS:
            r = whole[(whole.feature == f) & (whole.prob == p)]
            assert abs(r.value.iloc[0] - np.quantile(x.me, p)) <= 1e-12 * max(1, abs(r.value.iloc[0])) and r.n.iloc[0] == len(x)


def test_null_keys_count_and_empty(spark):
    rows = [(1, None, 1, 2.0, datetime(2014, 1, 1)), (2, None, 1, 4.0, datetime(2014, 1, 1)), (3, "m", 1, None, datetime(2014, 1, 1)), (4, "m", 1, 6.0, datetime(2014, 1, 2)), (5, "m", 1, 99.0, datetime(2014, 1, 3))]
    df = spark.createDataFrame(rows, "row_id bigint, mouse string, neuron int, me double, loaded_at timestamp_ntz").selectExpr("*", "'f' as feature")
    r = P.percentiles(df, ["feature"], "me", RECORD, probs=[0.5]).collect()
    assert [(x.n, x.value) for x in r] == [(3, 4.0)]
    assert P.percentiles(df.limit(0), ["feature"], "me", RECORD).count() == 0
