"""Queries of redundancy between features, embedding parameters and permutation nulls, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessella.operators import information as I
from tessella.operators import recurrence as Q
from tessella.operators import relational as R
from tessella.plans.series import HOURLY, hourly
from tessella.session import read


def _r(df, *names, nd=6):
    return df.select(*[F.round(c, nd).alias(c) if c in names else F.col(c) for c in df.columns])


def delay_information(spark, d):
    """Information between each series and itself, lag by lag, over quartile bins."""
    return _r(Q.lagged_information(_rows(spark, d), 24, 4), "mi")


def delay_choice(spark, d):
    return Q.choose_delay(Q.lagged_information(_rows(spark, d), 24, 4))


def false_neighbours(spark, d):
    return _r(Q.false_neighbours(_rows(spark, d), 3, 1), "share")


def _rows(spark, d):
    return hourly(spark, d).select(F.col("series").alias("key"), F.col("t").cast("long").alias("t"), "value")


def feature_redundancy(spark, d):
    """Pairs of features per mouse and session: information between being selective to either."""
    fact = R.tidy(read(spark, d, "selectivity"))
    sel = R.significant_pairs(fact).select("mouse", "session", "neuron_idx", "feature").withColumn("s", F.lit(1))
    units = fact.select("mouse", "session", "neuron_idx").distinct()
    n = units.groupBy("mouse").agg(F.count("*").alias("n"))
    one = sel.groupBy("mouse", "feature").agg(F.count("*").alias("k"))
    both = sel.alias("a").join(sel.alias("b"), ["mouse", "session", "neuron_idx"]).filter("a.feature < b.feature").groupBy("mouse", F.col("a.feature").alias("feature_a"), F.col("b.feature").alias("feature_b")).agg(F.count("*").alias("both"))
    j = both.join(one.select("mouse", F.col("feature").alias("feature_a"), F.col("k").alias("ka")), ["mouse", "feature_a"]).join(one.select("mouse", F.col("feature").alias("feature_b"), F.col("k").alias("kb")), ["mouse", "feature_b"]).join(n, "mouse")
    return j.select("mouse", "feature_a", "feature_b", "both", F.round(I.binary_mi(F.col("both"), F.col("ka"), F.col("kb"), F.col("n")), 6).alias("mi"))


def retention_enrichment(spark, d):
    """Matched neurons selective to a feature in two sessions, against the same count after the
    neurons of the later session changed places by whole-number arithmetic, 50 times."""
    fact = R.tidy(read(spark, d, "selectivity")).filter("matched_id is not null")
    sig = R.significant_pairs(fact).filter("session in ('1D', '2D')").select("mouse", "session", "feature", "matched_id").distinct()
    size = fact.groupBy("mouse").agg((F.max("matched_id") + 1).cast("long").alias("m"))
    first = sig.filter("session = '1D'").select("mouse", "feature", F.col("matched_id").cast("long").alias("id"))
    second = sig.filter("session = '2D'").select("mouse", "feature", F.col("matched_id").cast("long").alias("id")).join(size, "mouse")
    moved = second.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(50)))).select("mouse", "feature", "round", F.pmod(F.col("id") + F.col("round") * 7919, F.col("m")).alias("id"))
    hits = moved.join(first, ["mouse", "feature", "id"]).groupBy("feature", "round").agg(F.count("*").alias("n"))
    every = moved.select("feature", "round").distinct().join(hits, ["feature", "round"], "left").na.fill(0, ["n"])
    return every.groupBy("feature").agg(F.max(F.when(F.col("round") == 0, F.col("n"))).alias("observed"), F.round(F.avg(F.when(F.col("round") > 0, F.col("n"))), 6).alias("expected"))


_NAMES = [delay_information, delay_choice, false_neighbours, feature_redundancy, retention_enrichment]


def queries():
    return {f.__name__: f for f in _NAMES}


def oracle_sql():
    from tessella.plans.crossession import _T

    lag = f"""{HOURLY}, q AS (SELECT series, t, ntile(4) OVER (PARTITION BY series ORDER BY value, t) AS b FROM hourly),
p AS (SELECT x.series, l.lag, x.b AS bx, y.b AS by_, count(*) AS n FROM (SELECT unnest(range(1, 25)) AS lag) l, q x JOIN q y ON x.series = y.series WHERE y.t = x.t + l.lag GROUP BY ALL),
h AS (SELECT series, lag, sum(n) AS t FROM p GROUP BY ALL),
mi AS (SELECT p.series, p.lag, sum(n / t * log2(n * t / (a.s * c.s))) AS mi FROM p JOIN h USING (series, lag)
  JOIN (SELECT series, lag, bx, sum(n) AS s FROM p GROUP BY ALL) a USING (series, lag, bx) JOIN (SELECT series, lag, by_, sum(n) AS s FROM p GROUP BY ALL) c USING (series, lag, by_) GROUP BY ALL)"""
    part = lambda o, e: f"CASE WHEN {o} > 0 THEN {o} / n * log2({o} * n / ({e})) ELSE 0 END"
    return {
        "delay_information": f"WITH {lag} SELECT series AS key, CAST(lag AS INT) AS lag, round(mi, 6) AS mi FROM mi",
        "delay_choice": f"WITH {lag}, r AS (SELECT series, lag, round(mi, 9) AS m FROM mi), w AS (SELECT *, lag(m) OVER o AS p, lead(m) OVER o AS x, first_value(m) OVER o AS f FROM r WINDOW o AS (PARTITION BY series ORDER BY lag)) SELECT series AS key, CAST(coalesce(min(lag) FILTER (WHERE m < p AND m < x), min(lag) FILTER (WHERE m < f / {math.e!r}), 8) AS INT) AS delay FROM w GROUP BY series",
        "feature_redundancy": f"WITH {_T}, s AS (SELECT DISTINCT mouse, session, neuron_idx, feature FROM sig), u AS (SELECT mouse, count(DISTINCT (session, neuron_idx)) AS n FROM tidy GROUP BY mouse), k AS (SELECT mouse, feature, count(*) AS k FROM s GROUP BY ALL), b AS (SELECT a.mouse, a.feature AS feature_a, c.feature AS feature_b, count(*) AS both_ FROM s a JOIN s c ON a.mouse = c.mouse AND a.session = c.session AND a.neuron_idx = c.neuron_idx AND a.feature < c.feature GROUP BY ALL), j AS (SELECT b.*, x.k AS ka, y.k AS kb, n FROM b JOIN k x ON x.mouse = b.mouse AND x.feature = feature_a JOIN k y ON y.mouse = b.mouse AND y.feature = feature_b JOIN u ON u.mouse = b.mouse) SELECT mouse, feature_a, feature_b, both_ AS \"both\", round(greatest(0, {part('both_', 'ka * kb')} + {part('(ka - both_)', 'ka * (n - kb)')} + {part('(kb - both_)', '(n - ka) * kb')} + {part('(n - ka - kb + both_)', '(n - ka) * (n - kb)')}), 6) AS mi FROM j",
        "retention_enrichment": f"WITH {_T}, s AS (SELECT DISTINCT mouse, session, feature, CAST(matched_id AS BIGINT) AS id FROM sig WHERE matched_id IS NOT NULL AND session IN ('1D', '2D')), m AS (SELECT mouse, max(matched_id) + 1 AS m FROM tidy WHERE matched_id IS NOT NULL GROUP BY mouse), v AS (SELECT s.mouse, feature, k, (id + k * 7919) % m AS id FROM s JOIN m ON m.mouse = s.mouse, (SELECT unnest(range(0, 51)) AS k) WHERE session = '2D'), h AS (SELECT v.feature, k, count(f.id) AS n FROM v LEFT JOIN (SELECT * FROM s WHERE session = '1D') f ON f.mouse = v.mouse AND f.feature = v.feature AND f.id = v.id GROUP BY ALL) SELECT feature, max(n) FILTER (WHERE k = 0) AS observed, round(avg(n) FILTER (WHERE k > 0), 6) AS expected FROM h GROUP BY feature",
    }
