"""Queries of the relational layer and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import relational as R
from tessella.session import read

SESSIONS = ["1D", "2D", "3D", "4D", "5D"]


def _fact(spark: SparkSession, d: str) -> DataFrame:
    return R.tidy(read(spark, d, "selectivity"))


def tidy_query(spark, d):
    f = R.tidy_query(_fact(spark, d), sessions=["1D", "3D"], significant=True, mi_min=0.05, mi_max=0.5, pval_max=0.01, excluded_mice=["H07"], anti_selectivity=True)
    return f.select("row_id", "mouse", "session", "feature", "me")


def significance_filter(spark, d):
    return R.significant_pairs(_fact(spark, d), forward_only=True).select(*R.PAIR, "me")


def exclusion_anti_join(spark, d):
    fact = _fact(spark, d)
    few = fact.groupBy("mouse").agg(F.count_distinct("session").alias("n")).filter("n < 3")
    return R.without(fact, few, ["mouse"]).groupBy("mouse").agg(F.count("*").alias("pairs"))


def membership_semi_join(spark, d):
    fact = _fact(spark, d)
    return R.only(fact, R.significant_pairs(fact).filter("matched_id is not null"), ["mouse", "matched_id"]).groupBy("mouse", "session").agg(F.count("*").alias("pairs"))


def relational_division(spark, d):
    return R.matched_in_all(_fact(spark, d))


def count_table(spark, d):
    return R.pivoted(R.selective_counts(_fact(spark, d)), SESSIONS)


def count_table_k(spark, d):
    fact = _fact(spark, d)
    parts = [R.selective_counts(fact, k).withColumn("k", F.lit(k)) for k in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def fraction_table(spark, d):
    return R.fractions(_fact(spark, d))


def retention_table(spark, d):
    return R.retention(_fact(spark, d), 5)


def cross_session_lists(spark, d):
    return R.selectivity_lists(_fact(spark, d))


def aggregate_features(spark, d):
    return R.with_aggregates(_fact(spark, d), "any_zone", ["corner_zone", "wall_zone", "centre_zone"]).groupBy("feature").agg(
        F.count("*").alias("pairs"), F.round(F.avg(R.number("me")), 9).alias("me"), F.min(R.number("pval")).alias("pval")
    )


def raw_vs_filtered(spark, d):
    fact = _fact(spark, d)
    return R.set_changes(fact.filter("significant"), R.significant_pairs(fact), R.PAIR)


def outer_merge(spark, d):
    fact = _fact(spark, d)
    a = fact.filter("session = '1D'").groupBy("mouse", "feature").agg(F.count("*").alias("n"))
    b = fact.filter("session = '2D'").groupBy("mouse", "feature").agg(F.count("*").alias("n"))
    return R.outer_compare(a, b, ["mouse", "feature"], "n")


def forward_filled(spark, d):
    b = read(spark, d, "batch_summary").select("rig", "computed_at", "summary_id", R.number("fps").alias("fps"))
    return R.forward_fill(b, ["rig"], ["computed_at", "summary_id"], "fps")


def batch_ratio_of_sums(spark, d):
    return R.session_summary(read(spark, d, "batch_summary"))


def constant_column_scan(spark, d):
    return R.constant_columns(read(spark, d, "selectivity"), ["mouse", "session", "feature", "matched_id", "neuron_idx", "delay_sign", "significant"])


def downsampled(spark, d):
    return R.every_k(read(spark, d, "signals"), "t", 5).groupBy("unit_id").agg(F.count_distinct("t").alias("frames"))


def outliers_zscore(spark, d):
    return R.outliers(_fact(spark, d).filter(R.number("me").isNotNull()), ["feature"], "me", "zscore", 3.0).filter("outlier").select("row_id", "feature")


def outliers_iqr(spark, d):
    return R.outliers(_fact(spark, d).filter(R.number("me").isNotNull()), ["feature"], "me", "iqr", 3.0).filter("outlier").select("row_id", "feature")


def outliers_mad(spark, d):
    return R.outliers(_fact(spark, d).filter(R.number("me").isNotNull()), ["feature"], "me", "mad", 5.0).filter("outlier").select("row_id", "feature")


def grouping_sets(spark, d):
    return _fact(spark, d).cube("session", "feature").agg(F.count("*").alias("pairs"), F.sum(F.col("significant").cast("int")).alias("hits"), F.grouping_id().cast("int").alias("level"))


_NAMES = [
    tidy_query, significance_filter, exclusion_anti_join, membership_semi_join, relational_division, count_table, count_table_k, fraction_table, retention_table, cross_session_lists,
    aggregate_features, raw_vs_filtered, outer_merge, forward_filled, batch_ratio_of_sums, constant_column_scan, downsampled, outliers_zscore, outliers_iqr, outliers_mad, grouping_sets,
]


def queries():
    return {f.__name__: f for f in _NAMES}


_T = """tidy AS (SELECT * REPLACE (CASE WHEN isnan(me) THEN NULL ELSE me END AS me, CASE WHEN isnan(pval) THEN NULL ELSE pval END AS pval,
  CASE WHEN isnan(signal_ratio) THEN NULL ELSE signal_ratio END AS signal_ratio) FROM selectivity
  QUALIFY row_number() OVER (PARTITION BY mouse, session, neuron_idx, feature ORDER BY loaded_at DESC, row_id DESC) = 1),
sig AS (SELECT * FROM tidy WHERE significant AND me > 0.04 AND pval < 0.001 AND (signal_ratio IS NULL OR signal_ratio > 1))"""

_COUNTS = """sel AS (SELECT mouse, session, neuron_idx, count(DISTINCT feature) AS n_sel FROM sig GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT mouse FROM tidy), (SELECT DISTINCT session FROM tidy))"""


def oracle_sql():
    pair = "mouse, session, neuron_idx, feature"
    per = "(SELECT count(*) FROM sel s WHERE s.mouse = grid.mouse AND s.session = grid.session{x})"
    moments = f"WITH {_T}, t AS (SELECT * FROM tidy WHERE me IS NOT NULL)"
    return {
        "tidy_query": f"WITH {_T} SELECT row_id, mouse, session, feature, me FROM tidy WHERE session IN ('1D','3D') AND significant AND me BETWEEN 0.05 AND 0.5 AND pval <= 0.01 AND mouse <> 'H07' AND (signal_ratio IS NULL OR signal_ratio > 1)",
        "significance_filter": f"WITH {_T} SELECT {pair}, me FROM sig WHERE delay_sign >= 0",
        "exclusion_anti_join": f"WITH {_T} SELECT mouse, count(*) AS pairs FROM tidy WHERE mouse NOT IN (SELECT mouse FROM tidy GROUP BY mouse HAVING count(DISTINCT session) < 3) GROUP BY mouse",
        "membership_semi_join": f"WITH {_T} SELECT mouse, session, count(*) AS pairs FROM tidy WHERE (mouse, matched_id) IN (SELECT (mouse, matched_id) FROM sig WHERE matched_id IS NOT NULL) GROUP BY mouse, session",
        "relational_division": f"WITH {_T}, all_s AS (SELECT mouse, count(DISTINCT session) AS total FROM tidy GROUP BY mouse) SELECT mouse, matched_id, count(DISTINCT session) AS n_sessions FROM tidy JOIN all_s USING (mouse) WHERE matched_id IS NOT NULL GROUP BY mouse, matched_id, total HAVING count(DISTINCT session) = total",
        "count_table": f"WITH {_T}, {_COUNTS}, c AS (SELECT grid.*, {per.format(x='')} AS n FROM grid) SELECT mouse, " + ", ".join(f"max(n) FILTER (WHERE session = '{s}') AS \"{s}\"" for s in SESSIONS) + " FROM c GROUP BY mouse",
        "count_table_k": f"WITH {_T}, {_COUNTS} " + " UNION ALL ".join(f"SELECT mouse, session, {per.format(x=f' AND n_sel {op} {k}')} AS n, {k} AS k FROM grid" for k, op in ((1, "="), (2, "="), (3, ">="))),
        "fraction_table": f"WITH {_T}, {_COUNTS}, c AS (SELECT grid.*, {per.format(x='')} AS n, (SELECT count(DISTINCT neuron_idx) FROM tidy t WHERE t.mouse = grid.mouse AND t.session = grid.session) AS total FROM grid) SELECT *, CASE WHEN total > 0 THEN round(100 * n / total, 2) END AS percent FROM c",
        "retention_table": f"WITH {_T}, s AS (SELECT mouse, matched_id, feature, count(DISTINCT session) AS s FROM sig WHERE matched_id IS NOT NULL GROUP BY ALL), e AS (SELECT mouse, k FROM s, (SELECT CAST(range AS INT) AS k FROM range(1, 6)) WHERE s >= k) SELECT mouse, k, count(*) AS n FROM e GROUP BY mouse, k UNION ALL SELECT 'total', k, count(*) FROM e GROUP BY k",
        "cross_session_lists": f"WITH {_T}, g AS (SELECT * FROM (SELECT DISTINCT mouse, matched_id FROM tidy WHERE matched_id IS NOT NULL) JOIN (SELECT DISTINCT mouse, session FROM tidy) USING (mouse)), p AS (SELECT mouse, matched_id, session FROM tidy WHERE matched_id IS NOT NULL GROUP BY ALL), n AS (SELECT mouse, matched_id, session, string_agg(DISTINCT feature, ', ' ORDER BY feature) AS names FROM sig WHERE matched_id IS NOT NULL GROUP BY ALL) SELECT g.mouse, g.matched_id, g.session, CASE WHEN p.mouse IS NULL THEN '' ELSE coalesce(names, '---') END AS features FROM g LEFT JOIN p USING (mouse, matched_id, session) LEFT JOIN n USING (mouse, matched_id, session)",
        "aggregate_features": f"WITH {_T}, a AS (SELECT 'any_zone' AS feature, avg(me) AS me, min(pval) AS pval FROM tidy WHERE feature IN ('corner_zone','wall_zone','centre_zone') AND significant AND me > 0.04 GROUP BY mouse, session, neuron_idx), u AS (SELECT feature, me, pval FROM tidy UNION ALL SELECT * FROM a) SELECT feature, count(*) AS pairs, round(avg(me), 9) AS me, min(pval) AS pval FROM u GROUP BY feature",
        "raw_vs_filtered": f"WITH {_T} SELECT DISTINCT {pair}, CASE WHEN ({pair}) IN (SELECT ({pair}) FROM sig) THEN 'kept' ELSE 'lost' END AS change FROM tidy WHERE significant",
        "outer_merge": f"WITH {_T}, a AS (SELECT mouse, feature, count(*) AS x FROM tidy WHERE session = '1D' GROUP BY ALL), b AS (SELECT mouse, feature, count(*) AS y FROM tidy WHERE session = '2D' GROUP BY ALL) SELECT coalesce(a.mouse, b.mouse) AS mouse, coalesce(a.feature, b.feature) AS feature, x AS left_value, y AS right_value, CASE WHEN x IS NULL THEN 'right only' WHEN y IS NULL THEN 'left only' WHEN x = y THEN 'same' ELSE 'differs' END AS state FROM a FULL JOIN b ON a.mouse = b.mouse AND a.feature = b.feature",
        "forward_filled": "SELECT rig, computed_at, summary_id, last_value(CASE WHEN isnan(fps) THEN NULL ELSE fps END IGNORE NULLS) OVER (PARTITION BY rig ORDER BY computed_at, summary_id ROWS UNBOUNDED PRECEDING) AS fps FROM batch_summary",
        "batch_ratio_of_sums": "SELECT rig, count(*) AS sessions, CAST(sum(n_cells) AS BIGINT) AS cells, CAST(sum(n_significant_cells) AS BIGINT) AS significant, round(100 * sum(n_significant_cells) / sum(n_cells), 4) AS percent, round(avg(CASE WHEN isnan(mi_mean) THEN NULL ELSE mi_mean END), 6) AS mi_mean FROM batch_summary GROUP BY rig",
        "constant_column_scan": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS kinds FROM selectivity" for c in ["mouse", "session", "feature", "matched_id", "neuron_idx", "delay_sign", "significant"]),
        "downsampled": "SELECT unit_id, count(DISTINCT t) AS frames FROM signals WHERE t % 5 = 0 GROUP BY unit_id",
        "outliers_zscore": f"{moments}, s AS (SELECT feature, avg(me) AS m, stddev_pop(me) AS s FROM t GROUP BY feature) SELECT row_id, feature FROM t JOIN s USING (feature) WHERE abs(me - m) >= 3 * s",
        "outliers_iqr": f"{moments}, s AS (SELECT feature, quantile_cont(me, 0.25) AS a, quantile_cont(me, 0.75) AS b FROM t GROUP BY feature) SELECT row_id, feature FROM t JOIN s USING (feature) WHERE me < a - 3 * (b - a) OR me > b + 3 * (b - a)",
        "outliers_mad": f"{moments}, s AS (SELECT feature, median(me) AS m, mad(me) AS s FROM t GROUP BY feature) SELECT row_id, feature FROM t JOIN s USING (feature) WHERE abs(me - m) > 5 * 1.4826 * s",
        "grouping_sets": f"WITH {_T} SELECT session, feature, count(*) AS pairs, CAST(sum(CAST(significant AS INT)) AS BIGINT) AS hits, CAST(grouping(session, feature) AS INT) AS level FROM tidy GROUP BY CUBE (session, feature)",
    }
