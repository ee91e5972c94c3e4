"""The general training-data queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import drift, ordering, profile, spikes, units, wide
from tessella.session import read

#: What the present values of the metrics must satisfy.
BATCH_RULES = {
    "pct_selective": profile.Rule(0, 100),
    "n_cells": profile.Rule(1),
    "duration_sec": profile.Rule(0, low_open=True, pattern=profile.PLAIN),
    "mi_mean": profile.Rule(0),
}
CALCIUM = spikes.Limits(stuck=10)
FRAME_RATE = spikes.Limits(stuck=6, floor=2e-3)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.faults(read(spark, d, "pair_attrs"), wide.type_table(read(spark, d, "attr_types")))


def p2_wide(spark: SparkSession, d: str) -> DataFrame:
    return wide.widen(read(spark, d, "pair_attrs"), wide.type_table(read(spark, d, "attr_types")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    calcium = spikes.faults(read(spark, d, "signals"), "unit_id", "t", "calcium", CALCIUM)
    batch = read(spark, d, "batch_summary").select("summary_id", "exp_name", "rig", "computed_at", "fps")
    sessions = batch.filter(F.col("rig").isNotNull() & F.col("computed_at").isNotNull() & F.col("fps").isNotNull() & ~F.isnan("fps"))
    # a session repeated in a later load is one reading
    keys = ["rig", "computed_at", "exp_name", "fps"]
    placed = ordering.global_rank(sessions.select(*keys).distinct(), ["rig"], ["computed_at", "exp_name", "fps"], "place")
    off = spikes.faults(placed, "rig", "place", "fps", FRAME_RATE)
    at = placed.join(off, (F.col("rig") == F.col("source_id")) & (F.col("place") == F.col("t"))).select(*keys)
    b = sessions.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    fps = b.join(at.alias("a"), same[0] & same[1] & same[2] & same[3], "left_semi").select(F.lit("fps").alias("field_name"), F.col("rig").alias("source_id"), F.col("summary_id").alias("pos"))
    return calcium.select(F.lit("calcium").alias("field_name"), "source_id", F.col("t").alias("pos")).unionByName(fps)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    u = units.recorded_units(read(spark, d, "series_types"), read(spark, d, "features"))
    return u.filter(F.col("unit_code") != "rad").select("series_id", "unit_code")


def p4_radians(spark: SparkSession, d: str) -> DataFrame:
    return units.in_radians(read(spark, d, "series_types"), read(spark, d, "features")).withColumn("radians", F.round("radians", 9))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(read(spark, d, "file_records")).select("file_id", "field_name", "change_kind")


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(read(spark, d, "file_records"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    # the cases are told by the counts and medians; the stability index is in p6_profile
    prof = profile.profile(read(spark, d, "batch_summary"), "load_id", list(BATCH_RULES), BATCH_RULES, stability=False)
    return profile.suspect_loads(prof, list(BATCH_RULES), "load_id")


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "batch_summary")
    prof = profile.profile(df, "load_id", rules=BATCH_RULES)
    # numbers and times have their range as numbers; how they are written differs between engines
    text = F.col("column_name").isin([c for c, k in df.dtypes if k == "string"])
    prof = prof.withColumns({c: F.when(text, F.col(c)) for c in ("min_value", "max_value")})
    return prof.select(*[F.round(c, 6).alias(c) if c in ("missing_rate", "median", "median_all", "psi", "min_number", "max_number") else F.col(c) for c in prof.columns])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_wide, p3_found, p4_found, p4_radians, p5_found, p5_table, p6_found, p6_profile)}


ATTRIBUTES = {
    "mouse": "string", "session": "string", "feature": "string", "me": "double", "pval": "double", "opt_delay": "bigint", "significant": "boolean",
    "signal_ratio": "double", "rval": "double", "pre_rval": "double", "rel_me_beh": "double", "rel_me_ca": "double", "stage1": "boolean", "stage2": "boolean",
    "shuffles1": "bigint", "shuffles2": "bigint", "final_p_thr": "double", "multicomp_corr": "string", "delay_sign": "bigint", "data_hash": "string",
    "computed_at": "timestamp", "operator_note": "string", "snr": "double", "n_events": "bigint",
}

_CELLS = r"""
raw AS (
  SELECT entity_id, regexp_replace(lower(trim(attr_name, E' \t\n\r ')), '[\s-]+', '_', 'g') AS attr_name,
         trim(attr_value, E' \t\n\r ') AS x, written_at, row_id
  FROM pair_attrs WHERE entity_id IS NOT NULL AND attr_name IS NOT NULL),
known AS (
  SELECT raw.*, attr_type FROM raw JOIN attr_types USING (attr_name)
  WHERE x IS NOT NULL AND lower(x) NOT IN ('', 'nan', 'none', 'n/a')),
bare AS (
  SELECT *, CASE WHEN regexp_full_match(replace(regexp_replace(x, '^np\.\w+\(\s*(.*?)\s*\)$', '\1'), ',', '.'), '[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?')
            THEN TRY_CAST(replace(regexp_replace(x, '^np\.\w+\(\s*(.*?)\s*\)$', '\1'), ',', '.') AS DOUBLE) END AS num
  FROM known),
vals AS (
  SELECT entity_id, attr_name, written_at, row_id, attr_type,
    CASE WHEN attr_type = 'double' THEN num END AS dv,
    CASE WHEN attr_type = 'bigint' AND num = floor(num) AND abs(num) < 9e15 THEN CAST(num AS BIGINT) END AS bv,
    CASE WHEN attr_type = 'boolean' THEN CASE WHEN lower(x) IN ('true','yes','1','np.true_') THEN true WHEN lower(x) IN ('false','no','0','np.false_') THEN false END END AS ov,
    CASE WHEN attr_type = 'timestamp' AND regexp_full_match(x, '\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}') THEN TRY_CAST(x AS TIMESTAMP) END AS tv,
    CASE WHEN attr_type = 'string' THEN x END AS sv
  FROM bare),
keyed AS (SELECT *, coalesce(dv IS NOT NULL OR bv IS NOT NULL OR ov IS NOT NULL OR tv IS NOT NULL OR sv IS NOT NULL, false) AS ok FROM vals)
"""


def _wide_sql() -> str:
    column = {"string": "sv", "double": "dv", "bigint": "bv", "boolean": "ov", "timestamp": "tv"}
    latest = ", ".join(f"max({column[k]}) FILTER (WHERE attr_name = '{n}') AS \"{n}\"" for n, k in ATTRIBUTES.items())
    return f"""WITH {_CELLS},
best AS (SELECT * FROM keyed WHERE ok QUALIFY row_number() OVER (PARTITION BY entity_id, attr_name ORDER BY written_at DESC, row_id DESC) = 1),
ids AS (SELECT DISTINCT entity_id FROM raw),
wide AS (SELECT entity_id, {latest} FROM best GROUP BY entity_id)
SELECT ids.entity_id, {", ".join(f'"{n}"' for n in sorted(ATTRIBUTES))} FROM ids LEFT JOIN wide ON ids.entity_id = wide.entity_id"""


_UNITS = """codes AS (SELECT * FROM (VALUES ('rad', 2 * pi()), ('deg', 360.0::DOUBLE), ('gon', 400.0::DOUBLE), ('turn', 1.0::DOUBLE), ('hour', 24.0::DOUBLE), ('mil', 6400.0::DOUBLE)) AS c(code, p)),
good AS (SELECT series_id, t, feat_value AS v FROM features WHERE series_id IS NOT NULL AND feat_value IS NOT NULL AND NOT isnan(feat_value)),
steps AS (SELECT series_id, v, abs(v - lag(v) OVER (PARTITION BY series_id ORDER BY t, v)) AS d FROM good),
sums AS (SELECT series_id, code, p, max(v) - min(v) AS span, count(*) FILTER (WHERE d > p / 2) AS wraps, sum(abs(p - d)) FILTER (WHERE d > p / 2) AS gap,
  sum(d) FILTER (WHERE d <= p / 2) AS walked, count(*) FILTER (WHERE d > 0 AND d <= p / 2) AS moves FROM steps, codes GROUP BY ALL),
fits AS (SELECT *, (gap / wraps) / (walked / moves) AS fit FROM sums WHERE span <= 1.02 * p AND wraps >= 1 AND moves >= 5 AND wraps <= 0.34 * (wraps + moves)),
units AS (SELECT series_id, code, p FROM fits WHERE fit <= 6 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY greatest(fit, 1)) = 1)"""


def _profile_sql() -> str:
    """Every column by its kind: text and number of each cell, then counts, medians and the stability
    index over the bins that any load has."""
    def cell(name: str, kind: str) -> str:
        if kind == "double":
            v = f"CASE WHEN NOT isnan({name}) THEN {name} END"
            return f"CAST({v} AS VARCHAR) AS txt, {v} AS num"
        if kind == "long":
            return f"CAST({name} AS VARCHAR) AS txt, CAST({name} AS DOUBLE) AS num"
        if kind == "time":
            return f"CAST({name} AS VARCHAR) AS txt, epoch_us({name}) / 1e6 AS num"
        v = f"CASE WHEN lower(trim({name})) NOT IN ('', 'nan') THEN {name} END"
        plain = rf"regexp_full_match({name}, '[+-]?(\d+(\.\d*)?|\.\d+)')"
        return f"{v} AS txt, CASE WHEN {plain} THEN TRY_CAST({v} AS DOUBLE) END AS num"

    kinds = {
        "summary_id": "long", "exp_name": "text", "rig": "text", "n_cells": "long", "n_frames": "long", "fps": "double", "duration_sec": "text", "n_significant_cells": "long",
        "pct_selective": "double", "total_sig_pairs": "long", "mi_mean": "double", "t_total": "double", "computed_at": "time", "loaded_at": "time",
    }
    cells = " UNION ALL ".join(f"SELECT load_id, '{c}' AS column_name, {cell(c, k)} FROM batch_summary" for c, k in kinds.items())
    bad = "CASE column_name WHEN 'pct_selective' THEN num < 0 OR num > 100 WHEN 'n_cells' THEN num < 1 WHEN 'mi_mean' THEN num < 0 WHEN 'duration_sec' THEN num IS NULL OR num <= 0 ELSE false END OR (column_name IN ('pct_selective', 'n_cells', 'mi_mean', 'duration_sec') AND isinf(coalesce(num, 0)))"
    shape = r"regexp_replace(regexp_replace(lower(txt), '\p{L}+', 'a', 'g'), '\d+', '9', 'g')"
    smooth, text = profile.SMOOTH, ", ".join(f"'{c}'" for c, k in kinds.items() if k == "text")
    return f"""WITH u AS ({cells}),
dec AS (SELECT column_name, list_sort(list_distinct(quantile_cont(num, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS cuts, quantile_cont(num, 0.5) AS median_all FROM u WHERE num IS NOT NULL GROUP BY column_name),
b AS (SELECT load_id, u.column_name, CASE WHEN num IS NOT NULL THEN CAST(len(list_filter(cuts, lambda c: c < num)) AS VARCHAR) ELSE {shape} END AS bin FROM u LEFT JOIN dec USING (column_name) WHERE txt IS NOT NULL),
h AS (SELECT load_id, column_name, bin, count(*) AS n FROM b GROUP BY ALL),
a AS (SELECT column_name, bin, sum(n) AS n_all FROM h GROUP BY ALL),
k AS (SELECT column_name, count(*) AS k, sum(n_all) AS total FROM a GROUP BY column_name),
l AS (SELECT load_id, column_name, sum(n) AS n_load FROM h GROUP BY ALL),
g AS (SELECT l.load_id, a.column_name, (coalesce(h.n, 0) + {smooth}) / (n_load + {smooth} * k) AS p, (n_all + {smooth}) / (total + {smooth} * k) AS q FROM l JOIN a USING (column_name) JOIN k USING (column_name) LEFT JOIN h ON h.load_id = l.load_id AND h.column_name = a.column_name AND h.bin = a.bin),
psi AS (SELECT load_id, column_name, sum((p - q) * ln(p / q)) AS psi FROM g GROUP BY ALL),
s AS (SELECT load_id, column_name, count(*) AS n_rows, count(*) - count(txt) AS n_missing, count(DISTINCT txt) AS n_distinct, min(num) AS min_number, max(num) AS max_number, min(CASE WHEN column_name IN ({text}) THEN txt END) AS min_value, max(CASE WHEN column_name IN ({text}) THEN txt END) AS max_value, count(*) FILTER (WHERE txt IS NOT NULL AND coalesce({bad}, false)) AS n_violations, quantile_cont(num, 0.5) AS median FROM u GROUP BY ALL)
SELECT load_id, column_name, n_rows, n_missing, round(n_missing / n_rows, 6) AS missing_rate, n_distinct, round(min_number, 6) AS min_number, round(max_number, 6) AS max_number, min_value, max_value, n_violations, round(median, 6) AS median, round(median_all, 6) AS median_all, round(psi, 6) AS psi
FROM s LEFT JOIN dec USING (column_name) LEFT JOIN psi USING (load_id, column_name)"""


def oracle_sql() -> dict[str, str]:
    metrics = {"pct_selective": "p > 100 OR p < 0", "n_cells": "p < 1", "mi_mean": "p < 0"}
    number = "CASE WHEN isnan(CAST({m} AS DOUBLE)) THEN NULL ELSE CAST({m} AS DOUBLE) END"
    parts = [f"SELECT load_id, '{m}' AS metric, {number.format(m=m)} AS p, CAST({number.format(m=m)} AS VARCHAR) AS txt, coalesce({bad.replace('p ', number.format(m=m) + ' ')}, false) OR isinf(coalesce({number.format(m=m)}, 0)) AS bad FROM batch_summary" for m, bad in metrics.items()]
    plain = r"regexp_full_match(duration_sec, '[+-]?(\d+(\.\d*)?|\.\d+)')"
    absent = "duration_sec IS NULL OR lower(trim(duration_sec)) IN ('', 'nan')"
    parts.append(
        f"SELECT load_id, 'duration_sec' AS metric, CASE WHEN {plain} THEN TRY_CAST(duration_sec AS DOUBLE) END AS p, CASE WHEN {absent} THEN NULL ELSE duration_sec END AS txt, "
        f"NOT ({absent}) AND (NOT {plain} OR TRY_CAST(duration_sec AS DOUBLE) <= 0) AS bad FROM batch_summary"
    )
    return {
        "p2_found": f"""WITH {_CELLS},
cell AS (
  SELECT entity_id, attr_name, bool_or(NOT ok) AS unreadable,
         greatest(count(DISTINCT dv), count(DISTINCT bv), count(DISTINCT ov), count(DISTINCT tv), count(DISTINCT sv)) AS kinds
  FROM keyed GROUP BY entity_id, attr_name)
SELECT entity_id, attr_name, CASE WHEN unreadable THEN 'unreadable' ELSE 'conflict' END AS problem FROM cell WHERE unreadable OR kinds > 1""",
        "p2_wide": _wide_sql(),
        "p4_found": f"WITH {_UNITS} SELECT series_id, code AS unit_code FROM units WHERE code <> 'rad'",
        "p4_radians": f"WITH {_UNITS}, once AS (SELECT series_id, t, max(CASE WHEN NOT isnan(feat_value) THEN feat_value END) AS v FROM features GROUP BY ALL) SELECT series_id, t, code AS unit_code, round(v * 2 * pi() / p, 9) AS radians FROM once JOIN units USING (series_id)",
        "p6_profile": _profile_sql(),
        "p6_found": f"""WITH u AS ({" UNION ALL ".join(parts)}),
g AS (SELECT metric, quantile_cont(p, 0.5) AS med FROM u GROUP BY metric),
s AS (SELECT load_id, metric, count(*) AS n, count(*) - count(txt) AS missing, count(DISTINCT txt) AS kinds, bool_or(bad) AS bad, quantile_cont(p, 0.5) AS med FROM u GROUP BY load_id, metric)
SELECT s.load_id, s.metric FROM s JOIN g USING (metric)
WHERE missing >= 0.25 * n OR kinds <= 5 OR bad OR s.med < g.med / 2 OR s.med > 2 * g.med""",
    }
