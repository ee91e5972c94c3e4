"""Column profiles per load from exact column-value counts.

The columns are unpivoted to (load, column, value) and counted, with partial counts before the
shuffle, so a hot value or load sends one row per task. Everything else - null rates, distincts,
ranges, pattern violations, medians, population stability - is computed from these counts.

Defined results
- missing: null, NaN, blank text or the word nan; present: everything else
- numeric value of a text: only of a plain decimal number; of a timestamp: seconds since 1970
- n_violations: present values that break the column's pattern or lie outside its range
- psi: population stability index of the load's present values against those of all loads, over
  the deciles of all loads (numbers) or the shapes of the texts; null where nothing is present
- an empty table gives an empty profile; a null load is a load of its own
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.ordering import nested_order_statistics
from tessella.session import cut

PLAIN = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"
#: Counts are smoothed by this many rows before a share is taken, so that no share is zero.
SMOOTH = 0.5


@dataclass(frozen=True)
class Rule:
    """What a column's present values must satisfy."""

    low: float = float("-inf")
    high: float = float("inf")
    low_open: bool = False
    pattern: str | None = None
    finite: bool = True


def _cell(name: str, kind: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        d = c.cast("double")
        text, number, missing = d.cast("string"), d + F.lit(0.0), d.isNull() | F.isnan(d)
    elif isinstance(kind, (T.IntegralType,)):
        text, number, missing = c.cast("string"), c.cast("double"), c.isNull()
    elif isinstance(kind, T.BooleanType):
        text, number, missing = c.cast("string"), c.cast("int").cast("double"), c.isNull()
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        ts = c.cast("timestamp")
        text, number, missing = c.cast("string"), F.unix_micros(ts) / 1e6, c.isNull()
    else:
        text = c.cast("string") if isinstance(kind, T.StringType) else F.to_json(F.struct(c))
        low = F.lower(F.trim(text))
        missing = c.isNull() | low.isin("", "nan")
        number = F.when(text.rlike(PLAIN), text.try_cast("double"))
    # all missing values are one: null
    return F.struct(F.lit(name).alias("column_name"), F.when(~missing, text).alias("value"), F.when(~missing, number).alias("number"))


def value_counts(df: DataFrame, load: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(load, column_name, value, number, n): how often each value occurs."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns = [c for c in (columns or kinds) if c != load]
    cells = F.explode(F.array(*[_cell(c, kinds[c]) for c in columns])).alias("_c")
    return df.select(F.col(f"`{load}`").alias(load), cells).select(load, "_c.*").groupBy(load, "column_name", "value", "number").agg(F.count("*").alias("n"))


def _violates(rules: Mapping[str, Rule]) -> Column:
    broken = F.lit(False)
    for name, r in rules.items():
        number = F.col("number")
        bad = (number < r.low) | (number > r.high)
        if r.low_open:
            bad = bad | (number <= r.low)
        if r.finite:
            bad = bad | (F.abs(number) == float("inf"))
        bad = F.coalesce(bad, F.lit(False))
        if r.pattern:
            bad = bad | ~F.col("value").rlike(r.pattern)
        broken = broken | ((F.col("column_name") == name) & bad)
    return F.col("value").isNotNull() & broken


def stability_index(counts: DataFrame, load: str, cuts: DataFrame) -> DataFrame:
    """(load, column_name, psi) from value counts and each column's deciles over all loads (_cuts)."""
    binned = counts.filter(F.col("value").isNotNull()).join(F.broadcast(cuts), "column_name", "left")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("value"), r"(?U)\p{L}+", "a"), r"\d+", "9"), r"(a9?)(\W\1)+", "$1")
    bin_ = F.when(F.col("number").isNotNull(), F.size(F.filter("_cuts", lambda c: c < F.col("number"))).cast("string")).otherwise(shape)
    hist = binned.groupBy(load, "column_name", bin_.alias("_bin")).agg(F.sum("n").alias("_n"))
    every_bin = hist.groupBy("column_name", "_bin").agg(F.sum("_n").alias("_all"))
    total = every_bin.groupBy("column_name").agg(F.sum("_all").alias("_all_n"), F.count("*").alias("_bins"))
    loads = hist.groupBy(load, "column_name").agg(F.sum("_n").alias("_load_n"))
    # bins a load lacks count as well: the sum over all bins equals the sum over the load's own
    # bins plus the closed form for the rest, so no grid of loads and bins is built
    joined = hist.join(every_bin, ["column_name", "_bin"]).join(F.broadcast(total), "column_name").join(
        loads.withColumnRenamed("column_name", "_lc").withColumnRenamed(load, "_ll"), F.col(load).eqNullSafe(F.col("_ll")) & (F.col("column_name") == F.col("_lc"))
    ).drop("_ll", "_lc")
    k = F.col("_bins")
    p = (F.col("_n") + SMOOTH) / (F.col("_load_n") + SMOOTH * k)
    q = (F.col("_all") + SMOOTH) / (F.col("_all_n") + SMOOTH * k)
    p0 = F.lit(SMOOTH) / (F.col("_load_n") + SMOOTH * k)
    term = lambda a, b: (a - b) * F.log(a / b)
    every_log = every_bin.join(F.broadcast(total), "column_name").groupBy("column_name").agg(
        F.sum((F.col("_all") + SMOOTH) / (F.col("_all_n") + SMOOTH * k) * F.log((F.col("_all") + SMOOTH) / (F.col("_all_n") + SMOOTH * k))).alias("_qlogq"),
        F.sum(F.log((F.col("_all") + SMOOTH) / (F.col("_all_n") + SMOOTH * k))).alias("_logq"),
    )
    part = joined.groupBy(load, "column_name").agg(
        F.sum(term(p, q)).alias("_own"),
        F.count("*").alias("_k_own"),
        F.sum(q).alias("_q_own"),
        F.sum(q * F.log(q)).alias("_qlogq_own"),
        F.sum(F.log(q)).alias("_logq_own"),
        F.first(p0).alias("_p0"),
        F.first("_bins").alias("_bins"),
    )
    rest = part.join(F.broadcast(every_log), "column_name")
    # sum over the other bins of (p0 - q)(ln p0 - ln q)
    m, q_rest = F.col("_bins") - F.col("_k_own"), 1 - F.col("_q_own")
    lp = F.log("_p0")
    other = m * F.col("_p0") * lp - F.col("_p0") * (F.col("_logq") - F.col("_logq_own")) - q_rest * lp + (F.col("_qlogq") - F.col("_qlogq_own"))
    return rest.select(load, "column_name", (F.col("_own") + F.when(m > 0, other).otherwise(0.0)).alias("psi"))


def profile(df: DataFrame, load: str, columns: Sequence[str] | None = None, rules: Mapping[str, Rule] | None = None, stability: bool = True) -> DataFrame:
    """One row per load and column: n_rows, n_missing, missing_rate, n_distinct, min_number,
    max_number, min_value, max_value, n_violations, median, median_all, and with stability psi."""
    counts = cut(value_counts(df, load, columns))
    present = F.col("value").isNotNull()
    base = counts.groupBy(load, "column_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(~present, F.col("n")).otherwise(0)).alias("n_missing"),
        F.count(F.when(present, 1)).alias("n_distinct"),
        F.min("number").alias("min_number"),
        F.max("number").alias("max_number"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.sum(F.when(_violates(rules or {}), F.col("n")).otherwise(0)).alias("n_violations"),
    )
    base = base.withColumn("missing_rate", F.col("n_missing") / F.col("n_rows"))
    numbers = counts.filter(F.col("number").isNotNull())
    deciles = [i / 10 for i in range(1, 10)] if stability else [0.5]
    every, own = nested_order_statistics(numbers, ["column_name"], [load], "number", deciles, [0.5], "n")
    # one row per column: as many as the table has columns
    cuts = cut(
        every.groupBy("column_name").agg(
            F.array_sort(F.collect_set("result")).alias("_cuts"), F.max(F.when(F.col("prob") == 0.5, F.col("result"))).alias("median_all")
        )
    )
    def attach(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.withColumnRenamed(load, "_l").withColumnRenamed("column_name", "_c")
        return left.join(r, F.col(load).eqNullSafe(F.col("_l")) & (F.col("column_name") == F.col("_c")), "left").drop("_l", "_c")

    out = attach(base, own.select(load, "column_name", F.col("result").alias("median")))
    if stability:
        out = attach(out, stability_index(counts, load, cuts))
    return out.join(F.broadcast(cuts.select("column_name", "median_all")), "column_name", "left").select(
        load, "column_name", "n_rows", "n_missing", "missing_rate", "n_distinct", "min_number", "max_number", "min_value", "max_value", "n_violations", "median", "median_all", *["psi"] * stability
    )


def suspect_loads(prof: DataFrame, metrics: Sequence[str], load: str, missing: float = 0.25, few: int = 5, ratio: float = 2.0) -> DataFrame:
    """(load, metric) out of order: too much missing, too few distinct values, a violation, or a
    median less than 1/ratio or more than ratio times that of all loads."""
    off = (F.col("median") < F.col("median_all") / ratio) | (F.col("median") > F.col("median_all") * ratio)
    bad = (F.col("missing_rate") >= missing) | (F.col("n_distinct") <= few) | (F.col("n_violations") > 0) | F.coalesce(off, F.lit(False))
    return prof.filter(F.col("column_name").isin(list(metrics)) & bad).select(load, F.col("column_name").alias("metric"))
