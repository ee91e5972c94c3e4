"""Cross-session tables over the tidy selectivity fact: predicates, joins, pivots, retention.

The fact has one row per (mouse, session, neuron, feature). Every operator is a plan of built-in
expressions; groups are counted with partial aggregation, so hot mice send one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.ordering import order_statistics, running_sum

#: The default thresholds of a significant pair.
ME_LEAST, PVAL_MOST = 0.04, 0.001
PAIR = ["mouse", "session", "neuron_idx", "feature"]


def tidy(fact: DataFrame) -> DataFrame:
    """The latest delivery of each pair."""
    rest = [c for c in fact.columns if c not in PAIR]
    last = fact.groupBy(*PAIR).agg(F.max(F.struct("loaded_at", "row_id", *[c for c in rest if c not in ("loaded_at", "row_id")])).alias("_r"))
    return last.select(*PAIR, *[F.col(f"_r.{c}").alias(c) for c in rest])


def number(c: str) -> Column:
    """A double without NaN."""
    return F.when(~F.isnan(c), F.col(c))


def tidy_query(
    fact: DataFrame,
    mice: Sequence[str] | None = None,
    sessions: Sequence[str] | None = None,
    features: Sequence[str] | None = None,
    matched_ids: Sequence[int] | None = None,
    significant: bool | None = None,
    mi_min: float | None = None,
    mi_max: float | None = None,
    pval_max: float | None = None,
    delay_sign: int | None = None,
    excluded_mice: Sequence[str] = (),
    anti_selectivity: bool | None = None,
) -> DataFrame:
    """Conjunction of the given predicates. Bounds are inclusive; naming mice overrides stored
    exclusions; anti_selectivity=True keeps pairs without signal ratio or with one above 1."""
    out = fact
    for name, values in (("mouse", mice), ("session", sessions), ("feature", features), ("matched_id", matched_ids)):
        if values is not None:
            out = out.filter(F.col(name).isin(list(values)))
    if mice is None and excluded_mice:
        out = out.filter(~F.col("mouse").isin(list(excluded_mice)))
    if significant is not None:
        out = out.filter(F.col("significant") == significant)
    if mi_min is not None:
        out = out.filter(number("me") >= mi_min)
    if mi_max is not None:
        out = out.filter(number("me") <= mi_max)
    if pval_max is not None:
        out = out.filter(number("pval") <= pval_max)
    if delay_sign is not None:
        out = out.filter(F.col("delay_sign") == delay_sign)
    if anti_selectivity:
        out = out.filter(number("signal_ratio").isNull() | (number("signal_ratio") > 1))
    return out


def significant_pairs(fact: DataFrame, me_least: float = ME_LEAST, pval_most: float = PVAL_MOST, forward_only: bool = False) -> DataFrame:
    """Pairs significant with me and pval strictly beyond the thresholds, and no signal ratio of 1 or less."""
    out = fact.filter(F.col("significant") & (number("me") > me_least) & (number("pval") < pval_most))
    out = out.filter(number("signal_ratio").isNull() | (number("signal_ratio") > 1))
    return out.filter(F.col("delay_sign") >= 0) if forward_only else out


def without(fact: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return fact.join(keys.select(*on).distinct(), list(on), "left_anti")


def only(fact: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return fact.join(keys.select(*on).distinct(), list(on), "left_semi")


def matched_in_all(fact: DataFrame) -> DataFrame:
    """Relational division: (mouse, matched_id) present in every session of the mouse."""
    seen = fact.filter(F.col("matched_id").isNotNull()).groupBy("mouse", "matched_id").agg(F.count_distinct("session").alias("n_sessions"))
    total = fact.groupBy("mouse").agg(F.count_distinct("session").alias("total"))
    return seen.join(total, "mouse").filter(F.col("n_sessions") == F.col("total")).select("mouse", "matched_id", "n_sessions")


def selective_counts(fact: DataFrame, k: int | None = None) -> DataFrame:
    """(mouse, session, n): neurons selective to k features (3 and more count as 3), or to any;
    complete over all mice and sessions, zeros included."""
    n = significant_pairs(fact).groupBy("mouse", "session", "neuron_idx").agg(F.count_distinct("feature").alias("n_sel"))
    if k is not None:
        n = n.filter(F.col("n_sel") == k) if k < 3 else n.filter(F.col("n_sel") >= k)
    counts = n.groupBy("mouse", "session").agg(F.count("*").alias("n"))
    # the dimension lists: every mouse with the one list of sessions
    names = fact.agg(F.collect_set("session").alias("_s"))
    grid = fact.select("mouse").distinct().crossJoin(names).select("mouse", F.explode("_s").alias("session"))
    return grid.join(counts, ["mouse", "session"], "left").na.fill(0, ["n"])


def fractions(fact: DataFrame) -> DataFrame:
    """(mouse, session, n, total, percent): share of selective neurons, two decimals, null where none."""
    total = fact.groupBy("mouse", "session").agg(F.count_distinct("neuron_idx").alias("total"))
    out = selective_counts(fact).join(total, ["mouse", "session"], "left").na.fill(0, ["total"])
    return out.withColumn("percent", F.when(F.col("total") > 0, F.round(100 * F.col("n") / F.col("total"), 2)))


def pivoted(counts: DataFrame, sessions: Sequence[str], value: str = "n") -> DataFrame:
    """Mouse rows, a column per named session."""
    return counts.groupBy("mouse").pivot("session", list(sessions)).agg(F.first(value))


def retention(fact: DataFrame, most: int) -> DataFrame:
    """(mouse, k, n): matched neurons selective to one and the same feature in at least k sessions;
    mouse 'total' sums up."""
    n = significant_pairs(fact).filter(F.col("matched_id").isNotNull()).groupBy("mouse", "matched_id", "feature").agg(F.count_distinct("session").alias("s"))
    each = n.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.col("s").cast("int"), F.lit(most))))).select("mouse", "k")
    rolled = each.rollup("k", "mouse").agg(F.count("*").alias("n"), F.grouping("mouse").alias("_g"), F.grouping("k").alias("_k"))
    return rolled.filter("_k = 0").select(F.when(F.col("_g") == 1, "total").otherwise(F.col("mouse")).alias("mouse"), "k", "n")


def selectivity_lists(fact: DataFrame) -> DataFrame:
    """(mouse, matched_id, session, features): sorted names, '---' if present but not selective and
    '' if absent from a session in which the mouse was recorded."""
    there = fact.filter(F.col("matched_id").isNotNull())
    sig = significant_pairs(there).groupBy("mouse", "matched_id", "session").agg(F.array_join(F.array_sort(F.collect_set("feature")), ", ").alias("names"))
    present = there.select("mouse", "matched_id", "session").distinct().withColumn("here", F.lit(True))
    grid = there.select("mouse", "matched_id").distinct().join(fact.select("mouse", "session").distinct(), "mouse")
    on = ["mouse", "matched_id", "session"]
    out = grid.join(present, on, "left").join(sig, on, "left")
    return out.select(*on, F.when(F.col("here").isNull(), "").otherwise(F.coalesce("names", F.lit("---"))).alias("features"))


def with_aggregates(fact: DataFrame, name: str, parts: Sequence[str]) -> DataFrame:
    """The fact plus rows of a feature that stands for several: mean me and least pval of the parts
    that are significant with me above the threshold, delay 0."""
    cols = ["mouse", "session", "neuron_idx", "matched_id", "feature", "significant", "me", "pval", "opt_delay"]
    some = fact.filter(F.col("feature").isin(list(parts)) & F.col("significant") & (number("me") > ME_LEAST))
    agg = some.groupBy("mouse", "session", "neuron_idx").agg(
        F.max("matched_id").alias("matched_id"), F.lit(name).alias("feature"), F.lit(True).alias("significant"), F.avg("me").alias("me"), F.min(number("pval")).alias("pval"), F.lit(0.0).alias("opt_delay")
    )
    return fact.select(*cols).unionByName(agg.select(*cols))


def set_changes(before: DataFrame, after: DataFrame, on: Sequence[str]) -> DataFrame:
    """(keys, change): kept, lost or gained between two sets of keys."""
    a, b = before.select(*on).distinct(), after.select(*on).distinct()
    parts = [(a.intersect(b), "kept"), (a.exceptAll(b), "lost"), (b.exceptAll(a), "gained")]
    out = [x.withColumn("change", F.lit(c)) for x, c in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def outer_compare(left: DataFrame, right: DataFrame, on: Sequence[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """Full outer merge of two tables: (keys, left, right, state)."""
    a, b = left.select(*on, F.col(value).alias("left_value")), right.select(*on, F.col(value).alias("right_value"))
    j = a.join(b, list(on), "full_outer")
    state = F.when(F.col("left_value").isNull(), "right only").when(F.col("right_value").isNull(), "left only").when(F.abs(F.col("left_value") - F.col("right_value")) <= tolerance, "same").otherwise("differs")
    return j.withColumn("state", state)


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Missing values take the last present one before them within keys, in order (which ends with a
    unique column); nulls before the first stay. Present values are counted in distributed order,
    and each count has one value, so no group passes through one task."""
    counted = running_sum(df.withColumn("_there", F.col(value).isNotNull().cast("long")), keys, order, "_there", "_c")
    present = counted.filter("_there = 1").select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_c").alias("_k_c"), F.col(value).alias("_v"))
    cond = F.col("_c") == F.col("_k_c")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return counted.join(present, cond, "left").withColumn(value, F.col("_v")).select(*df.columns)


def every_k(df: DataFrame, position: str, k: int) -> DataFrame:
    """Downsampling: every k-th position."""
    return df.filter(F.pmod(F.col(position), F.lit(k)) == 0)


def session_summary(batch: DataFrame) -> DataFrame:
    """Per rig: sessions, sums, mean and ratio of sums."""
    return batch.groupBy("rig").agg(
        F.count("*").alias("sessions"), F.sum("n_cells").alias("cells"), F.sum("n_significant_cells").alias("significant"),
        F.round(100 * F.sum("n_significant_cells") / F.sum("n_cells"), 4).alias("percent"), F.round(F.avg(number("mi_mean")), 6).alias("mi_mean"),
    )


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, kinds): number of different present values; 0 or 1 are columns to drop."""
    one = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column_name", "kinds")


def outliers(df: DataFrame, keys: Sequence[str], value: str, method: str, threshold: float) -> DataFrame:
    """Rows with a flag `outlier`: zscore (beyond threshold deviations, strict), iqr (outside
    threshold interquartile ranges, bounds inside), mad (1.4826 median deviations), quantile (outside
    the quantiles threshold and 1 - threshold, bounds inside). Quantiles are exact and come from the
    distributed order, so a group may be as large as the table."""
    v, keys = number(value), list(keys)

    def quantiles(rows: DataFrame, c: str, probs: Sequence[float]) -> DataFrame:
        """One column _q0, _q1, ... per probability."""
        q = order_statistics(rows, keys, c, probs)
        return q.groupBy(*keys).agg(*[F.max(F.when(F.col("prob") == p, F.col("result"))).alias(f"_q{i}") for i, p in enumerate(probs)])

    if method == "zscore":
        s = df.groupBy(*keys).agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))
        flag = ~(F.abs(v - F.col("_m")) < threshold * F.col("_s"))
    elif method == "iqr":
        s = quantiles(df, value, [0.25, 0.75])
        span = threshold * (F.col("_q1") - F.col("_q0"))
        flag = (v < F.col("_q0") - span) | (v > F.col("_q1") + span)
    elif method == "quantile":
        s = quantiles(df, value, [threshold, 1 - threshold])
        flag = (v < F.col("_q0")) | (v > F.col("_q1"))
    elif method == "mad":
        m = quantiles(df, value, [0.5]).withColumnRenamed("_q0", "_m")
        off = df.join(m, keys, "left").withColumn("_d", F.abs(v - F.col("_m")))
        s = m.join(quantiles(off, "_d", [0.5]), keys)
        flag = F.abs(v - F.col("_m")) > threshold * 1.4826 * F.col("_q0")
    else:
        raise ValueError(f"no such method: {method}")
    return df.join(s, keys, "left").withColumn("outlier", F.coalesce(flag, F.lit(False)))


def stats_slice(fact: DataFrame, stats: Sequence[str], units: Sequence[int] | None = None, features: Sequence[str] | None = None) -> DataFrame:
    """(pair, stat, value): the chosen statistics of the chosen units and features, a row each."""
    out = fact
    for name, values in (("neuron_idx", units), ("feature", features)):
        if values is not None:
            out = out.filter(F.col(name).isin(list(values)))
    return out.select(*PAIR, *[F.col(c).cast("double").alias(c) for c in stats]).unpivot(PAIR, list(stats), "stat", "value")


def where_all(df: DataFrame, conditions: Sequence[tuple[str, str, object]], allow_missing: bool = False) -> DataFrame:
    """Rows for which every (key, operator, value) holds; operators are =, > and <. Null and NaN meet
    no condition. A key that is no column is an error, or with allow_missing meets no condition."""
    compare = {"=": lambda c, v: c == v, ">": lambda c, v: c > v, "<": lambda c, v: c < v}
    every = F.lit(True)
    for key, op, value in conditions:
        if op not in compare:
            raise ValueError(f"no such operator: {op}")
        if key not in df.columns:
            if not allow_missing:
                raise KeyError(key)
            every = F.lit(False)
            continue
        kind = dict(df.dtypes)[key]
        every = every & F.coalesce(compare[op](number(key) if kind in ("double", "float") else F.col(key), F.lit(value)), F.lit(False))
    return df.filter(every)


def measure_by_count(fact: DataFrame, sessions: Sequence[str]) -> DataFrame:
    """(mouse, matched_id, mi_<session>..., n_<session>...): mean information of a matched neuron's
    significant pairs per session, and the number of features it is selective to (0: none)."""
    matched = fact.filter(F.col("matched_id").isNotNull())
    sig, on = significant_pairs(matched), ["mouse", "matched_id"]
    mi = matched.groupBy(*on).pivot("session", list(sessions)).agg(F.avg(number("me")))
    n = sig.groupBy(*on).pivot("session", list(sessions)).agg(F.count_distinct("feature"))
    mi = mi.withColumnsRenamed({s: f"mi_{s}" for s in sessions})
    return mi.join(n.withColumnsRenamed({s: f"n_{s}" for s in sessions}), on, "left").na.fill(0, [f"n_{s}" for s in sessions])


#: Rows of a sheet that annotates a table and may be broadcast.
SHEET_ROWS = 100_000


def annotated(df: DataFrame, sheet: DataFrame, on: Sequence[str]) -> DataFrame:
    """df with the columns of a sheet, null where it has no row; of several rows for one key the
    least holds. The sheet is broadcast if its counted rows are few, else the join shuffles."""
    rest = [c for c in sheet.columns if c not in on]
    one = sheet.dropna(subset=list(on)).groupBy(*on).agg(F.min(F.struct(*rest)).alias("_s"))
    if one.limit(SHEET_ROWS + 1).count() <= SHEET_ROWS:
        one = F.broadcast(one)
    return df.join(one, list(on), "left").select(*df.columns, *[F.col(f"_s.{c}").alias(c) for c in rest])


def participants_jaccard(members: DataFrame, group: str, member: Sequence[str]) -> DataFrame:
    """(group_a, group_b, common, united, jaccard) of the member sets of every two groups that share
    one; sizes come from counts, only shared members are joined."""
    m = members.select(group, F.struct(*member).alias("_m")).distinct()
    size = m.groupBy(group).agg(F.count("*").alias("_n"))
    both = m.select(F.col(group).alias("group_a"), "_m").join(m.select(F.col(group).alias("group_b"), "_m"), "_m").filter("group_a < group_b").groupBy("group_a", "group_b").agg(F.count("*").alias("common"))
    s = both.join(size.select(F.col(group).alias("group_a"), F.col("_n").alias("_a")), "group_a").join(size.select(F.col(group).alias("group_b"), F.col("_n").alias("_b")), "group_b")
    united = F.col("_a") + F.col("_b") - F.col("common")
    return s.select("group_a", "group_b", "common", united.alias("united"), (F.col("common") / united).alias("jaccard"))


class Exclusions:
    """Mice and matched neurons that queries leave out, kept as a small table in memory or, between
    sessions, as Parquet."""

    def __init__(self, spark, keys: DataFrame | None = None) -> None:
        self.spark = spark
        self.keys = keys if keys is not None else spark.createDataFrame([], "mouse string, matched_id int")

    def add(self, keys: DataFrame) -> Exclusions:
        return Exclusions(self.spark, self.keys.unionByName(keys.select("mouse", F.col("matched_id").cast("int").alias("matched_id"))).distinct())

    def remove(self, keys: DataFrame) -> Exclusions:
        gone = keys.select("mouse", F.col("matched_id").cast("int").alias("matched_id")).distinct()
        same = F.col("k.mouse").eqNullSafe(F.col("g.mouse")) & F.col("k.matched_id").eqNullSafe(F.col("g.matched_id"))
        return Exclusions(self.spark, self.keys.alias("k").join(gone.alias("g"), same, "left_anti"))

    def applied(self, fact: DataFrame) -> DataFrame:
        """fact without the excluded rows; a key without matched neuron excludes the whole mouse."""
        mice = self.keys.filter("matched_id is null").select("mouse").distinct()
        units = self.keys.filter("matched_id is not null")
        return fact.join(mice, "mouse", "left_anti").join(units, ["mouse", "matched_id"], "left_anti")

    def save(self, path: str) -> None:
        self.keys.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Exclusions:
        return cls(spark, spark.read.schema("mouse string, matched_id int").parquet(path))
