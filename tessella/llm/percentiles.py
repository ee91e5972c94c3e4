"""Exact percentiles per group, also from parts that single days left behind.

A part is the table of distinct values and their counts of one day: parts of different days add up
without loss, so a percentile over put-together parts equals the percentile over all rows. Stated
error: none; a result is the linear interpolation between the two neighbouring order statistics in
double precision. The values are sorted over the whole cluster and found by per-partition counts
(operators.ordering), so no group passes through one task, however hot.

Defined results
- null and NaN values are left out; infinite ones take part as the least and greatest
- a row delivered again (same keys) counts once, on the day of its first delivery that has a value;
  rows with a null among the keys can't be told to be repeated and all count
- a group without values has no row; a group of one value has it at every percentile
- -0.0 and 0.0 are one value; null group keys form a group; an empty table gives an empty result
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.ordering import order_statistics

PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def once(rows: DataFrame, value: str, record: Sequence[str], loaded: str, unique: str, keep: Sequence[str]) -> DataFrame:
    """One row per record: keep, _value and _day of its first delivery with a value."""
    good = rows.filter(F.col(value).isNotNull() & ~F.isnan(value))
    unknown = F.lit(False)
    for c in record:
        unknown = unknown | F.col(c).isNull()
    more = [c for c in keep if c not in record]
    first = good.groupBy(*record, F.when(unknown, F.col(unique)).alias("_alone")).agg(F.min(F.struct(loaded, unique, value, *more)).alias("_first"))
    return first.select(*[F.col(f"_first.{c}").alias(c) if c in more else F.col(c) for c in keep], F.col(f"_first.{value}").cast("double").alias("_value"), F.to_date(f"_first.{loaded}").alias("_day"))


def day_parts(rows: DataFrame, keys: Sequence[str], value: str, record: Sequence[str], loaded: str = "loaded_at", unique: str = "row_id") -> DataFrame:
    """(keys, day, value, n): the parts of all days. Parts of other days may be added by union."""
    one = once(rows, value, record, loaded, unique, keys)
    return one.groupBy(*keys, F.col("_day").alias("day"), (F.col("_value") + F.lit(0.0)).alias("value")).agg(F.count("*").alias("n"))


def from_parts(parts: DataFrame, keys: Sequence[str], probs: Sequence[float] = PROBS) -> DataFrame:
    """(keys, prob, n, value) from parts of any days; keys may include day."""
    return order_statistics(parts, keys, "value", probs, "n").select(*keys, "prob", "n", F.col("result").alias("value"))


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, record: Sequence[str], loaded: str = "loaded_at", unique: str = "row_id", probs: Sequence[float] = PROBS) -> DataFrame:
    """(keys, prob, n, value) over all rows at once."""
    return order_statistics(once(rows, value, record, loaded, unique, keys), keys, "_value", probs).select(*keys, "prob", "n", F.col("result").alias("value"))
