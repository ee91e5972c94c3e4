"""Distributed order: sorted partitions, their counts and offsets, and what follows from them.

All of it works on range partitions, so a group may be as large as the table: its rows lie in
consecutive partitions and only the counts of (partition, group) meet in one place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.session import cut, written

#: Rows of (partition, group) counts or targets that may be broadcast.
SMALL_ROWS = 200_000


def _codes(table: pa.Table | pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """True where a row's keys differ from the row before (nulls equal nulls)."""
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
    columns = [table.column(k) for k in keys]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    while columns:
        column = columns.pop()
        if pa.types.is_struct(column.type):
            columns += column.flatten()
            continue
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _running_within(frame: pd.DataFrame, w: np.ndarray, carry: dict[tuple, int]) -> np.ndarray:
    """Running weight of each row within its group, wherever its rows lie; carry: the sums so far."""
    group = frame.groupby(list(frame.columns), dropna=False, sort=False)
    code = group.ngroup().to_numpy()
    names = frame.iloc[np.unique(code, return_index=True)[1]].astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None)
    names = list(names)
    end = pd.Series(w).groupby(code).cumsum().to_numpy() + np.array([carry.get(k, 0) for k in names], np.int64)[code]
    for k, total in zip(names, pd.Series(end).groupby(code).last().to_numpy().tolist()):
        carry[k] = total
    return end


def sorted_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str | None = None, in_place: bool = False, sub: Sequence[str] = ()) -> DataFrame:
    """df range-partitioned and sorted by keys and order, written out, with columns _pid (the
    partition) and _end (running weight within partition and group, the row's own included).
    in_place: reading it gives the very partitions again, in order; else it is a compressed table
    and only _pid tells the partition. sub: with it also _sub_end, the running weight within the
    partition's rows of equal keys and sub, in the same order."""
    ranged = (
        df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in [*keys, *order]])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in [*keys, *order]])
        .withColumn("_pid", F.spark_partition_id())
    )
    schema = T.StructType([*ranged.schema.fields, *(T.StructField(c, T.LongType()) for c in ["_end", *["_sub_end"] * bool(sub)])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, carried = None, 0, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            first = tuple(batch.column(k)[0].as_py() for k in keys)
            new = _codes(batch, keys)
            w = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64) if weight else np.ones(batch.num_rows, np.int64)
            carry = total if last == first else 0
            c = np.cumsum(w)
            starts = np.flatnonzero(new)
            base = np.repeat(c[starts] - w[starts], np.diff(np.append(starts, len(c))))
            end = c - base
            stop = starts[1] if len(starts) > 1 else len(c)
            end[:stop] += carry
            last, total = tuple(batch.column(k)[-1].as_py() for k in keys), int(end[-1])
            more = [pa.array(_running_within(pd.DataFrame({c: batch.column(c).to_pandas() for c in [*keys, *sub]}), w, carried))] if sub else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(end), *more], names=schema.names)

    out = ranged.mapInArrow(run, schema)
    return cut(out) if in_place else df.sparkSession.read.schema(schema).parquet(written(out))


def offsets(runs: DataFrame, keys: Sequence[str], end: str = "_end") -> DataFrame:
    """One row per (_pid, keys): _count in the partition, _before in earlier partitions, _total."""
    counts = runs.groupBy("_pid", *keys).agg(F.max(end).alias("_count"))
    w = Window.partitionBy(*keys).orderBy("_pid")
    return counts.withColumn("_before", F.sum("_count").over(w) - F.col("_count")).withColumn(
        "_total", F.sum("_count").over(Window.partitionBy(*keys))
    )


def _join(left: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Null-safe equi-join; the small side is broadcast only after its rows were counted."""
    small = small.select(*[F.col(c).alias(f"_r_{c}" if c in on else c) for c in small.columns])
    if small.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        small = F.broadcast(small)
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    every = cond[0]
    for c in cond[1:]:
        every = every & c
    return left.join(small, every).drop(*[f"_r_{c}" for c in on])


def global_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_rank") -> DataFrame:
    """df with a 0-based position of each row within its keys, ordered by order (ties need a
    unique last column). No group passes through one task."""
    runs = sorted_runs(df, keys, order)
    off = cut(offsets(runs, keys)).select("_pid", *keys, "_before")
    return _join(runs, off, ["_pid", *keys]).withColumn(name, F.col("_before") + F.col("_end") - 1).drop("_pid", "_end", "_before")


def _statistics(runs: DataFrame, keys: Sequence[str], probs: Sequence[float], end: str) -> DataFrame:
    """Order statistics of value counts (_v, _n) in sorted runs, by the running counts in end."""
    off = cut(offsets(runs, keys, end))
    targets = (
        off.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_h", (F.col("_total") - 1) * F.col("_p"))
        .withColumn("_k", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))))
        .filter((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_count")))
        .select("_pid", *keys, "_total", "_p", "_h", "_k", (F.col("_k") - F.col("_before")).alias("_at"))
    )
    found = _join(runs, targets, ["_pid", *keys]).filter((F.col("_at") < F.col(end)) & (F.col("_at") >= F.col(end) - F.col("_n")))
    return (
        found.groupBy(*keys, F.col("_p").alias("prob"))
        .agg(F.first("_total").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.first("_h").alias("_h"))
        .withColumn("result", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("_h") - F.floor("_h"))))
        .drop("_h")
    )


def _value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None) -> DataFrame:
    good = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    # -0.0 and 0.0 are one value
    return good.groupBy(*keys, (F.col(value) + F.lit(0.0)).alias("_v")).agg((F.sum(weight) if weight else F.count("*")).cast("long").alias("_n"))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], weight: str | None = None) -> DataFrame:
    """Exact percentiles per group: keys, n, prob, lo, hi, result.

    Equal values are counted before anything is sorted; the distinct values are sorted over the
    whole cluster; the counts per partition give each group's offsets, from these the partition and
    place of the order statistics at floor and ceil of (n - 1) * prob, and only those rows are
    fetched and interpolated. The result equals linear interpolation between closest ranks.
    Null and NaN values are left out; a group without values has no row; infinities sort as numbers
    and an interpolation between two equal ones gives that value.
    """
    return _statistics(sorted_runs(_value_counts(df, keys, value, weight), keys, ["_v"], "_n"), keys, probs, "_end")


def nested_order_statistics(df: DataFrame, keys: Sequence[str], sub: Sequence[str], value: str, probs: Sequence[float], sub_probs: Sequence[float], weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """order_statistics over keys, and over keys and sub, of one sort."""
    runs = sorted_runs(_value_counts(df, [*keys, *sub], value, weight), keys, ["_v", *sub], "_n", sub=sub)
    return _statistics(runs, keys, probs, "_end"), _statistics(runs, [*keys, *sub], sub_probs, "_sub_end")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str, name: str = "running") -> DataFrame:
    """df with the sum of a whole-number weight up to and including each row, in order within keys."""
    runs = sorted_runs(df, keys, order, weight)
    off = cut(offsets(runs, keys)).select("_pid", *keys, "_before")
    return _join(runs, off, ["_pid", *keys]).withColumn(name, F.col("_before") + F.col("_end")).drop("_pid", "_end", "_before")
