"""CSV tables of the cross-session layer and the Parquet layout of results."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.relational import forward_fill

#: Keys of a statistics cell, and of a significance cell.
STATS = "me double, pval double, opt_delay double, signal_ratio double, rval double, pre_rval double, rel_me_beh double, rel_me_ca double, data_hash string"
SIGNIFICANCE = "stage1 boolean, stage2 boolean, shuffles1 bigint, shuffles2 bigint, final_p_thr double, multicomp_corr string"


def cell_table(spark: SparkSession, path: str, cell: str, pattern: str = r"([^/]+)_([^/_]+)_([^/_]+)\.csv$") -> DataFrame:
    """(prefix, mouse, session, neuron_idx, feature, cell): CSV files with a row per neuron and a
    column per feature, whose cells are dictionaries written as Python or JSON. The file's name
    gives prefix, mouse and session. Cells that can't be read are null."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    first, rest = raw.columns[0], raw.columns[1:]
    file = F.col("_metadata.file_path")
    names = [F.regexp_extract(file, pattern, k + 1).alias(n) for k, n in enumerate(("prefix", "mouse", "session"))]
    long = raw.select(*names, F.col(first).try_cast("int").alias("neuron_idx"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("text")) for c in rest])).alias("_c"))
    # a Python literal becomes JSON: quotes, truth values, None, nan and numpy wrappers
    text = F.regexp_replace("_c.text", r"np\.\w+\(([^()]*)\)", "$1")
    for a, b in ((r"'", '"'), (r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r"\b(None|nan|inf|-inf)\b", "null"), (r"\bnp\.", "")):
        text = F.regexp_replace(text, a, b)
    return long.select("prefix", "mouse", "session", "neuron_idx", F.col("_c.feature").alias("feature"), F.from_json(text, cell).alias("cell")).filter("cell is not null")


def tidy_pairs(stats: DataFrame, significance: DataFrame, matching: DataFrame | None = None) -> DataFrame:
    """The selectivity fact from statistics and significance cells: pairs without significance are
    not significant; the sign of the delay; matched ids where there are any."""
    on = ["mouse", "session", "neuron_idx", "feature"]
    sig = significance.groupBy(*on).agg(F.max(F.coalesce("cell.stage2", F.lit(False))).alias("significant"))
    s = stats.select(*on, "cell.me", "cell.pval", "cell.opt_delay", "cell.signal_ratio")
    out = s.join(sig, on, "left").withColumn("significant", F.coalesce("significant", F.lit(False))).withColumn("delay_sign", F.signum("opt_delay").cast("int"))
    return out.join(matching, ["mouse", "session", "neuron_idx"], "left") if matching is not None else out.withColumn("matched_id", F.lit(None).cast("int"))


def matching_table(spark: SparkSession, path: str, sessions: list[str], separator: str | None = None) -> DataFrame:
    """(mouse, matched_id, session, neuron_idx): files without header, a row per matched neuron and a
    column per session, 0 for absent; the file's name is the mouse. The row's place is its id. Without
    a separator the one that the first line suggests is taken."""
    separator = re.escape(separator or separator_of(spark, path))
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1).alias("mouse"), F.split("value", r"\r?\n").alias("_l"))
    rows = lines.select("mouse", F.posexplode("_l").alias("matched_id", "_t")).filter("trim(_t) <> ''").withColumn("_f", F.split("_t", separator))
    long = rows.select("mouse", "matched_id", F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in sessions]).alias("session"), F.transform("_f", lambda x: F.trim(x).try_cast("int")).alias("n"))).alias("_z"))
    return long.select("mouse", "matched_id", F.col("_z.session").alias("session"), F.nullif(F.col("_z.n"), F.lit(0)).alias("neuron_idx")).filter("neuron_idx is not null and session is not null")


def metadata_sheet(spark: SparkSession, path: str, order: str, fill: list[str]) -> DataFrame:
    """A CSV sheet whose empty cells repeat the one above."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    for c in fill:
        df = forward_fill(df, [], [order], c)
    return df


def write_results(tables: dict[str, DataFrame], path: str, by: dict[str, list[str]] | None = None) -> None:
    """A folder per table; a table that is there already is left alone (cache or build)."""
    for name, df in tables.items():
        df.write.mode("ignore").partitionBy(*(by or {}).get(name, [])).parquet(f"{path}/{name}")


def read_results(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_wide_csv(df: DataFrame, path: str, rows: list[str], column: str, columns: list[str], value: str, sheet: str | None = None) -> None:
    """A pivoted table as CSV; one folder per value of sheet."""
    keys = [*rows, *([sheet] if sheet else [])]
    wide = df.groupBy(*keys).pivot(column, columns).agg(F.first(value))
    (wide.write.partitionBy(sheet) if sheet else wide.write).mode("overwrite").option("header", True).csv(path)


def built(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at a path; build() makes it if there is none yet (cache or build)."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        build().write.mode("error").parquet(path)
        return spark.read.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """A line of JSON per row, nulls included, so that every row has every field."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def separator_of(spark: SparkSession, path: str, candidates: str = ",;\t|") -> str:
    """The candidate that splits the first line of a file into most fields; the first one among equals."""
    line = (spark.read.text(path).limit(1).collect() or [("",)])[0][0]
    return max(candidates, key=line.count)
