"""Entity-attribute-value rows into one typed row per entity.

Cells are told once, by one aggregation over entity and attribute, and stored as one narrow table per
attribute with the typed value and the state of each cell; all of them lie in the same buckets by
entity, so that they are joined as they lie, without another shuffle. They are combined through a
balanced tree of outer joins on the entity with FAN tables at each node. Each inner node is written
out: a single stage that joins all tables would hold a sort buffer for each of them at once. No table
is broadcast: each has up to a row per entity, and a small file may hold millions of them.

Defined results
- attribute names: case, surrounding blanks, blanks and hyphens don't matter; names that the type
  table lacks have no column and are left out; rows without entity or attribute are left out
- missing values (null, blank, nan, none, n/a): never a value, never a fault
- a cell without readable value is null; an entity without readable cells keeps its row of nulls
- of several readable values the latest by written_at holds, then the largest row_id
- an empty table gives an empty table with all columns; other columns of the input play no part
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import shared_dir

#: The texts that stand for a missing value.
MISSING = ["", "nan", "none", "n/a"]

SPARK_TYPES = {"string": "string", "double": "double", "bigint": "bigint", "boolean": "boolean", "timestamp": "timestamp_ntz"}

#: Tables that one node of the tree joins; a task holds so many sorted inputs at once, and one more.
FAN = 5
#: Attributes become columns of one plan; more than this need several calls.
MAX_ATTRIBUTES = 2_000


def bare(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def canonical_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(bare(c)), r"(?U)[\s\-]+", "_")


def is_missing(c: Column) -> Column:
    """Of a text from which surrounding blanks were taken."""
    return c.isNull() | F.lower(c).isin(MISSING)


def number_text(c: Column) -> Column:
    """The text of a readable number with a decimal point, else null."""
    inner = F.regexp_replace(c, r"^np\.\w+\(\s*(.*?)\s*\)$", "$1")
    point = F.regexp_replace(inner, ",", ".")
    return F.when(point.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), F.regexp_replace(point, r"^\+", ""))


def whole(text: Column) -> Column:
    """A number's text as a whole number, null if it has a fraction. In a lambda the text is worked
    out once; written out it would be repeated until the generated code is too long to be compiled."""
    plain = F.when(text.rlike(r"^-?\d+(\.0*)?$"), F.regexp_replace(text, r"\.0*$", "").try_cast("bigint"))
    real = text.try_cast("double")
    return F.coalesce(plain, F.when((real == F.floor(real)) & (F.abs(real) < 2.0**53), real.try_cast("bigint")))


def typed(c: Column, kind: str) -> Column:
    """A present text as the type, null where it can't be read."""
    if kind == "string":
        return c
    if kind == "double":
        # most are plain; the others are looked at more closely
        return F.when(c.rlike(r"^-?\d+(\.\d+)?$"), c.try_cast("double")).otherwise(number_text(c).try_cast("double"))
    if kind == "bigint":
        return F.when(c.rlike(r"^-?\d{1,18}$"), c.try_cast("bigint")).otherwise(F.transform(F.array(number_text(c)), whole)[0])
    if kind == "boolean":
        low = F.lower(c)
        return F.when(low.isin("true", "yes", "1", "np.true_"), True).when(low.isin("false", "no", "0", "np.false_"), False)
    if kind == "timestamp":
        return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}$"), c.try_cast("timestamp_ntz"))
    raise ValueError(f"no such type: {kind}")


def narrow_tables(clean: DataFrame, types: Mapping[str, str], buckets: int) -> DataFrame:
    """A table (entity_id, _attr, one value column per type, unreadable, conflict) that lies in
    one folder per attribute, each bucketed and sorted by entity. Aggregates combine before the shuffle,
    so an entity with very many rows sends one row per task and attribute."""
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in types.items() for x in pair]), F.col("_attr"))
    some = sorted(set(types.values()))
    # conditions on what is worked out here would be moved down and worked out twice: so rows are
    # kept until they are told
    rows = clean.withColumn("_kind", F.when(~F.col("_missing"), kind))
    rows = rows.select("entity_id", "_attr", "_kind", "written_at", "row_id", *[F.when(F.col("_kind") == t, typed(F.col("_text"), t)).alias(f"_{t}") for t in some])
    read = F.coalesce(*[F.col(f"_{t}").cast("string") for t in some]).isNotNull()
    told = rows.groupBy("entity_id", "_attr").agg(
        *[F.max(F.when(F.col(f"_{t}").isNotNull(), F.struct("written_at", "row_id", f"_{t}"))).getField(f"_{t}").alias(f"value_{t}") for t in some],
        F.max(F.when(F.col("_kind").isNotNull(), ~read)).alias("unreadable"),
        *[(F.min(f"_{t}") < F.max(f"_{t}")).alias(f"differ_{t}") for t in some],
    )
    differ = F.coalesce(*[F.col(f"differ_{t}") for t in some], F.lit(False))
    told = told.filter(F.col("unreadable").isNotNull())
    cells_ = told.select("entity_id", *[f"value_{t}" for t in some], "unreadable", (~F.col("unreadable") & differ).alias("conflict"), "_attr")
    # as many partitions as buckets: a task writes one file per attribute
    return bucketed(cells_.repartition(buckets, "entity_id"), buckets, ["_attr"])


def bucketed(df: DataFrame, buckets: int, by: list[str] | None = None) -> DataFrame:
    """df, which lies in as many partitions by entity, written to the shared folder in such buckets and
    read again: joins on the entity take the buckets as they are."""
    spark, name = df.sparkSession, f"wide_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(buckets, "entity_id").sortBy("entity_id")
    writer = writer.partitionBy(*by) if by else writer
    writer.option("path", os.path.join(shared_dir(spark), name)).saveAsTable(name)
    return spark.table(name)


def cells(rows: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """One row per entity, one column struct<value, unreadable, conflict> per attribute (null:
    the attribute has no present value)."""
    if len(types) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")
    spark = rows.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    clean = (
        rows.filter(F.col("entity_id").isNotNull() & F.col("attr_name").isNotNull())
        .withColumn("_attr", canonical_name(F.col("attr_name")))
        .withColumn("_text", bare(F.col("attr_value")))
        .select("entity_id", "_attr", "_text", is_missing(F.col("_text")).alias("_missing"), "written_at", "row_id")
    )
    spine = bucketed(clean.select("entity_id").distinct().repartition(buckets, "entity_id"), buckets)
    if not types:
        return spine
    narrow = narrow_tables(clean, types, buckets)

    def tree(names: list[str]) -> DataFrame:
        if len(names) <= FAN:
            # outer joins with the entity kept on the left, as every node holds each entity once: so
            # the partitioning by entity goes on from one join to the next, which that of a full
            # outer join doesn't
            node = spine
            for n in names:
                cell = F.struct(F.col(f"value_{types[n]}").alias("value"), "unreadable", "conflict")
                node = node.join(narrow.filter(F.col("_attr") == n).select("entity_id", cell.alias(n)).hint("merge"), "entity_id", "left_outer")
            return node
        step = -(-len(names) // FAN)
        parts = [bucketed(tree(names[i : i + step]), buckets) for i in range(0, len(names), step)]
        node = parts[0]
        for p in parts[1:]:
            node = node.join(p.hint("merge"), "entity_id", "left_outer")
        return node

    return tree(list(types))


def widen(rows: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """One row per entity_id with one typed column per attribute."""
    return cells(rows, types).select("entity_id", *[F.col(f"`{n}`.value").alias(n) for n in types])


def faults(rows: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """(entity_id, attr_name, problem) of the cells that are unreadable or in conflict."""
    per_cell = [
        F.struct(
            F.lit(n).alias("attr_name"),
            F.when(F.col(f"`{n}`.unreadable"), "unreadable").when(F.col(f"`{n}`.conflict"), "conflict").alias("problem"),
        )
        for n in types
    ]
    if not per_cell:
        return cells(rows, types).select("entity_id", F.lit("").alias("attr_name"), F.lit("").alias("problem")).limit(0)
    return (
        cells(rows, types)
        .select("entity_id", F.explode(F.filter(F.array(*per_cell), lambda x: x.problem.isNotNull())).alias("_x"))
        .select("entity_id", "_x.attr_name", "_x.problem")
    )


def type_table(types: DataFrame) -> dict[str, str]:
    """The attribute types as a mapping; the table is a schema, its size is checked."""
    rows = types.select("attr_name", "attr_type").dropna().distinct().orderBy("attr_name").limit(MAX_ATTRIBUTES + 1).collect()
    return {r.attr_name: r.attr_type for r in rows}
