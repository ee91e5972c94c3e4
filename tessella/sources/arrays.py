"""Archives of named arrays (.npz) as a data source: rows (file, name, component, t, value).

    spark.dataSource.register(ArrayArchive)
    spark.read.format("arrays").load("/folder/of/archives")

Pickled objects are never loaded. A file is one partition; big archives are read array by array.
"""

from __future__ import annotations

import glob
import os
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, name string, component int, t bigint, value double"
STEP = 65_536


class Archive(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class ArrayReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(self.path, "**", "*.npz"), recursive=True)) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [Archive(f) for f in files]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        base = os.path.basename(partition.path)
        with zipfile.ZipFile(partition.path) as z:
            names = [n[:-4] for n in z.namelist() if n.endswith(".npy")]
        with np.load(partition.path, allow_pickle=False) as archive:
            for name in names:
                try:
                    a = archive[name]
                except ValueError:  # objects
                    continue
                if a.dtype.kind not in "biuf" or a.ndim not in (1, 2):
                    continue
                for c, row in enumerate(np.atleast_2d(a)):
                    for k in range(0, len(row), STEP):
                        v = row[k : k + STEP].astype(float)
                        yield pa.RecordBatch.from_pydict(
                            {"file": [base] * len(v), "name": [name] * len(v), "component": pa.array(np.full(len(v), c, np.int32)), "t": pa.array(np.arange(k, k + len(v))), "value": pa.array(v)}
                        )


class ArrayArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArrayReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("a path is needed")
        return ArrayReader(path.removeprefix("file:"))


def catalogue_rows(df: DataFrame, id_: str, array: str) -> DataFrame:
    """(id, t, value): the elements of an array column as rows; null arrays and null elements have none."""
    return df.select(F.col(id_).alias("id"), F.posexplode(F.col(array)).alias("t", "value")).filter("value is not null").select("id", "t", F.col("value").cast("double").alias("value"))


def from_arrays(spark: SparkSession, arrays: dict[str, np.ndarray]) -> DataFrame:
    """(name, component, t, value): named arrays of one or two dimensions as rows; a two-dimensional
    one has a component per row. Values that are no numbers, and null, are left out."""
    rows = []
    for name, a in arrays.items():
        x = np.atleast_2d(np.asarray(a, float))
        if x.ndim != 2:
            raise ValueError(f"{name} has more than two dimensions")
        rows += [(name, k, line.tolist()) for k, line in enumerate(x)]
    df = spark.createDataFrame(rows, "name string, component int, line array<double>")
    return df.select("name", "component", F.posexplode("line").alias("t", "value")).filter(~F.isnan("value")).withColumn("t", F.col("t").cast("long"))
