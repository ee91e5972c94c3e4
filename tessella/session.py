"""Session factory and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's session is used."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tessella")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The session's own setting holds; only where none is set and all
    runs in this process (tests, a laptop) a temporary folder is chosen. On a cluster a machine's own
    folder would be lost with it, so there it is an error."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if there is None:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="tessella-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(there)
    return there.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from the written copy (reliable checkpoint)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, by: list[str] | None = None) -> str:
    """Write df as Parquet into the shared folder, partitioned by the given columns; the path."""
    path = os.path.join(shared_dir(df.sparkSession), f"table-{uuid.uuid4().hex}")
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
