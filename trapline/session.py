"""Session defaults and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "trapline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; for scripts and tests."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the configured checkpoint folder.

    Only a local master without the setting gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="trapline-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts lineage and survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, rows_per_task: int = 5_000, most: int | None = None) -> DataFrame:
    """Enough partitions for iterative work on an input of so many rows.

    Inputs that already have as many partitions stay as they are; without ``most``, at
    scale that is every input. With it a task gets about ``most`` rows, so tasks grow in number, not in size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = min(cores, -(-rows // rows_per_task))
    if most is not None:
        wanted = max(wanted, -(-rows // most))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
