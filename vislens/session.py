"""Session defaults and the few helpers that need the session itself."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own configuration."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vislens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("VISLENS_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or under the folder given to setCheckpointDir.

    Without either, a local master gets a temporary folder; on a cluster each
    executor would write to its own disk, so that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="vislens-")
    return f"{shared.rstrip('/')}/vislens-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, **options) -> DataFrame:
    """Write the frame once as a table in the shared folder, with the writer's options, and read it back.

    For frames that are read several times: computed once, pruned by column when
    read, and independent of the executors that made it.
    """
    path = f"{shared_dir(df.sparkSession)}/table"
    df.write.mode("errorifexists").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collect_bounded(df: DataFrame, max_rows: int, max_bytes: int):
    """Arrow table of `df` if it has at most `max_rows` rows and `max_bytes` bytes, else None."""
    table = df.limit(max_rows + 1).toArrow()
    return table if table.num_rows <= max_rows and table.nbytes <= max_bytes else None
