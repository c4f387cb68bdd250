"""Session defaults, table access and reliable lineage cuts shared by every package."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("webstrata")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is set and the driver does all the work (tests)."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share: a machine's own one would lose tables")
    where = named or os.path.join(tempfile.gettempdir(), "webstrata-checkpoints")
    sc.setCheckpointDir(where)
    return where


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared checkpoint folder, so that a lost executor never costs a restart."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared checkpoint folder: for larger intermediates read more than once."""
    where = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of ``rows`` at most, where whole texts pass through Python: what a worker holds is a few such batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > rows or int(spark.conf.get(name, "10000")) <= 0:
        spark.conf.set(name, str(rows))
