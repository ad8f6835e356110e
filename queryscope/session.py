"""Session defaults shared by the tests, the bench and interactive use."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# used by sessions on one machine that name no shared folder
LOCAL_SHARED = "file:///tmp/checkpoints"


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "queryscope") -> SparkSession:
    """A UTC session with adaptive execution; on a cluster use the one you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # HotSpot never compiles methods above 8000 bytes, so wide projections go back to split code
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", os.environ.get("QUERYSCOPE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names: the session's setting, else one set on the context."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, as a URI that driver and executors see alike.

    A session on a single machine (``local[..]``) that names no folder gets one of
    its own; a cluster that names none is an error, since each executor would write to its own disk.
    """
    base = checkpoint_dir(spark)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = LOCAL_SHARED
    return f"{base.rstrip('/')}/queryscope/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, and a lost executor costs nothing already stored."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
