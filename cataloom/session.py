"""Session settings and the shared folder for written intermediate results."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "16g") -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("cataloom")
             .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.sql.adaptive.enabled", "true")
             # small test tables: keep the cores busy where a join multiplies few bytes into many rows
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", memory)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: `spark.checkpoint.dir`, or the checkpoint folder set on the context.

    Without either, a session on one machine gets a temporary folder; a cluster must name one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cataloom-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/cataloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a result once and read it back: later uses neither recompute it nor depend on an executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
