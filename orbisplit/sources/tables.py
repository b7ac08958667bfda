"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN_ROOT = "orbisplit.shared.dir"
#: The folder of a session's work tables, below the shared one.
RUN = "orbisplit.run.dir"


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset a folder of its own, on one machine only: executors elsewhere would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_ROOT, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="orbisplit-")
        spark.conf.set(OWN_ROOT, root)
    return root.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this session's work tables; it is deleted when the driver ends, or by ``drop_work``."""
    found = spark.conf.get(RUN, None)
    if not found:
        found = f"{shared_root(spark)}/orbisplit/run-{uuid.uuid4().hex}"
        path, files = _path(spark, found)
        files.mkdirs(path)
        files.deleteOnExit(path)
        spark.conf.set(RUN, found)
    return found


def work_dir(spark: SparkSession, name: str) -> str:
    """A path for one table of one run, below the session's folder; nothing else writes there."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write and read again: lineage ends, loops don't grow the plan, and a lost executor loses nothing."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def delete(spark: SparkSession, path: str) -> None:
    p, files = _path(spark, path)
    files.delete(p, True)


def drop_work(spark: SparkSession) -> None:
    """Delete the session's work tables: for when the results that were read from them are written."""
    found = spark.conf.get(RUN, None)
    if found:
        delete(spark, found)
        spark.conf.unset(RUN)
