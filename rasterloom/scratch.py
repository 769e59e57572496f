"""Tables written once and read many times, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: dict[str, SparkSession] = {}


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only in local mode without such a setting, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="rasterloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def folder(spark: SparkSession, label: str) -> str:
    """A new folder's place, cleared at the end of the session."""
    path = f"{root(spark)}/rasterloom-{label}-{uuid.uuid4().hex}"
    _paths[path] = spark
    return path


def settled(df: DataFrame, label: str) -> DataFrame:
    """Write and read back: cuts lineage, and a lost executor costs only its running tasks."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for path, spark in list(_paths.items()):
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended
            pass
        _paths.pop(path, None)
