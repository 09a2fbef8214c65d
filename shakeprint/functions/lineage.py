"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir; it goes when the driver ends, or by clean(). Where the setting
    is unset, only a local master gets a folder of its own: on a cluster nothing else is known to be shared."""
    context = spark.sparkContext
    app = context.applicationId
    if app not in _FOLDERS:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _FOLDERS[app] = f"{(root or tempfile.mkdtemp(prefix='shakeprint-')).rstrip('/')}/shakeprint-{app}"
        atexit.register(_clean_quietly, spark)
    return _FOLDERS[app]


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store, if it is there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Removes all that this application materialised; DataFrames made from it can't be read any more."""
    if path := _FOLDERS.get(spark.sparkContext.applicationId):
        remove(spark, path)


def _clean_quietly(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            clean(spark)
    except Exception:  # the session may have ended before
        return


def materialise(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back, so lost executors cost no recomputation."""
    return materialise_at(df)[0]


def materialise_at(df: DataFrame) -> tuple[DataFrame, str]:
    """materialise(df) and its folder, to be removed once nothing reads it."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise_freed(df: DataFrame) -> DataFrame:
    """materialise(df), and the shuffle files that it took are removed as soon as it is written."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return materialise(df)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
