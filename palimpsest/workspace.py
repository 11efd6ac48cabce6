"""Intermediate tables in the folder that the cluster shares.

Long plans are cut by writing a table and reading it again: the written files
survive a lost executor, and no later job recomputes what they hold.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def workspace(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; removed when the driver ends.

    Where that setting is absent, a local master gets a temporary folder; a
    cluster must name a shared one.
    """
    context = spark.sparkContext
    key = context.applicationId
    if key not in _FOLDERS:
        base = context.getConf().get("spark.checkpoint.dir")
        if not base:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        _FOLDERS[key] = f"{base.rstrip('/')}/palimpsest-{key}"
        atexit.register(_remove, spark, _FOLDERS[key])
    return _FOLDERS[key]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` once to the shared folder and return what reads it back."""
    path = new_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
