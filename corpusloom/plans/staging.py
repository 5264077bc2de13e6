"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SCOPES = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session, as in tests, gets one of its own if it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df and read it back: cuts lineage, survives lost executors, and fixes random partitionings.

    The table stays until the innermost clean_up() around the call ends; without one, until the folder is cleared.
    """
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    for scope in getattr(_SCOPES, "open", [])[-1:]:
        scope.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def clean_up(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the tables that this thread stages inside: for work whose result is written elsewhere, such as a batch of a stream."""
    scopes = _SCOPES.__dict__.setdefault("open", [])
    scopes.append([])
    try:
        yield
    finally:
        for name in scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
