"""Intermediate tables that outlive the executors that made them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path under ``spark.checkpoint.dir``, which all executors see.

    Where that is unset and Spark runs inside one process, as in tests, a temporary folder is made and set; elsewhere it is an error.
    """
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or (lambda d: d.get() if d.isDefined() else None)(context._jsc.sc().getCheckpointDir())
    if not top:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        top = context._jsc.sc().getCheckpointDir().get()
    return f"{top.rstrip('/')}/t-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later steps don't recompute it, and lost executors don't lose it."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(*frames: DataFrame | None) -> None:
    """Deletes tables made by ``stored`` that no later step reads."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path is not None:
            folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
