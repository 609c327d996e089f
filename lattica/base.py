"""Tables that are read more than once, and folders for what a job stores meanwhile."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the shuffle files of a query go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only for a local session without it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes at the end of the session."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    target, fs = _hadoop(spark, path)
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


def delete(spark: SparkSession, path: str) -> None:
    target, fs = _hadoop(spark, path)
    fs.delete(target, True)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is run within it go when it ends. Plans must be made within it."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: written as Parquet to the shared folder and read again. It goes by ``drop``, or at the end of the session."""
    spark = df.sparkSession
    path = f"{fresh_folder(spark, 'table')}/rows"
    with cleaned(spark):
        df.select("*").write.parquet(path)  # a plan of its own, made under the setting
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more."""
    for t in tables:
        if t is not None and (path := t.__dict__.pop("_stored_at", None)):
            delete(t.sparkSession, path.removesuffix("/rows"))
