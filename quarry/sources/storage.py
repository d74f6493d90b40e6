"""The folder that driver and executors share, and tables written to it between passes."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is unset and driver and executors are one process."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and context._jsc.sc().getCheckpointDir().isDefined():
        named = context._jsc.sc().getCheckpointDir().get()
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder there that driver and executors share")
        named = tempfile.mkdtemp(prefix="quarry-shared-")
        context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, below a folder of this application that goes when the driver ends."""
    context = spark.sparkContext
    root = f"{shared_dir(spark)}/quarry-{context.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_delete, context._jvm, context._jsc.hadoopConfiguration(), root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


_roots: set[str] = set()


def _delete(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):  # the driver's JVM may be gone already
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(conf).delete(hadoop, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later passes reuse it, lost executors cost a re-read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def discard(*stored: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for df in stored:
        context = df.sparkSession.sparkContext
        _delete(context._jvm, context._jsc.hadoopConfiguration(), df._quarry_path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark knows exists."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def rename(spark: SparkSession, path: str, to: str) -> None:
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    if not source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target):
        raise OSError(f"cannot rename {path} to {to}")
