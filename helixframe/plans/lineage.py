"""Tables in the shared folder: they cut lineage, and are deleted once what was made of them is written."""

from __future__ import annotations

import contextlib
import functools
import math
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir; below the warehouse where that is unset (local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{(root or spark.conf.get('spark.sql.warehouse.dir') + '/_shared').rstrip('/')}/helix-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: nothing is computed again, even if executors are lost.

    Spark then knows the table's size, so that it broadcasts it in a join if it is small by
    spark.sql.autoBroadcastJoinThreshold and shuffles both sides if it is not.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize(), or those that a table was made of and names as scratch_tables. Only for tables that no later plan reads any more."""
    for t in [x for t in tables for x in getattr(t, "scratch_tables", [t])]:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.scratch_folder)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """key set to value inside the with block."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def shuffles_deleted(f):
    """f(..., df, ...), df being a table or what holds one as sa or links, in which every action deletes the files of its shuffles when it ends: what materialize() wrote needs them no more.

    Else they stay until the driver's garbage collector finds that nothing refers to them.
    """

    @functools.wraps(f)
    def run(*args, **named):
        held = next(t for x in args for t in (x, getattr(x, "sa", None), getattr(x, "links", None)) if hasattr(t, "sparkSession"))
        with setting(held.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            return f(*args, **named)

    return run


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, in whatever store Spark finds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


#: Bytes of a shuffle that one task should get.
TASK_BYTES = 64 << 20


def partitions_for(spark: SparkSession, size: int) -> int:
    """Partitions of a shuffle of so many bytes: spark.sql.shuffle.partitions, or more if tasks would get too much."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))


def fresh(taken: list[str], name: str) -> str:
    """name, or name with underscores before it, so that no column in `taken` has it (Spark ignores case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name
