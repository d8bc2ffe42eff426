"""Cutting lineage through storage that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one of this machine only where the master is local."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexgrain-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result no longer depends on earlier shuffles or executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Open scopes of this thread of the driver, the outermost first; each holds the folders that were stored within it.
_SCOPES: ContextVar[tuple[dict[str, SparkSession], ...]] = ContextVar("scopes", default=())


def _file_system(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for tables that are written in several steps; what lies there goes when the application ends."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, path = _file_system(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: a compact, columnar lineage cut.

    The table goes with :func:`discard`, or else when the application ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, path = _file_system(spark, folder)
    df.write.option("compression", "zstd").parquet(folder)
    files.deleteOnExit(path)
    for scope in _SCOPES.get():
        scope[folder] = spark
    return spark.read.schema(df.schema).parquet(folder)


def discard(*tables: DataFrame) -> None:
    """Remove the files behind tables made by :func:`stored`; nothing may read them afterwards."""
    for df in tables:
        for name in _folders(df):
            files, path = _file_system(df.sparkSession, name)
            files.delete(path, True)


def _folders(df: DataFrame) -> set[str]:
    return {f.rpartition("/")[0] for f in df.inputFiles()}


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """At its end, removes the tables that were stored within it, but for those given to the function it yields.

    Scopes belong to the thread that opens them: what other threads store meanwhile is theirs.
    """
    made: dict[str, SparkSession] = {}

    def keep(df: DataFrame) -> DataFrame:
        for folder in _folders(df):
            for own in [f for f in made if folder.endswith(f.rpartition("/")[2])]:
                del made[own]
        return df

    token = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield keep
    finally:
        _SCOPES.reset(token)
        for folder, spark in made.items():
            files, path = _file_system(spark, folder)
            files.delete(path, True)
