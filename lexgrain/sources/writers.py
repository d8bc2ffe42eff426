"""Writers: append, partition replacement, versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def append_new(df: DataFrame, path: str, *key: str) -> None:
    """Append the rows whose key the table at ``path`` does not have; an absent table is made."""
    from ..operators.dml import new_rows

    spark = df.sparkSession
    fs, p = _fs(df, path)
    out = new_rows(df, spark.read.parquet(path), *key) if fs.exists(p) else df.dropDuplicates(list(key))
    out.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def bucketed(df: DataFrame, name: str, path: str, buckets: int, *key: str) -> DataFrame:
    """``df`` as table ``name`` at ``path`` in ``buckets`` files by a hash of ``key``, each sorted by it.

    Tables in as many buckets of the same keys join, and group by them, without an exchange; a lookup of a key reads one file, and of
    that the row groups whose minima, maxima and bloom filter allow it. Choose ``buckets`` for the table's size: a file is one task.
    """
    blooms = {f"parquet.bloom.filter.enabled#{k}": "true" for k in key}
    dealt = df.repartition(buckets, *key)  # the same hash: each task writes one bucket
    dealt.write.bucketBy(buckets, *key).sortBy(*key).options(path=path, **blooms).saveAsTable(name)
    return df.sparkSession.table(name)


CURRENT = "_CURRENT"


def publish(df: DataFrame, path: str) -> None:
    """Write ``df`` as a new version under ``path`` and make it the current one; ``df`` may read the version before.

    Readers follow a pointer file, which one rename replaces: they see the old version or the new one, at any time. The
    version before the last stays for readers that began with it; older ones are removed.
    """
    jvm = df.sparkSession.sparkContext._jvm
    fs, root = _fs(df, path)
    version, before = f"v-{uuid.uuid4().hex}", current(df.sparkSession, path)
    df.write.parquet(f"{path}/{version}")
    fresh, pointer = jvm.org.apache.hadoop.fs.Path(root, f"{CURRENT}.{version}"), jvm.org.apache.hadoop.fs.Path(root, CURRENT)
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri())
    overwrite = df.sparkSession.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(pointer), overwrite)
    for f in fs.listStatus(root):
        if f.isDirectory() and f.getPath().getName() not in (version, before):
            fs.delete(f.getPath(), True)


def current(spark: SparkSession, path: str) -> str | None:
    """The name of the current version of a published table; None where there is none."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    pointer = jvm.org.apache.hadoop.fs.Path(root, CURRENT)
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _fs(df: DataFrame, path: str):
    sc = df.sparkSession.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p
