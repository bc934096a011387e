"""Session helpers: where intermediate tables go and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this process, for ``release``.
_WRITTEN: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the session's checkpoint folder.

    A folder of our own is set only where the session names none and all tasks run in this process, as in unit
    tests. On a cluster the setting is required: each executor would write to its own disk otherwise.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table and read it back, for results that several branches reuse.

    The table lives on shared storage, so a lost executor costs a re-read and not a recomputation,
    and every reader keeps column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


class BucketedTable:
    """A stored table that grows by appends and is bucketed by ``keys``, so that joins on them leave its rows where they are.

    It lies in the work folder under a name of its own in the session's catalog. ``release`` deletes its files.
    """

    def __init__(self, spark: SparkSession, label: str, keys: Sequence[str]):
        self.spark, self.keys, self.name = spark, list(keys), f"{label}_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = f"{work_dir(spark)}/{self.name}"
        _WRITTEN.append(self.path)

    def append(self, df: DataFrame) -> None:
        (df.repartition(self.buckets, *self.keys).write.format("parquet").mode("append").bucketBy(self.buckets, *self.keys)
         .option("path", self.path).saveAsTable(self.name))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Spark hand at most ``rows`` rows at a time to Python functions, for tables of long texts.

    A batch is held several times over, by the JVM's Arrow buffers and by Python. The setting stays for the session.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def written() -> tuple[str, ...]:
    """Folders of the tables that ``materialize`` has written and that have not been released."""
    return tuple(_WRITTEN)


def release(spark: SparkSession, paths: Iterable[str] | None = None) -> int:
    """Delete tables that ``materialize`` has written, all or those at ``paths``; call it when no result reads them any more."""
    jvm, conf, gone = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for name in [p for p in _WRITTEN if paths is None or p in set(paths)]:
        _WRITTEN.remove(name)
        path = jvm.org.apache.hadoop.fs.Path(name)
        gone += path.getFileSystem(conf).delete(path, True)
    return gone
