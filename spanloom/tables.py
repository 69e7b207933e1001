"""Reading the driver's tables and keeping intermediate results in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a fresh local one only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spanloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Tables written within each open ``released`` block, innermost last.
_written: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def released():
    """Deletes the scratch tables written within the block when it ends, but for those of a ``lasting`` scratch."""
    _written.append([])
    try:
        yield
    finally:
        for spark, path in _written.pop():
            delete(spark, path)


class Scratch:
    """Parquet tables in the shared folder that cut lineage: a lost executor never recomputes past one.

    ``keep`` writes a table and reads it back; ``drop`` deletes one that nothing will read again. A result that reads scratch tables
    needs them until it has been written: use it within a ``released`` block, which deletes them after.
    """

    def __init__(self, spark: SparkSession, name: str, lasting: bool = False):
        self.spark, self.lasting = spark, lasting
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").partitionBy(*by).parquet(path)
        self.paths[name] = path
        if _written and not self.lasting:
            _written[-1].append((self.spark, path))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.paths.pop(name))
