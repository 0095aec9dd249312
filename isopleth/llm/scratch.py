"""Intermediate tables in the shared folder of the cluster.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset a
local session uses ``/tmp/checkpoints/isopleth``; any other session is
refused, as its executors may not share the folders of the driver. A result
reads its tables lazily, so they stay until ``swept`` or the session's end
deletes them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "file:///tmp/checkpoints/isopleth"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_DEFAULT
    return base.rstrip("/")


#: Folders of scratches made inside swept() blocks, one list for each block.
_OPEN: list[list[str]] = []


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables of all scratches made inside, once the block's result is written elsewhere."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for path in made:
            delete(spark, path)


class Scratch:
    """A folder of its own for the tables of one call; a table is read again from files, so a lost executor costs nothing."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self._n = 0
        fs, p = file_system(spark, self.path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        for made in _OPEN:
            made.append(self.path)

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Writes df once and returns a scan of what was written."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that write() returned, once nothing lazy reads it any more."""
        delete(self.spark, df._scratch_path)


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the file system that a path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder."""
    fs, p = file_system(spark, path)
    fs.delete(p, True)
