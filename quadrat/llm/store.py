"""Staged tables: results written once to the shared folder of the cluster and read again.

A staged table cuts lineage, so that a lost executor costs a few tasks and not the whole job, and it fixes
row-level decisions (numbering, sampling) that must not change when a task is run again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a new temporary folder in local mode (tests);
    on a cluster an error, since executors share no folder of one machine."""
    found = spark.conf.get(_CHECKPOINT, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-quadrat-")
        spark.conf.set(_CHECKPOINT, found)
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and return the table that reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quadrat/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete a staged table, or those of a union, that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        folder = jvm.org.apache.hadoop.fs.Path(parent)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def frees_shuffles(spark: SparkSession):
    """A context in which the shuffle files of a query are deleted as soon as the query has ended."""
    return _Setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def splits_methods(spark: SparkSession):
    """A context in which wide projections are compiled in parts: methods of over 8000 bytes the JVM only interprets."""
    return _Setting(spark, "spark.sql.codegen.hugeMethodLimit", "8000")


class _Setting:
    def __init__(self, spark: SparkSession, key: str, value: str):
        self.conf, self.key, self.value = spark.conf, key, value

    def __enter__(self):
        self.before = self.conf.get(self.key, None)
        self.conf.set(self.key, self.value)

    def __exit__(self, *_):
        if self.before is None:
            self.conf.unset(self.key)
        else:
            self.conf.set(self.key, self.before)


def blocks_for(rows: int, per_block: int) -> int:
    """How many blocks of about ``per_block`` rows hold ``rows`` rows; at least one."""
    return max(1, -(-rows // per_block))
