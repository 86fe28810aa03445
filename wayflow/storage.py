"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a folder of our own only where the setting is absent, as in tests on one machine. A cluster has to name one."""
    found = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-wayflow-")
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate files that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def save(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder (a folder for each value of the column ``by``) and return the table read back.

    Lineage is cut: what follows survives the loss of any executor and never computes ``df`` again.
    """
    return save_as(df, new_folder(df.sparkSession, tag), by)


def save_as(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of an iteration, of which each is read to write the next: the one before goes once the new one is there."""

    def __init__(self, spark: SparkSession, tag: str):
        self._spark, self._tag, self._path = spark, tag, None

    def put(self, df: DataFrame) -> DataFrame:
        spent, self._path = self._path, new_folder(self._spark, self._tag)
        saved = save_as(df, self._path)
        if spent:
            forget(self._spark, spent)
        return saved
