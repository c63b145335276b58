"""Reading tables, and cutting lineage with written tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table is broadcast.
SMALL = 100_000
#: Folders written in this process, for `clean`.
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session may do without: it gets one of the machine's own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "quillrank-checkpoints")


def fresh_path(spark: SparkSession) -> str:
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what follows reads it and computes nothing again, whichever executor is lost."""
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes every table that this process has cut; for the end of a job, when its results are written. How many there were."""
    n, jvm = 0, spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
