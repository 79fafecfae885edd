"""Tables that a job writes once and reads again: they live in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where unset, the warehouse, which a cluster shares as well."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return re.sub(r"^file:/(?!/)", "file:///", root.rstrip("/"))


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder for one table of one run; it is removed when the driver ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        remove(spark, path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later jobs do not repeat it, lost executors lose nothing."""
    spark = df.sparkSession
    path = fresh_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a finished step from whatever file system holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
