"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import contextlib
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


# The JVM does not compile methods above 8000 bytes.  Stages with many long string expressions would run
# interpreted; with this limit Spark generates them in smaller pieces instead.
HUGE_METHOD = ("spark.sql.codegen.hugeMethodLimit", "8000")


def build_session(app: str = "noticewindows", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC clocks and adaptive execution; the cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        HUGE_METHOD[0]: HUGE_METHOD[1],
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where unset, the warehouse, which is shared too."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


_FOLDERS: dict[str, SparkSession] = {}


def run_folder(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder, for one run's tables and checkpoints; removed when the driver ends, or
    at the end of ``released``."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _FOLDERS[path] = spark
    for held in getattr(_STEPS, "open", []):
        held.append(path)
    return path


_STEPS = threading.local()


@contextlib.contextmanager
def released() -> Iterator[None]:
    """What this thread writes to fresh folders inside is removed at the end: for the steps of a run without an end."""
    mine: list[str] = []
    _STEPS.open = [*getattr(_STEPS, "open", []), mine]
    try:
        yield
    finally:
        _STEPS.open = _STEPS.open[:-1]
        for path in mine:
            _forget(path)


def _forget(path: str) -> None:
    spark = _FOLDERS.pop(path, None)
    with contextlib.suppress(Exception):  # the session may be gone already
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _forget_all() -> None:
    for path in list(_FOLDERS):
        _forget(path)


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that lost executors lose nothing."""
    spark = df.sparkSession
    path = run_folder(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
