"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_rooted: set[str] = set()
#: Labels, and the folders of what was stored under them, for each ``passing``.
_passing: ContextVar[tuple[tuple[tuple[str, ...], list[str]], ...]] = ContextVar("passing", default=())
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    Where that is unset, a local master uses its warehouse; a cluster is told to
    name a folder, as a machine's own would be lost with it. All folders of an
    application lie under one that goes when the application ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    root = f"{base.rstrip('/')}/lodestone-{spark.sparkContext.applicationId}"
    if root not in _rooted:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _rooted.add(root)
    return f"{root}/{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the
    whole history, and nothing depends on an executor's own disk.
    """
    folder = scratch_dir(df.sparkSession)
    path = f"{folder}/{label}"
    for labels, folders in _passing.get():
        if label in labels:
            folders.append(folder)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What a ``stored`` in this block shuffles goes when its table is written,
    not when the driver happens to collect its garbage.

    Nothing that is read lazily may be begun in it.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


@contextmanager
def passing(spark: SparkSession, *labels: str) -> Iterator[None]:
    """What is ``stored`` under these labels in this block is deleted at its end.

    Nothing that outlives the block may read it.
    """
    folders: list[str] = []
    before = _passing.set((*_passing.get(), (labels, folders)))
    try:
        yield
    finally:
        _passing.reset(before)
        for folder in folders:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its files give fewer partitions than there are.

    Only what fits a few file splits is ever moved; a table of many files stays
    as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
