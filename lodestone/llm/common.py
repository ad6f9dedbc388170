"""Helpers that the training-data operators share.

Rules that hold for all of them:

* a null text counts as an empty text;
* a row whose id is null is kept and never chosen as a representative while
  its group has a row with an id;
* only the id and the text are read, under internal names, so extra columns
  (whatever they are called) cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.scratch import scratch_dir, spread, stored

__all__ = ["bounded_batches", "bounded_bytes", "id_text", "load", "merge_labels", "scratch_dir", "spread", "stored"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows from now on: the JVM and the Python
    workers keep the buffers of the largest ones from one stage to the next."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:  # none or less: unbounded
        spark.conf.set(key, rows)


def bounded_bytes(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches of about ``most`` bytes from now on, as ``bounded_batches``
    for rows of some MB each."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20}
    size = now.rstrip("bkmgtp")
    if not size.isdigit() or not 0 < int(size) * units.get(now[len(size) :] or "b", most + 1) <= most:
        spark.conf.set(key, str(most))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, null texts as empty ones."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def merge_labels(n: int, left: np.ndarray, right: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable node of each of ``n`` nodes, given edge arrays."""
    label = np.arange(n) if label is None else label.copy()
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            return label
