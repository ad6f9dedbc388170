"""A training corpus in five stages, each over all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and read back as the ``docs`` of the next. All but the last return the columns
of ``documents``; where a text changes, ``n_chars`` follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import line_dedup, packing, pii, simhash, toxicity
from lodestone.llm.common import bounded_batches, load, spread, stored
from lodestone.llm.queries import tokenizer_path


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return docs.select(*columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; an empty or null text stays."""
    bounded_batches(spark)
    return toxicity.reject_toxic(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go; every document stays, if only as an
    empty text."""
    bounded_batches(spark)
    return _counted(line_dedup.dedup_lines(docs), docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    bounded_batches(spark)
    return simhash.deduplicate(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked; every document stays."""
    bounded_batches(spark)
    return _counted(pii.masked(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    bounded_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("simhash", near), ("pii", private), ("packing", packed)]
#: SQL can express neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(load(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
