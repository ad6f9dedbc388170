"""Incremental ingest (R6) as a stream that ends: an extension, not a port.

New files of documents are chunked once and appended; nothing is published.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lodestone.operators.chunking import chunk_docs


def ingest(spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str):
    """Chunks all files of ``folder`` that the checkpoint has not seen."""
    docs = spark.readStream.schema(schema).parquet(folder)

    def write(batch: DataFrame, epoch: int) -> None:
        # The same epoch written twice leaves one copy.
        chunk_docs(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
