"""Writers (K1 to K3, K5 to K9). What is published is written whole to a new
version first; a pointer file then names the version to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.corpus import bm25_text, currency_weight


def write_corpus(chunks: DataFrame, path: str) -> None:
    """K1: JSON lines in corpus order; null fields are left out."""
    ordered = chunks.orderBy("ord")
    ordered.drop("ord").write.mode("overwrite").json(path)


def write_one(row: DataFrame, path: str) -> None:
    """K2, K8, K9: a one-row table as a JSON document in a file of that name."""
    _write_text(row.sparkSession, path, row.select(F.to_json(F.struct("*")).alias("d")).first()["d"])


INDEX_COLUMNS = ("chunk_id", "source", "title", "section_heading", "url", "status", "currency_note", "doc_path", "text", "citation", "source_document", "review_by")


def write_index(chunks: DataFrame, path: str) -> None:
    """The columns that retrieval needs beside the vector, and what can
    be computed beforehand: the currency weight and the text that keywords are
    looked up in. Columns that ``chunks`` lacks are null."""
    have = [F.col(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in INDEX_COLUMNS]
    weight = currency_weight(F.col("source"), F.col("status")).alias("weight")
    chunks.select(*have, F.col("vector").cast("array<float>").alias("vector")).select("*", weight, bm25_text(F.col("title"), F.col("section_heading"), F.col("text")).alias("search_text")).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index as retrieval takes it, keyed by ``id``: vectors, weights and
    metadata are on one row, so nothing has to line up by position."""
    return spark.read.parquet(path).withColumnRenamed("chunk_id", "id").withColumn("section", F.col("section_heading"))


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, target, _ = _fs(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_pages(pages: DataFrame, folder: str) -> int:
    """K4: ``pages(file, text, html)`` one by one under ``folder``; a page that is
    an ``index.md`` has its markup beside it as ``page.html``.

    They come from a crawl that waits seconds for each of them, so the driver
    writes them; only one is held at a time.
    """
    spark, n = pages.sparkSession, 0
    for row in pages.select("file", "text", "html").toLocalIterator():
        path = f"{folder.rstrip('/')}/{row['file']}"
        _write_text(spark, path, row["text"])
        if path.endswith("/index.md"):
            _write_text(spark, path.removesuffix("index.md") + "page.html", row["html"] or "")
        n += 1
    return n


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def publish(spark: SparkSession, staged: str, current: str) -> None:
    """K6: ``staged`` becomes ``current`` by renaming; the old version is kept
    beside it and comes back if the rename fails."""
    fs, new, jvm = _fs(spark, staged)
    path = jvm.org.apache.hadoop.fs.Path
    here, old = path(current), path(current.rstrip("/") + ".previous")
    if not fs.exists(new):
        raise FileNotFoundError(staged)
    had = fs.exists(here)
    if had:
        fs.delete(old, True)
        if not fs.rename(here, old):
            raise OSError(f"{current} cannot be moved away")
    if not fs.rename(new, here):
        if had:
            fs.rename(old, here)
        raise OSError(f"{staged} cannot be published")


def discard(spark: SparkSession, staged: str) -> bool:
    """K7."""
    fs, path, _ = _fs(spark, staged)
    return fs.exists(path) and fs.delete(path, True)


def state_row(baseline: DataFrame, captured: str) -> DataFrame:
    """K8: the refresh state as one row, keyed by id."""
    entry = F.struct(F.col("id").cast("string"), F.struct("path", "type", "title", "url", "modified", "published"))
    return baseline.agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("baseline")).withColumn("captured", F.lit(captured))
