"""Incremental refresh: check, stage, apply."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.corpus import build, embed_text, manifest, union_producers
from lodestone.operators.diff import critical_diff, pending, snapshot_diff, upsert
from lodestone.operators.evaluate import ready
from lodestone.sources.archive import live_docs
from lodestone.sources.rest import Site, archive_records, snapshot
from lodestone.sources.scratch import stored
from lodestone.sources.sinks import discard, publish, state_row, write_index, write_one, write_pages

_BUSY = threading.Lock()


class Busy(Exception):
    """Another action is running."""


def run(action: Callable[[], object]) -> object:
    """One action at a time."""
    if not _BUSY.acquire(blocking=False):
        raise Busy
    try:
        return action()
    finally:
        _BUSY.release()


def check(baseline: DataFrame | None, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R2: the changes and the ids to fetch. The first capture records a
    baseline and reports nothing."""
    if baseline is None:
        changes = snapshot_diff(live, live)
        return changes, pending(changes)
    changes = snapshot_diff(baseline, live)
    return changes, pending(changes)


def write_version(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], built: str, path: str) -> None:
    """Corpus, manifest and index as one version under ``path``, which is
    published by one rename. ``embed`` adds ``vector`` to ``(chunk_id,
    embed_text)``."""
    spark = chunks.sparkSession
    chunks.write.mode("overwrite").parquet(f"{path}/corpus")
    corpus = spark.read.parquet(f"{path}/corpus")
    write_one(manifest(corpus, built), f"{path}/manifest")
    rebuild_index(corpus, embed, f"{path}/index")


def rebuild_index(corpus: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str) -> int:
    """Embeds the corpus into a new index under ``path``, to be published from
    there; returns its rows, which must be those of the corpus (F11)."""
    heading = F.col("section_heading") if "section_heading" in corpus.columns else F.lit(None).cast("string")
    vectors = embed(corpus.select("chunk_id", embed_text(F.col("title"), heading, F.col("text")).alias("embed_text"))).select("chunk_id", "vector")
    write_index(corpus.join(vectors, "chunk_id", "left"), path)
    check_ = ready(corpus, corpus.sparkSession.read.parquet(path)).first()
    if not check_["ready"]:
        raise RuntimeError(f"{check_['index_rows']} index rows for {check_['corpus_rows']} chunks")
    return check_["index_rows"]


def stage(old_chunks: DataFrame, records: DataFrame, fetched: DataFrame, rebuild: Callable[[DataFrame], DataFrame], old_text: DataFrame, text_of: Callable[[DataFrame], DataFrame], path: str, embed: Callable[[DataFrame], DataFrame], built: str) -> DataFrame:
    """Fetched records replace their like, corpus, manifest and index are
    built anew under ``path``, and what happened to critical facts is returned
    for review."""
    write_version(rebuild(upsert(records, fetched)), embed, built, path)
    staged = old_chunks.sparkSession.read.parquet(f"{path}/corpus")
    return critical_diff(old_text, text_of(staged))


def capture(spark: SparkSession, site: Site, folder: str, own_host: str, others: Callable[[], list[DataFrame]], gap: DataFrame, embed: Callable[[DataFrame], DataFrame], today: str) -> DataFrame:
    """A first copy of a site under ``folder``: pages, index and state, then
    a version of corpus, manifest and index, published as ``current``.

    ``others()`` gives the documents of the other producers. Returns one row of
    counts. A site that shows nothing leaves everything as it was.
    """
    items = stored(site.items(spark), "items")
    if items.isEmpty():
        raise RuntimeError("the site shows nothing")
    records = stored(archive_records(items, own_host), "records")
    written = write_pages(records, f"{folder}/live")
    names, media = stored(site.terms(spark), "terms"), stored(site.media(spark), "media")
    entries = lambda rows: F.array_sort(F.collect_list(F.struct(*rows.columns)))
    one = records.drop("text", "html").agg(F.array_sort(F.collect_list(F.struct(*(c for c in records.columns if c not in ("text", "html", "links")), "links")), _by_id).alias("records"))
    index = one.crossJoin(media.agg(entries(media).alias("media"))).crossJoin(names.agg(F.map_from_entries(F.collect_list(F.struct("taxonomy", "names"))).alias("taxonomy")))  # one row each
    write_one(index.select(F.lit(own_host).alias("source"), F.lit(today).alias("captured"), "taxonomy", "records", "media"), f"{folder}/live/_index.json")
    write_one(state_row(snapshot(items), today), f"{folder}/state")
    live = live_docs(spark, f"{folder}/live/_index.json", f"{folder}/live")
    docs = union_producers(live, *others())
    write_version(build(docs, gap), embed, today, f"{folder}/building")
    publish(spark, f"{folder}/building", f"{folder}/current")
    return media.agg(F.count("*").alias("media")).select(F.lit(written).alias("documents"), "media", F.lit(spark.read.parquet(f"{folder}/current/corpus").count()).alias("chunks"))


def _by_id(a: Column, b: Column) -> Column:
    return F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)


def apply(spark: SparkSession, staged: str, current: str, baseline: DataFrame, live: DataFrame, fetched_ids: DataFrame) -> DataFrame:
    """Publishes what was staged; the baseline moves on only for ids that
    were fetched, so that a page that failed is tried again. Removed pages stay
    and are told by ``check``."""
    publish(spark, staged, current)
    return upsert(baseline, live.join(fetched_ids.select("id"), "id", "left_semi"))


__all__ = ["Busy", "apply", "capture", "check", "discard", "rebuild_index", "run", "stage", "write_version"]
