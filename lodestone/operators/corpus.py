"""Corpus assembly: three producers, one table of chunks with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import LIVE, PARTNER, RETIRED, STATUS_EQUIVALENT, STATUS_GONE, STATUS_WARNED, WEIGHT_CURRENT, WEIGHT_EQUIVALENT, WEIGHT_GONE, WEIGHT_SUPERSEDED, WEIGHT_UNKNOWN
from lodestone.functions.text import let
from lodestone.operators.chunking import chunk_docs

PREFIX = {RETIRED: "old", LIVE: "new", PARTNER: "partner"}
#: More rules than this are refused: they are compared with every chunk.
MAX_RULES = 10_000


def currency_weight(source: Column, status: Column) -> Column:
    """Superseded first, then the role, then the status."""
    s = F.lower(F.coalesce(status, F.lit("")))
    return (
        F.when(s == "superseded", WEIGHT_SUPERSEDED)
        .when(source != RETIRED, WEIGHT_CURRENT)
        .when(s.isin(*STATUS_EQUIVALENT), WEIGHT_EQUIVALENT)
        .when(s.isin(*STATUS_GONE), WEIGHT_GONE)
        .otherwise(WEIGHT_UNKNOWN)
    )


def currency_note(source: Column, status: Column, modified: Column | None = None) -> Column:
    """P5."""
    gone, kept = F.lit("Dropped or changed on the live site -- verify before relying on this."), F.lit("Believed to still exist on the live site.")
    live = F.concat(F.lit("Live; last modified "), modified, F.lit(".")) if modified is not None else F.lit("Live.")
    return F.when(source == RETIRED, F.when(status.isin(*STATUS_WARNED), gone).otherwise(kept)).when(source == LIVE, live)


def is_current(source: Column, status: Column) -> Column:
    """P14."""
    return source.isin(LIVE, PARTNER) & (F.lower(F.coalesce(status, F.lit(""))) != "superseded")


def provenance(authority: Column, provided_by: Column, occasion: Column, received: Column) -> Column:
    """P27."""
    built = F.concat(F.lit("Provided by "), provided_by, F.lit(" at the "), occasion, F.lit(" on "), received, F.lit("."))
    return F.concat(F.coalesce(F.nullif(authority, F.lit("")), built), F.lit(" Not published on any website -- check the linked page for a newer official version."))


def gap_dimension(items: DataFrame) -> DataFrame:
    """``(slug, status)`` of ``(slug, status, pos)``; the last of a slug wins."""
    return items.groupBy("slug").agg(F.max_by("status", "pos").alias("status"))


def with_gap_status(docs: DataFrame, gap: DataFrame) -> DataFrame:
    """The gap status of retired documents, ``unmapped`` by default. The
    join strategy is left to the optimizer: the table grows with the archive."""
    return docs.join(gap.select("slug", F.col("status").alias("__gap")), "slug", "left").withColumn("status", F.when(F.col("source") == RETIRED, F.coalesce("__gap", F.lit("unmapped"))).otherwise("current")).drop("__gap")


def chunk_id(source: Column, slug: Column, index: Column) -> Column:
    """P6."""
    prefix = F.create_map(*(F.lit(x) for kv in PREFIX.items() for x in kv))
    return F.concat_ws(":", F.element_at(prefix, source), slug, index.cast("string"))


def build(docs: DataFrame, gap: DataFrame) -> DataFrame:
    """Chunks of ``docs(slug, source, title, url, text[,
    modified, ...])`` in the order retired, live, partner (column ``ord``)."""
    chunks = chunk_docs(with_gap_status(docs, gap))
    note = currency_note(F.col("source"), F.col("status"), F.col("modified") if "modified" in docs.columns else None)
    place = F.array_position(F.array(*(F.lit(r) for r in (RETIRED, LIVE, PARTNER))), F.col("source"))
    return chunks.withColumn("chunk_id", chunk_id(F.col("source"), F.col("slug"), F.col("chunk_index"))).withColumn("currency_note", F.coalesce(F.col("currency_note") if "currency_note" in docs.columns else F.lit(None).cast("string"), note)).withColumn("ord", F.struct(place.alias("role"), F.col("slug"), F.col("chunk_index")))


def union_producers(*producers: DataFrame) -> DataFrame:
    """Columns that a producer lacks are null."""
    out = producers[0]
    for p in producers[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def supersede(chunks: DataFrame, rules: DataFrame) -> DataFrame:
    """The first rule ``(ord, match, reason)`` whose text a chunk contains,
    whatever the case, marks it superseded. Partner chunks are exempt.

    Rules are a hand-written list. Its size is checked; it travels as one
    array, so that no row is joined or repeated.
    """
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} supersession rules")
    listed = rules.agg(F.sort_array(F.collect_list(F.struct("ord", F.lower("match").alias("match"), "reason"))).alias("__rules"))  # one row
    first = let(F.lower("text"), lambda low: F.get(F.filter("__rules", lambda r: F.contains(low, r["match"])), F.lit(0))["reason"])
    hit = chunks.crossJoin(F.broadcast(listed)).withColumn("__hit", F.when(F.col("source") != PARTNER, first))
    return hit.withColumn("status", F.when(F.col("__hit").isNotNull(), "superseded").otherwise(F.col("status"))).withColumn("currency_note", F.coalesce("__hit", "currency_note")).drop("__hit", "__rules")


def embed_text(title: Column, heading: Column, text: Column) -> Column:
    """Where the chunk is, a sentence of context, the heading, the text."""
    h = F.nullif(heading, F.lit(""))
    where = F.concat_ws(" > ", title, h)
    return F.concat_ws("\n", where, F.concat(F.lit("This is part of the guidance page: "), where, F.lit(".")), h, text)


def bm25_text(title: Column, heading: Column, text: Column) -> Column:
    """P3."""
    return F.concat_ws(" ", title, F.coalesce(heading, F.lit("")), text)


def resolve_names(ids: Column, names: Column) -> Column:
    """Names of taxonomy ids in order, unknown ones dropped."""
    return F.filter(F.transform(ids, lambda i: F.element_at(names, i.cast("string"))), lambda n: n.isNotNull())


def manifest_by_source(chunks: DataFrame) -> DataFrame:
    """A1, A3, A4."""
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.count_if(F.lower("status") == "superseded").alias("superseded"), F.countDistinct("title").alias("titles"))


def topics(chunks: DataFrame) -> DataFrame:
    """A2, O2: chunks per topic, most first, ties by first appearance."""
    each = chunks.select("ord", F.explode("topics").alias("topic"))
    return each.groupBy("topic").agg(F.count("*").alias("chunks"), F.min("ord").alias("first")).orderBy(F.desc("chunks"), "first").drop("first")


def manifest(chunks: DataFrame, built: str) -> DataFrame:
    """K2: one row that says what went in."""
    return manifest_by_source(chunks).agg(F.lit(built).alias("built"), F.sum("chunks").alias("total_chunks"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "chunks")))).alias("chunks_by_source"), F.sum("superseded").alias("superseded_chunks"))
