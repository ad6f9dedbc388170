"""Chunking (C1 to C6, W9) as folds over arrays, without Python functions.

The folds run over word counts, which are taken once, and yield where packs
start; texts are put together afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import MAX_CHUNK_WORDS, OVERLAP_WORDS
from lodestone.functions.text import let, strip, word_count, words


def split_sections(text: Column) -> Column:
    """``array<struct<heading, text>>``, cut before each ``## `` line."""
    parts = F.transform(F.split(text, "\\n(?=## )"), strip)
    return F.transform(parts, lambda p: F.struct(F.nullif(F.regexp_extract(p, "^## (.+)", 1), F.lit("")).alias("heading"), p.alias("text")))


def is_table(block: Column) -> Column:
    """C2."""
    return block.rlike("(?U)\\A\\s*\\|")


def tail(text: Column, n: int = OVERLAP_WORDS) -> Column:
    """C4: the last ``n`` words, or the text as it is if it has no more."""
    w = words(text)
    return F.when(F.size(w) > n, F.array_join(F.slice(w, -n, n), " ")).otherwise(text)


def _starts(sizes: Column, limit: int, overlap: int) -> Column:
    """Where packs start (from 0) if items are packed in order: an item that
    would exceed ``limit`` starts a pack, which begins with up to ``overlap``
    words of the item before it."""
    start = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("words"), F.lit(0).alias("at"), F.lit(0).alias("last"))

    def step(s: Column, n: Column) -> Column:
        flush = (s["at"] > 0) & (s["words"] + n > limit)
        return F.struct(
            F.when(flush, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"]).alias("starts"),
            (F.when(flush, F.least(s["last"], F.lit(overlap))).otherwise(s["words"]) + n).alias("words"),
            (s["at"] + 1).alias("at"),
            n.alias("last"),
        )

    return F.aggregate(sizes, start, step, lambda s: s["starts"])


def _packs(items: Column, separator: str, limit: int, overlap: int) -> Column:
    """Texts of the packs of ``items``, an array of ``text, n``."""
    starts = _starts(F.transform(items, lambda x: x["n"]), limit, overlap)

    def pack(s: Column, first: Column, k: Column) -> Column:
        size = F.coalesce(F.get(s["starts"], k + 1), F.size(s["items"])) - first
        own = F.transform(F.slice(s["items"], first + 1, size), lambda x: x["text"])
        before = F.when(first > 0, F.array(tail(F.get(s["items"], first - 1)["text"], overlap))).otherwise(F.array().cast("array<string>")) if overlap else F.array().cast("array<string>")
        return F.array_join(F.concat(before, own), separator)

    return let(F.struct(items.alias("items"), starts.alias("starts")), lambda s: F.transform(s["starts"], lambda first, k: pack(s, first, k)))


def _sized(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(t.alias("text"), word_count(t).alias("n")))


def split_block(block: Column, limit: int = MAX_CHUNK_WORDS) -> Column:
    """A long block that is no table as packs of whole sentences."""
    # The cut is marked, as a split pattern may not look back over white space of any length.
    sentences = F.split(F.regexp_replace(block, "(?U)(?<=[.!?])\\s+(?=[A-Z0-9])", "\u0001"), "\u0001")
    packed = let(_sized(sentences), lambda items: _packs(items, " ", limit, 0))
    return F.when((word_count(block) <= limit) | is_table(block), F.array(block)).otherwise(packed)


def split_oversized(text: Column, limit: int = MAX_CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> Column:
    """A section as packs of blocks; each pack starts with the tail of the
    block before it, and takes the block that overflowed whatever its size."""
    blocks = F.flatten(F.transform(F.split(text, "\n\n"), lambda b: split_block(b, limit)))
    packed = let(_sized(blocks), lambda items: _packs(items, "\n\n", limit, overlap))
    return F.when(word_count(text) <= limit, F.array(text)).otherwise(packed)


def chunk_column(text: Column, limit: int = MAX_CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> Column:
    """``array<struct<heading, text>>`` without blank chunks."""
    cut = F.transform(split_sections(text), lambda s: F.transform(split_oversized(s["text"], limit, overlap), lambda t: F.struct(s["heading"].alias("heading"), t.alias("text"))))
    return F.filter(F.flatten(cut), lambda c: c["text"].rlike("(?U)\\S"))


def chunk_docs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The other columns with ``chunk_index, section_heading, text, word_count``."""
    others = [c for c in docs.columns if c != text_col]
    cut = docs.select(*others, F.posexplode(chunk_column(F.coalesce(F.col(text_col), F.lit("")))).alias("chunk_index", "c"))
    return cut.select(*others, "chunk_index", F.col("c.heading").alias("section_heading"), F.col("c.text").alias("text"), word_count(F.col("c.text")).alias("word_count"))
