"""Exact deduplication over an extendible-hash index on shared files.

DataFrame operations only. A text's key is a 64-bit hash of its normal form,
and a bucket holds the keys that share some leading bits:

1. *Directory.* Distinct keys are counted per prefix. A bucket over its capacity
   is split by its next leading bit, and the directory doubles when the bucket
   is as deep as the directory. It is as deep as the keys need: up to
   ``MAX_DEPTH`` bits, beyond which buckets grow instead, so the table of slots
   that is broadcast has at most ``2 ** MAX_DEPTH`` rows of 8 bytes.
2. *Buckets.* The directory gives each document its bucket, and the texts are
   partitioned by bucket, once. The task that owns a bucket, a range of keys,
   puts the texts of equal key into one chain and compares them byte for byte:
   an entry of the chain has the least id and the number of its copies. Keys of
   very many rows (at most ``1 / HOT_SHARE`` of them) are combined before they
   are sent, so a text that a third of all rows hold is a few rows to its owner.
3. *Lookup.* Pages without texts are written, partitioned by bucket; each
   document finds its entry by bucket, key and, along the chain, digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import id_text, stored

MAX_DEPTH, BUCKET_ENTRIES, HOT_SHARE = 18, 256, 0.001
#: Fixed by the operator's definition of equal texts.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def directory(counts: dict[int, int], capacity: int = BUCKET_ENTRIES, max_depth: int = MAX_DEPTH) -> list[tuple[int, int]]:
    """``(bucket, local depth)`` for each of the ``2 ** depth`` slots, where
    ``counts`` has the entries for each prefix of ``max_depth`` bits.

    A bucket is named by its smallest prefix of ``max_depth`` bits.
    """
    total = [0]
    for prefix in range(1 << max_depth):
        total.append(total[-1] + counts.get(prefix, 0))
    held = lambda start, depth: total[start + (1 << (max_depth - depth))] - total[start]
    depth, slots = 0, [(0, 0)]
    while full := {b for b in slots if held(*b) > capacity and b[1] < max_depth}:
        if any(local == depth for _, local in full):
            depth, slots = depth + 1, [b for b in slots for _ in range(2)]
        for k, (start, local) in enumerate(slots):
            if (start, local) in full:
                upper = k >> (depth - local - 1) & 1
                slots[k] = (start + (upper << (max_depth - local - 1)), local + 1)
    return slots


def normal(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_RUN, " ")


class Index:
    """``place`` gives documents with a column ``h`` their bucket; ``pages`` has
    ``(bucket, h, text_sha256, keep_id, group_size)``."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES, max_depth: int = MAX_DEPTH, hot_share: float = HOT_SHARE, hash_of: Callable[[Column], Column] = F.xxhash64):
        rows = id_text(docs, id_col, text_col).select("doc_id", normal(F.col("text")).alias("norm"))
        # Documents without texts, read again for the lookup.
        self.probes = stored(rows.select("doc_id", hash_of(F.col("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("digest")), "probes")
        keys = stored(self.probes.groupBy("h").agg(F.count("*").alias("n")), "keys")
        total = keys.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
        # A few bits more than buckets of even size would take.
        self.bits = min(max_depth, max(1, (total["keys"] // capacity).bit_length() + 4))
        self.slots = self._slots(keys, capacity)
        hot = keys.where(F.col("n") >= max(2.0, hot_share * total["rows"])).select("h")  # 1 / hot_share rows at most
        texts = self.place(rows.withColumn("h", hash_of(F.col("norm"))))
        key = ["bucket", "h", "norm"]
        common = texts.join(F.broadcast(hot), "h", "left_semi").groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        others = texts.join(F.broadcast(hot), "h", "left_anti").select(*key, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
        owned = common.unionByName(others).repartition("bucket")
        chains = owned.groupBy(*key).agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        entries = chains.select("bucket", "h", F.unhex(F.sha2("norm", 256)).alias("digest"), "keep_id", "group_size")
        self.pages = stored(entries.sortWithinPartitions("bucket", "h"), "pages")

    def _slots(self, keys: DataFrame, capacity: int) -> DataFrame:
        prefix = F.shiftrightunsigned("h", 64 - self.bits).cast("int")
        counts = {r["prefix"]: r["count"] for r in keys.groupBy(prefix.alias("prefix")).count().collect()}  # 2 ** bits rows at most
        slots = directory(counts, capacity, self.bits)
        self.depth = len(slots).bit_length() - 1
        return keys.sparkSession.createDataFrame([(k, b) for k, (b, _) in enumerate(slots)], "slot int, bucket int")

    def place(self, rows: DataFrame) -> DataFrame:
        slot = F.shiftrightunsigned("h", 64 - self.depth).cast("int") if self.depth else F.lit(0)
        return rows.withColumn("slot", slot).join(F.broadcast(self.slots), "slot").drop("slot")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null texts equal empty ones. A null id is never kept while its group has an
    id; in a group with null ids only, ``keep_id`` is null and all are kept.
    Rows that share the smallest id are all kept. An empty table gives an
    empty one. ``options`` are those of ``Index``.
    """
    index = Index(docs, id_col, text_col, **options)
    found = index.place(index.probes).join(index.pages, ["bucket", "h", "digest"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
