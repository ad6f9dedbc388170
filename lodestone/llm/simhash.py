"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, tile against tile, with numpy exclusive-or
and bit counts. A tile holds distinct fingerprints with the same population
counts in the upper and the lower 32 bits; two fingerprints within ``radius``
bits differ by at most ``radius`` in the sum of the two count differences, so
all other tile pairs are skipped. Within a pair the rows are sorted by the
population count of the top 16 bits and only the slices that can still be
within the radius are compared.

Equal fingerprints are one row before the comparison (a third of all
documents may be copies), a tile pair returns at most one link per row (a
spanning forest of its matches, not the matches), and tiles over ``TILE_ROWS``
rows are cut by hash into blocks that are compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import id_text, merge_labels, stored
from lodestone.llm.components import components

SHINGLE_WORDS, RADIUS, TILE_ROWS, SEED = 3, 3, 32_768, 42
#: Cells of a comparison matrix and shingles of a bit table held at once.
_CELLS, _SHINGLES = 2_000_000, 65_536


def fingerprint(text: bytes, words_each: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text; zero if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_each:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - words_each].tolist(), ends[words_each - 1 :].tolist())]
    table = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(table), _SHINGLES):
        ones += np.unpackbits(table[k : k + _SHINGLES], axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(table), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary() if pa.types.is_string(batch.column(1).type) else pa.large_binary()).to_pylist()
        found = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: the fingerprint's bits as a signed long."""
    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(_fingerprints, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def _tile_links(radius: int):
    def run(table: pa.Table) -> pa.Table:
        blocks = table.column("fps").combine_chunks()
        fp = np.asarray(blocks.flatten()).astype(np.int64).view(np.uint64)
        second = np.repeat(np.asarray(table.column("second")).astype(bool), np.asarray(blocks.value_lengths()))
        top = np.bitwise_count(fp >> np.uint64(48)).astype(np.int64)
        order = np.lexsort((top, second))
        fp, second, top = fp[order], second[order], top[order]
        cut = int(np.searchsorted(second, True))
        alone = cut == len(fp)
        right, right_top, base = (fp, top, 0) if alone else (fp[cut:], top[cut:], cut)
        half = lambda x: int(np.bitwise_count(x >> np.uint64(32)))
        gap = half(fp[0]) - half(right[0]) if len(right) and cut else 0
        label = np.arange(len(fp))
        for value in np.unique(top[:cut]):
            # |d| + |gap - d| <= radius, d being the difference in the top 16 bits.
            fits = [d for d in range(-radius, radius + 1) if abs(d) + abs(gap - d) <= radius]
            if not fits:
                continue
            a, b = np.searchsorted(top[:cut], [value, value + 1])
            c, d = np.searchsorted(right_top, [value - max(fits), value - min(fits) + 1])
            if c == d:
                continue
            step = max(1, _CELLS // (d - c))
            for k in range(a, b, step):
                rows = fp[k : min(b, k + step)]
                for m in range(c, d, _CELLS):
                    hit = np.bitwise_count(rows[:, None] ^ right[None, m : min(d, m + _CELLS)]) <= radius
                    i, j = np.nonzero(hit)
                    i, j = i + k, j + m + base
                    if len(keep := np.flatnonzero(i != j)):
                        label = merge_labels(len(fp), i[keep], j[keep], label)
        linked = np.flatnonzero(label != np.arange(len(fp)))
        bits = fp.view(np.int64)
        return pa.table({"src": bits[linked], "dst": bits[label[linked]]})

    return run


def links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links ``(src, dst)`` that connect exactly the fingerprints of
    ``distinct(fp long)`` that a chain of pairs within ``radius`` connects."""
    if not 0 <= radius < 32:
        raise ValueError("radius must be from 0 to 31")
    cell = F.bit_count(F.shiftrightunsigned("fp", 32)) * 33 + F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    rows = distinct.select("fp", cell.cast("int").alias("cell"))
    # At most 33 x 33 cells, whatever the input: small enough to broadcast.
    sizes = rows.groupBy("cell").count().select("cell", F.ceil(F.col("count") / tile_rows).cast("int").alias("blocks"))
    other = sizes.select(F.col("cell").alias("near"), F.col("blocks").alias("near_blocks"))
    apart = F.abs(F.floor(F.col("cell") / 33) - F.floor(F.col("near") / 33)) + F.abs(F.col("cell") % 33 - F.col("near") % 33)
    pairs = sizes.join(F.broadcast(other), apart <= radius).select("cell", "near", "near_blocks")
    # A block is one row, and so is its copy for each block that it is compared with.
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block")
    packed = rows.join(F.broadcast(sizes), "cell").groupBy("cell", block).agg(F.collect_list("fp").alias("fps"))
    dealt = packed.join(F.broadcast(pairs), "cell").withColumn("near_block", F.explode(F.sequence(F.lit(0), F.col("near_blocks") - 1)))
    own, far = F.struct(F.col("cell").alias("c"), F.col("block").alias("b")), F.struct(F.col("near").alias("c"), F.col("near_block").alias("b"))
    dealt = dealt.select("fps", (own > far).alias("second"), F.least(own, far).alias("one"), F.greatest(own, far).alias("two"))
    keyed = dealt.select(F.col("one.c").alias("c1"), F.col("one.b").alias("b1"), F.col("two.c").alias("c2"), F.col("two.b").alias("b2"), "fps", "second")
    drop = _tile_links(radius)
    return keyed.groupBy("c1", "b1", "c2", "b2").applyInArrow(lambda t: drop(t.select(["fps", "second"])), "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(doc_id, fp long, component_id)``, one row per input row.

    ``component_id`` is the smallest id reachable by fingerprints that differ
    in at most ``radius`` bits. Texts without a word have fingerprint zero and
    link like any other. Rows with a null id take part; a component of only
    such rows has a null ``component_id``. Rows that share an id are judged
    one by one. An empty table gives an empty one.
    """
    marks = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "groups")
    nodes = components(links(groups.select("fp"), radius, tile_rows))
    rooted = groups.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("component", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    named = stored(rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fp", "component_id"), "named")
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group: the one of smallest id.

    Rows that share an id stay or go together, and stay if one of them is its
    group's first; rows with a null id cannot be named and stay.
    """
    found = near_duplicates(docs, id_col, text_col, radius)
    stays = found.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("component_id").eqNullSafe(F.col("doc_id"))).alias("stays"))
    drop = stays.where("not stays").select(F.col("doc_id").alias("__drop_id"))
    return docs.join(drop, F.col(id_col) == F.col("__drop_id"), "left_anti")
