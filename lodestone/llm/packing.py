"""Concatenate-and-cut packing into fixed windows.

First pass: every document is tokenized and the ids are stored with the number
of ids before it in its partition. Second pass: a prefix sum over the
partitions' totals (one row per partition) gives every document its place in
the concatenation; cutting at multiples of the window gives the pieces, and a
document that crosses a boundary has a record on either side of it. Only the
last sequence can have padding. No row moves between partitions but the
totals.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import pretoken
from lodestone.llm.common import id_text, stored

WINDOW, END_ID, CACHE_WORDS = 4096, 2, 150_000


class Counter:
    """Ids of whole texts by the tokenizers library.

    Arrow cuts texts to words and numbers the words of a group of texts, so that
    Python sees each distinct word of the group once. Words are remembered (two
    generations, as in ``pretoken.Cache``), and there is one call for all words
    of a group that are not."""

    def __init__(self, path: str, size: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tool, self.size = Tokenizer.from_file(path), size
        self.tool.no_padding()
        self.tool.no_truncation()
        vocab = self.tool.get_vocab(with_added_tokens=True)
        # Each word ends in one of these, or is a special token.
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>") or t in pretoken.SPECIAL]] = True
        self.kind = np.dtype("<u2" if len(self.ends) <= 1 << 16 else "<u4")
        self.word: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        if len(self.word) >= self.size:
            self.old, self.word = self.word, {}
        known = list(map(self.word.get, words))
        new = []
        for k in [k for k, raw in enumerate(known) if raw is None]:
            if (raw := self.old.get(words[k])) is None:
                new.append(k)
            else:
                known[k] = self.word[words[k]] = raw
        # White space parts words and has no ids of its own.
        groups = [" ".join([words[k] for k in new[at : at + 500]]) for at in range(0, len(new), 500)]
        ids = np.array([i for e in self.tool.encode_batch_fast(groups, add_special_tokens=False) for i in e.ids], dtype=self.kind)
        stops = (self.kind.itemsize * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        raw, start = ids.tobytes(), 0
        for k, stop in zip(new, stops, strict=True):
            known[k] = self.word[words[k]] = raw[start:stop]
            start = stop
        return known

    def _spread(self, cut: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lists of words one after another, and how many each list has."""
        numbered = cut.values.dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self._learn([w for w in words if w])
        if "" in words:  # what a split leaves at the ends
            known.insert(words.index(""), b"")
        size = np.fromiter(map(len, known), np.int64, len(known)) // self.kind.itemsize
        ids, first = np.frombuffer(b"".join(known), self.kind), np.cumsum(size) - size
        which = np.asarray(numbered.indices)
        sizes = size[which]
        until = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(until[-1]) + np.repeat(first[which] - until[:-1], sizes)
        return ids[at], np.diff(until[np.asarray(cut.offsets)])

    def ids(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        plain = pc.and_(pc.match_substring_regex(texts, pretoken.PLAIN_TEXT), pc.invert(pc.match_substring(texts, "<|")))
        mask = np.asarray(plain)
        spaced = pc.replace_substring_regex(pc.utf8_lower(texts.filter(plain)), pretoken.PLAIN_LOWER_SIGNS, r" \1 ")
        ids, counts = self._spread(pc.utf8_split_whitespace(spaced))
        if mask.all():
            return ids, counts
        odd = [[w for k, piece in enumerate(pretoken.split_special(t)) for w in ([piece] if k % 2 else pretoken.words(piece))] for t in texts.filter(pc.invert(plain)).to_pylist()]
        odd_ids, odd_counts = self._spread(pa.array(odd, pa.list_(pa.string())))
        all_counts = np.zeros(len(texts), np.int64)
        all_counts[mask], all_counts[~mask] = counts, odd_counts
        out, of = np.zeros(int(all_counts.sum()), self.kind), np.repeat(mask, all_counts)
        out[of], out[~of] = ids, odd_ids
        return out, all_counts


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Counter(path)


#: Texts are taken in groups of about so many bytes, which bounds memory: the
#: arrays of a group take about fifty times its bytes.
_GROUP = 1_000_000


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids binary, n long, part int, before long)``; the ``n`` ids are
    little-endian, of 16 bits where the vocabulary allows it and else of 32."""

    def run(batches):
        tool, part, before = counter(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes, start = pc.binary_length(batch.column(1)).to_pylist(), 0
            while start < len(sizes):
                stop, size = start, 0
                while stop < len(sizes) and (stop == start or size < _GROUP):
                    size += sizes[stop]
                    stop += 1
                ids, counts = tool.ids(batch.column(1).slice(start, stop - start))
                n = counts + 1
                until = np.cumsum(n)
                whole = np.full(int(until[-1]), end_id, tool.kind)
                inner = np.ones(len(whole), bool)
                inner[until - 1] = False
                whole[inner] = ids
                offsets = np.concatenate([[0], until]) * tool.kind.itemsize
                if offsets[-1] < 1 << 31:
                    blobs = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(whole)])
                else:
                    blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(whole)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), blobs, pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(before + until - n)], ["doc_id", "ids", "n", "part", "before"])
                before += int(until[-1])
                start = stop
                pa.default_memory_pool().release_unused()

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids binary, n long, part int, before long")


def _cut(window: int):
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            base, n = (np.asarray(batch.column(c)).tolist() for c in ("base", "n"))
            for k, blob in enumerate(batch.column("ids")):
                raw = blob.as_buffer()
                ids, first, start = np.frombuffer(raw, f"<u{raw.size // n[k]}").astype("<u4"), base[k], 0
                while start < len(ids):
                    sequence, offset = divmod(first + start, window)
                    piece = ids[start : start + window - offset]
                    out.append((k, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), sequence, offset))
                    start += len(piece)
            rows, *columns = np.array(out, dtype=np.int64).reshape(-1, 7).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), *map(pa.array, columns)], ["doc_id", *PIECE[1:]])

    return run


PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.

    Each row of ``docs`` is its ids and ``end_id``; null and empty texts are
    just ``end_id``. Rows that share an id, or have none, are packed one by
    one. An empty table gives no piece. Order: as the rows are read.
    """
    held = stored(tokenize(docs, tokenizer, end_id, id_col, text_col), "ids")
    totals = held.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(totals.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("part_base")), "offsets")
    placed = held.join(offsets, "part").select("doc_id", "ids", "n", (F.col("part_base") + F.col("before")).alias("base"))
    kind = dict(placed.dtypes)["doc_id"]
    return placed.mapInArrow(_cut(window), f"doc_id {kind}, " + ", ".join(f"`{c}` long" for c in PIECE[1:]))
