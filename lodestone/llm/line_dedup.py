"""Removal of repeated runs of lines by winnowing.

A line is what ``\\n`` separates, compared without outer white space; blank
lines do not count. Lengths are in words, so that a paragraph on one line and
the same words on ten lines weigh alike:

1. *Grams.* The gram of a line is the shortest stretch from it on that has
   ``gram`` words. Its hash is the MD5 of its lines.
2. *Fingerprints.* A window is the shortest stretch from a line on that has
   ``window`` words (a document with fewer is one window). Of the grams inside
   each window the one of least hash is selected, the last of equal ones, so
   that a run of ``window`` words that two places share has a fingerprint
   selected in both.
3. *Positions.* Equal fingerprints are joined, each place to the first one only:
   a passage that a third of all documents hold adds one row per place and not
   one per pair. First means the smallest id, then the smallest line number.
4. *Extension.* From its fingerprint a match goes on line by line, both ways,
   as long as the lines are equal, up to the neighbouring fingerprints of
   either place, which have matches of their own. What a fingerprint carries
   for this is thus bounded by ``window``, not by the document.
5. *Deletion.* The run goes, with the blank lines inside it. Each line deleted
   has an equal one at an earlier place, so the first of equal lines always
   stays: no wording is lost.

Guaranteed is that of each shared window at least the selected gram goes (a
line of ``window`` words is always one by itself); single lines of fewer than
``gram`` words never go alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import id_text, stored

GRAM, WINDOW = 10, 20
#: Texts are taken in groups of about so many bytes, which bounds memory.
_GROUP = 4_000_000
#: Fingerprints that stand in this share of all places are at most 1 / share, so
#: that their first places can be broadcast.
HOT_SHARE = 0.001
_SPACE = " \t\n\x0b\x0c\r"
_KEY = ["gram_a", "gram_b"]


def _reach(before: np.ndarray, stop: np.ndarray, words: int) -> np.ndarray:
    """Per line the last line of the shortest stretch of so many words from it
    on (past ``stop``, where its document ends, if that has too few).

    ``before`` has the words before each line, and the total at its end."""
    end = np.searchsorted(before, before[:-1] + words, side="left") - 1
    return np.where(end < stop, end, len(before))


def _least(key: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of ``key[first : last + 1]`` for each pair, by a sparse table."""
    size = last - first + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    out, table = np.empty(len(first), key.dtype), key
    for k in range(int(level.max(initial=0)) + 1):
        some = level == k
        out[some] = np.minimum(table[first[some]], table[last[some] - (1 << k) + 1])
        if (1 << k) < len(table):
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


class Lines:
    """The non-blank lines of some texts one after another."""

    def __init__(self, texts: list[bytes]):
        cores: list[bytes] = []
        raw: list[int] = []
        words: list[int] = []
        bounds = [0]
        for text in texts:
            for k, line in enumerate(text.split(b"\n")):
                if core := line.strip():
                    cores.append(core)
                    raw.append(k)
                    words.append(len(core.split()))
            bounds.append(len(cores))
        self.cores, self.raw = cores, np.array(raw, np.int32)
        self.bounds = np.array(bounds, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        self.start, self.stop = self.bounds[:-1][self.doc], self.bounds[1:][self.doc]
        self.before = np.concatenate([[0], np.cumsum(np.array(words, np.int64))])
        self.hash = np.frombuffer(b"".join([md5(c, usedforsecurity=False).digest() for c in cores]), ">u8").reshape(-1, 2)

    def select(self, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last lines of the selected grams, and their hashes."""
        n, none = len(self.cores), len(self.before)
        end = _reach(self.before, self.stop, gram)
        ok = end < none
        key = self.hash.astype(np.uint64)
        for i in np.flatnonzero(ok & (end > np.arange(n))).tolist():
            key[i] = np.frombuffer(md5(b"\n".join(self.cores[i : end[i] + 1]), usedforsecurity=False).digest(), ">u8")
        # One number that orders by hash, the later of equal grams first.
        rank = np.unique(key[:, 0], return_inverse=True)[1].astype(np.int64)
        order = np.where(ok, (rank << 32) | (n - 1 - np.arange(n)), np.iinfo(np.int64).max)
        until = _reach(self.before, self.stop, window)
        whole = (np.arange(n) == self.start) & (until >= none)
        until = np.where(whole, self.stop - 1, until)
        from_ = np.flatnonzero(until < none)
        # The grams inside a window are those that start in it, up to the last that ends in it.
        last = np.searchsorted(np.where(ok, end, self.stop), until[from_], side="right") - 1
        some = last >= from_
        best = _least(order, from_[some], last[some])
        picked = np.unique(n - 1 - (best[best < np.iinfo(np.int64).max] & 0xFFFFFFFF))
        return picked, end[picked], key[picked]


def _around(lines: Lines, picked: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many lines the surroundings of each selected gram have: back to the
    start of the one before, and on to the start of the next."""
    doc = lines.doc[picked]
    earlier = np.concatenate([[-1], picked[:-1]])
    back = np.where(np.concatenate([[True], doc[1:] != doc[:-1]]), lines.start[picked], earlier)
    later = np.concatenate([picked[1:], [0]])
    on = np.where(np.concatenate([doc[1:] != doc[:-1], [True]]), lines.stop[picked] - 1, later)
    return picked - back, np.maximum(on - end, 0)


def _ragged(values: np.ndarray, first: np.ndarray, size: np.ndarray, step: int, kind: pa.DataType) -> pa.Array:
    """Lists ``values[first], values[first + step], ...`` of the given sizes."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(first, size) + step * (np.arange(offsets[-1]) - np.repeat(offsets[:-1], size))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[at], kind))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """The selected grams ``(doc_id, text_hash, at, gram_a, gram_b, first, last,
    left, left_at, right, right_at)``.

    ``at`` is the number of the gram's first line among the non-blank lines;
    ``first``, ``last`` and the arrays ``left_at`` and ``right_at`` are numbers
    among all lines. ``left`` and ``right`` hold the hashes of the lines around
    it, nearest first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, start = pc.binary_length(batch.column(1)).to_pylist(), 0
            while start < len(sizes):
                stop, size = start, 0
                while stop < len(sizes) and (stop == start or size + sizes[stop] <= _GROUP):
                    size += sizes[stop]
                    stop += 1
                ids, texts = batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start).cast(pa.binary()).to_pylist()
                start = stop
                lines = Lines(texts)
                if not lines.cores:
                    continue
                picked, end, key = lines.select(gram, window)
                back, on = _around(lines, picked, end)
                doc, short = lines.doc[picked], lines.hash[:, 0].astype(np.uint64).view(np.int64)
                text_hash = np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(doc)), pa.array(text_hash[doc]), pa.array((picked - lines.start[picked]).astype(np.int32)),
                        pa.array(key[:, 0].view(np.int64)), pa.array(np.ascontiguousarray(key[:, 1]).view(np.int64)), pa.array(lines.raw[picked]), pa.array(lines.raw[end]),
                        _ragged(short, picked - 1, back, -1, pa.int64()), _ragged(lines.raw, picked - 1, back, -1, pa.int32()),
                        _ragged(short, end + 1, on, 1, pa.int64()), _ragged(lines.raw, end + 1, on, 1, pa.int32()),
                    ],
                    ["doc_id", "text_hash", "at", *_KEY, "first", "last", "left", "left_at", "right", "right_at"],
                )

    rows = id_text(docs, id_col, text_col).where("doc_id is not null")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, at int, gram_a long, gram_b long, first int, last int, left array<long>, left_at array<int>, right array<long>, right_at array<int>")


def _equal_lines(a: str, b: str) -> Column:
    """How many elements two arrays have in common from their starts on."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differ > 0, differ - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, hot_share: float = HOT_SHARE) -> DataFrame:
    """``(doc_id, text_hash, gone)``: of each document with later repeats which
    lines go, as a string with ``1`` for each such line and ``0`` for others, up
    to the last that goes."""
    places = stored(fingerprints(docs, id_col, text_col, gram, window), "places")
    place = F.struct("doc_id", "text_hash", "at")
    first = places.groupBy(*_KEY).agg(F.min(F.struct("doc_id", "text_hash", "at", "left", "right")).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.select(*_KEY, "n", F.struct("f.doc_id", "f.text_hash", "f.at").alias("f_place"), F.col("f.left").alias("f_left"), F.col("f.right").alias("f_right")), "first")
    least = max(2.0, hot_share * places.count())
    hot, others = first.where(F.col("n") >= least), first.where(F.col("n") < least)  # hot: 1 / hot_share rows at most
    rest = places.join(F.broadcast(hot.select(*_KEY)), _KEY, "left_anti").join(others, _KEY)
    later = places.join(F.broadcast(hot), _KEY).unionByName(rest).where(place > F.col("f_place"))
    sized = later.select("doc_id", "text_hash", "first", "last", "left_at", "right_at", _equal_lines("left", "f_left").alias("before"), _equal_lines("right", "f_right").alias("after"))
    runs = sized.select(
        "doc_id", "text_hash",
        F.when(F.col("before") > 0, F.get("left_at", F.col("before") - 1)).otherwise(F.col("first")).alias("first"),
        F.when(F.col("after") > 0, F.get("right_at", F.col("after") - 1)).otherwise(F.col("last")).alias("last"),
    )
    lines = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("first", "last")), lambda r: F.sequence(r["first"], r["last"])))))
    gone = runs.groupBy("doc_id", "text_hash").agg(lines.alias("lines"))
    before = F.concat(F.array(F.lit(-1)), F.slice("lines", 1, F.size("lines") - 1))
    marks = F.transform(F.arrays_zip(F.col("lines").alias("k"), before.alias("b")), lambda z: F.concat(F.repeat(F.lit("0"), z["k"] - z["b"] - 1), F.lit("1")))
    return gone.select("doc_id", "text_hash", F.array_join(marks, "").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated runs deleted from the text, plus the columns
    ``n_lines, n_removed`` (non-blank lines).

    All columns of ``docs`` stay; those two are replaced if present. Rows that
    share an id are ordered by a hash of their texts, and rows that are alike in
    both lose the same lines. Rows with a null id have no place in the order:
    they neither delete nor lose lines. A null text stays null; a document
    without repeats keeps its text byte for byte. An empty table gives an empty
    one. The texts of the last step never leave the JVM.
    """
    found = repeated_runs(docs, id_col, text_col, gram, window)
    found = found.select(F.col("doc_id").alias("__lines_id"), F.col("text_hash").alias("__lines_hash"), F.col("gone").alias("__lines_gone"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    same = (F.col(id_col) == F.col("__lines_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__lines_hash"))
    rows = docs.select(*columns).join(found, same, "left")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    full = lambda x: F.btrim(x, F.lit(_SPACE)) != ""
    marked = F.arrays_zip(lines.alias("line"), F.split("__lines_gone", "").alias("gone"))
    out = F.filter(marked, lambda z: F.coalesce(z["gone"] != "1", F.lit(True)) & z["line"].isNotNull())
    text = F.when(F.col("__lines_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(out, lambda z: z["line"]), "\n"))
    removed = F.size(F.filter(marked, lambda z: F.coalesce(z["gone"] == "1", F.lit(False)) & full(z["line"])))
    kept = [text.alias(c) if c == text_col else F.col(c) for c in columns]
    return rows.select(*kept, F.size(F.filter(lines, full)).cast("long").alias("n_lines"), F.when(F.col("__lines_gone").isNull(), 0).otherwise(removed).cast("long").alias("n_removed"))
