"""Removal of repeated byte strings with suffix arrays by difference cover.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a
document with a smaller id. Sorting all suffixes of a corpus at once would
move many times its size, so the suffixes are dealt out first, by content:

1. *Copies.* A text that a document of smaller id also has, by a digest of 128
   bits, loses everything and takes no further part.
2. *Anchors.* Of the ``SEED``-byte strings in a string of ``LENGTH`` bytes the
   one of least hash is its anchor: two equal strings have the same one. Only
   hashes travel (five bytes each, once per batch); owners return for each
   whether another batch has it. Strings whose anchor no other document has
   are unique and done with.
3. *Suffix arrays.* The surroundings of the other anchors, distinct ones per
   batch with their smallest id, go to the owner of the anchor. It sorts their
   suffixes by difference cover (``suffix_sort``): triples at the sampled
   positions, recursion on the names, merging of the rest; neighbours in the
   order that share ``LENGTH`` bytes are one string, with a smallest id.
   Anchors in more than ``HOT`` batches would make one owner grow with the
   input, so their surroundings go in two halves, each to the owner of the bytes
   that all its strings share; those in ``HOTTER`` times as many batches go string
   by string to the owner of the string.
4. *Removal.* Owners return for each surrounding which of its strings start in
   a document of smaller id than its own smallest; documents with larger ids
   than that lose all of it. The batches mark and cut.

Between different texts bytes decide; hashes only choose what is compared.
Batches are kept as a bucketed table, so that the answers come to the texts and
texts are not shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_bytes, id_text, scratch_dir, stored
from lodestone.llm.suffix_sort import equal_prefixes

LENGTH, SEED, HOT, HOTTER = 50, 24, 512, 16
#: Text in a batch, and bytes of surroundings in one suffix array, at least.
BATCH_BYTES, ARRAY_BYTES = 3_000_000, 750_000
#: Text for each owner, about: how the files are split does not say how much an
#: owner sorts.
OWNER_BYTES = 8_000_000
#: Positions hashed at a time, which fits a processor's cache.
_SLICE = 1 << 16
_LAST = np.iinfo(np.int64).max  # stands for a null id
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= _C[3]
    h ^= h >> np.uint64(32)
    return h


def _words(buf: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of ``n`` positions on; ``buf`` is padded."""
    out = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        count = (n - r + 7) // 8
        out[r::8] = np.frombuffer(buf, "<u8", count=count, offset=r)
    return out


def _sliding(op, x: np.ndarray, window: int) -> np.ndarray:
    """``op`` over ``x[i : i + window]`` for each i; ``x`` ends in neutral values."""
    m, size = x, 1
    while size * 2 <= window:
        m = np.concatenate([op(m[:-size], m[size:]), m[-size:]])
        size *= 2
    rest = window - size
    return np.concatenate([op(m[:-rest], m[rest:]), m[-rest:]]) if rest else m


class Batch:
    """Texts side by side, with the anchors of all their strings."""

    def __init__(self, row: dict, length: int, seed: int):
        self.ids, self.sizes = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["sizes"], "<i8")
        self.text, self.length, self.seed = row["text"], length, seed
        self.ends = np.cumsum(self.sizes)
        self.buf = np.frombuffer(self.text + bytes(length + 8), np.uint8)
        self.copy = np.zeros(len(self.ids), bool)
        for told in row.get("copies") or []:
            at = np.frombuffer(told["docs"], "<i4")
            self.copy[at] = np.unpackbits(np.frombuffer(told["bits"], np.uint8), count=len(at)).astype(bool)

    def texts(self) -> Iterator[bytes]:
        for a, b in zip((self.ends - self.sizes).tolist(), self.ends.tolist()):
            yield self.text[a:b]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, hashes, and numbers of the documents."""
        n, span = len(self.text), self.length - self.seed + 1
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.empty(n, np.uint64)
        for a in range(0, n, _SLICE):
            m = min(_SLICE, n - a)
            word = _words(self.buf[a:], m + self.seed - 8)
            part = _mix(word[:m] * _C[0])
            for at in range(8, self.seed - 8, 8):
                part = _mix(part + word[at : at + m] * _C[1])
            h[a : a + m] = _mix(part + word[self.seed - 8 : self.seed - 8 + m] * _C[2])
        # From 1 on, as 0 stands for no window.
        rank = np.maximum((h >> np.uint64(32)).astype(np.uint32), np.uint32(1))
        # Windows lie within one document; elsewhere their minimum counts as none.
        low = _sliding(np.minimum, np.concatenate([rank, np.full(span, 2**32 - 1, np.uint32)]), span)[:n]
        inside = np.zeros(n + 1, np.int32)  # documents whose strings start here: one or none
        begin, stop = self.ends - self.sizes, np.maximum(self.ends - self.length + 1, self.ends - self.sizes)
        stop[self.copy] = begin[self.copy]
        np.add.at(inside, begin, 1)
        np.subtract.at(inside, stop, 1)
        low[np.cumsum(inside[:n]) == 0] = 0  # also where a document is a copy
        high = _sliding(np.maximum, np.concatenate([low[::-1], np.zeros(span, np.uint32)]), span)[:n][::-1]
        where = np.flatnonzero((high == rank) & (high > 0))
        return where, h[where], np.searchsorted(self.ends, where, side="right")


def _owner(h: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and the 40 bits that tell the hashes of one owner apart."""
    return ((h >> np.uint64(40)) % np.uint64(owners)).astype(np.int64), h & np.uint64((1 << 40) - 1)


def _distinct(batch: Batch, owners: int):
    """Anchors, their number among the batch's distinct ``(owner, 40 bits)``
    pairs, those pairs in order, and which occur in two documents here."""
    where, h, doc = batch.anchors()
    owner, low = _owner(h, owners)
    key = (owner.astype(np.uint64) << np.uint64(40)) | low
    distinct, number = np.unique(key, return_inverse=True)
    least, most = np.full(len(distinct), _LAST), np.full(len(distinct), -1)
    np.minimum.at(least, number, doc)
    np.maximum.at(most, number, doc)
    return where, doc, number, distinct, most > least


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def _by_owner(owner: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of a sorted array of owners."""
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]) if len(owner) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(owner[a]), slice(int(a), int(b))


def _batch_table(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    def run(batches):
        part, seq, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            blob = [np.array(ids, "<i8").tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(), b"".join(texts)]
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), *(pa.array([x], pa.binary()) for x in blob)], ["batch", "ids", "sizes", "text"])

        for batch in batches:
            column = batch.column(1)
            for key, text in zip(batch.column(0).to_pylist(), column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()):
                ids.append(_LAST if key is None else key)
                texts.append(text)
                size += len(text)
                if size >= BATCH_BYTES:
                    yield row()
                    seq, ids, texts, size = seq + 1, [], [], 0
        if ids:
            yield row()

    rows = id_text(docs, id_col, text_col).mapInArrow(run, "batch long, ids binary, sizes binary, text binary")
    name = f"batches_{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").bucketBy(buckets, "batch").option("path", f"{scratch_dir(docs.sparkSession)}/batches").saveAsTable(name)
    return docs.sparkSession.table(name)


def _told(table: DataFrame, answers: DataFrame, columns: list[str], buckets: int, name: str = "told") -> DataFrame:
    """The batches with their owners' answers, which come as one list each.

    The answers are dealt like the batches' buckets: no text is shuffled."""
    dealt = answers.repartition(buckets, "batch").groupBy("batch")
    return table.join(dealt.agg(F.sort_array(F.collect_list(F.struct("owner", *columns))).alias(name)).hint("merge"), "batch", "left")


def _find_copies(table: DataFrame, owners: int) -> DataFrame:
    """``(batch, owner, docs, bits)``: which documents of a batch have the text
    of a document of smaller id."""

    def send(batches):
        for row in _rows(batches):
            batch = Batch(row, LENGTH, SEED)
            digest = np.frombuffer(b"".join([hashlib.blake2b(t, digest_size=16).digest() for t in batch.texts()]), "<u8").reshape(-1, 2)
            owner = (digest[:, 0] % np.uint64(owners)).astype(np.int64)
            order = np.argsort(owner, kind="stable")
            out = list(_by_owner(owner[order]))
            blobs = [[x[order[s]].tobytes() for _, s in out] for x in (np.arange(len(owner), dtype="<i4"), digest, batch.ids)]
            yield pa.RecordBatch.from_arrays([pa.array([row["batch"]] * len(out), pa.int64()), pa.array([o for o, _ in out], pa.int64()), *(pa.array(b, pa.binary()) for b in blobs)], ["batch", "owner", "docs", "digests", "ids"])

    def decide(group: pa.Table) -> pa.Table:
        digests = np.frombuffer(b"".join(group.column("digests").to_pylist()), "<u8").reshape(-1, 2)
        ids = np.frombuffer(b"".join(group.column("ids").to_pylist()), "<i8")
        order = np.lexsort((ids, digests[:, 1], digests[:, 0]))
        new = np.r_[True, (digests[order][1:] != digests[order][:-1]).any(axis=1)]
        least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        copy = np.empty(len(ids), bool)
        copy[order] = least < ids[order]
        cut = np.cumsum([len(x) // 8 for x in group.column("ids").to_pylist()])[:-1]
        return pa.table({"batch": group.column("batch"), "owner": group.column("owner"), "docs": group.column("docs"), "bits": pa.array([np.packbits(x).tobytes() for x in np.split(copy, cut)], pa.binary())})

    sent = table.mapInArrow(send, "batch long, owner long, docs binary, digests binary, ids binary")
    return sent.groupBy("owner").applyInArrow(decide, "batch long, owner long, docs binary, bits binary")


def _find_anchors(table: DataFrame, owners: int, length: int, seed: int, hot: int) -> DataFrame:
    """``(batch, owner, shared, hot)``: bits for a batch's distinct anchors; of
    ``hot`` the latter half for those that are ``HOTTER``."""
    hotter = hot * HOTTER

    def send(batches):
        for row in _rows(batches):
            *_, distinct, _ = _distinct(Batch(row, length, seed), owners)
            out = list(_by_owner((distinct >> np.uint64(40)).astype(np.int64)))
            low = np.ascontiguousarray(distinct).view(np.uint8).reshape(-1, 8)[:, :5]
            yield pa.RecordBatch.from_arrays([pa.array([row["batch"]] * len(out), pa.int64()), pa.array([o for o, _ in out], pa.int64()), pa.array([low[s].tobytes() for _, s in out], pa.binary())], ["batch", "owner", "anchors"])

    def decide(group: pa.Table) -> pa.Table:
        lists = []
        for raw in group.column("anchors").to_pylist():
            wide = np.zeros((len(raw) // 5, 8), np.uint8)
            wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
            lists.append(wide.view("<u8").ravel())
        _, number, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        count, cut = count[number], np.cumsum([len(x) for x in lists])[:-1]
        bits = [[np.packbits(x).tobytes() for x in np.split(flag, cut)] for flag in (count > 1, count > hot, count > hotter)]
        bits[1] = [a + b for a, b in zip(*bits[1:])]
        return pa.table({"batch": group.column("batch"), "owner": group.column("owner"), "shared": pa.array(bits[0], pa.binary()), "hot": pa.array(bits[1], pa.binary())})

    sent = table.mapInArrow(send, "batch long, owner long, anchors binary")
    return sent.groupBy("owner").applyInArrow(decide, "batch long, owner long, shared binary, hot binary")


def _hashed(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    h = np.zeros(len(rows), np.uint64)
    for k in range(0, wide.shape[1], 8):
        h = _mix(h + np.ascontiguousarray(wide[:, k : k + 8]).view("<u8").ravel() * _C[k // 8 % 3])
    return h


def _distinct_rows(buf: np.ndarray, where: np.ndarray, before: np.ndarray, after: np.ndarray, reach: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct surroundings of anchors, with the numbers of their valid bytes
    as the last two of each, their hashes, a place where each is, and which of
    them each anchor has. ``_SLICE`` anchors are written out at a time, so that
    only distinct ones take memory."""
    width = 2 * reach + seed
    padded = np.concatenate([np.zeros(reach, np.uint8), buf, np.zeros(8, np.uint8)])
    windows, column = np.lib.stride_tricks.sliding_window_view(padded, width), np.arange(width)[None, :]
    held, hashes, places, same, n = [], [], [], np.empty(len(where), np.int64), 0
    for a in range(0, len(where), _SLICE):
        s = slice(a, a + _SLICE)
        rows = np.zeros((len(where[s]), -(-(width + 2) // 8) * 8), np.uint8)
        text = windows[where[s]]
        text[(column < (reach - before[s])[:, None]) | (column >= (reach + seed + after[s])[:, None])] = 0
        rows[:, :width], rows[:, width], rows[:, width + 1] = text, before[s], after[s]
        h = _hashed(rows)
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        if (rows[first[back]] != rows).any():  # two surroundings of one hash: all stand by themselves
            first = back = np.arange(len(rows))
        held, hashes, places = [*held, rows[first]], [*hashes, h[first]], [*places, first + a]
        same[s], n = back + n, n + len(first)
    rows, h, place = (x[0] if len(x) == 1 else np.concatenate(x) for x in (held, hashes, places))
    if len(held) > 1:
        held.clear()
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        if all((rows[first[back[a : a + _SLICE]]] == rows[a : a + _SLICE]).all() for a in range(0, n, _SLICE)):
            rows, h, place, same = rows[first], h[first], place[first], back[same]
    return rows[:, : width + 2], h, place, same


def _surroundings(table: DataFrame, answers: DataFrame, owners: int, length: int, seed: int) -> DataFrame:
    """``(batch, owner, rows, least)``. Rows are surroundings with the numbers
    of valid bytes before and after the anchor; the row of owner -1 has the
    places: position, document, surrounding, and which string of it (-1: all;
    -2, -3: those whose anchor is before or after the middle)."""
    reach = length - seed
    width, half = 2 * reach + seed, (reach + 1) // 2

    def run(batches):
        for row in _rows(batches):
            batch = Batch(row, length, seed)
            where, doc, number, distinct, shared = _distinct(batch, owners)
            hot = np.zeros(len(distinct), np.int64)
            runs = dict(_by_owner((distinct >> np.uint64(40)).astype(np.int64)))
            for told in row["told"] or []:
                s = runs[told["owner"]]
                n = s.stop - s.start
                shared[s] |= np.unpackbits(np.frombuffer(told["shared"], np.uint8), count=n).astype(bool)
                hot[s] = sum(np.unpackbits(x, count=n).astype(np.int64) for x in np.split(np.frombuffer(told["hot"], np.uint8), 2))
            keep = shared[number]
            where, doc, number = where[keep], doc[keep], number[keep]
            if not len(where):
                continue
            before = np.minimum(where - (batch.ends - batch.sizes)[doc], reach)
            after = np.minimum(batch.ends[doc] - where - seed, reach)
            owner = (distinct[number] >> np.uint64(40)).astype(np.int64)
            own, single = hot[number], np.full(len(where), -1)
            if own.any():
                # Each string by itself: its bytes before and after are all that is valid.
                shift = np.arange(reach + 1)
                string = np.flatnonzero(own == 2)
                which, o = np.nonzero((shift[None, :] <= before[string][:, None]) & (reach - shift[None, :] <= after[string][:, None]))
                string = string[which]
                # Halves: strings with fewer than ``half`` bytes before the anchor, and the others.
                low, high = (np.flatnonzero(x) for x in ((own == 1) & (after >= reach - np.minimum(before, half - 1)), (own == 1) & (before >= half) & (np.minimum(after, reach - half) >= reach - before)))
                rest = np.flatnonzero(own == 0)
                before, after = np.concatenate([before[rest], np.minimum(before[low], half - 1), before[high], o]), np.concatenate([after[rest], after[low], np.minimum(after[high], reach - half), reach - o])
                single = np.concatenate([single[rest], np.full(len(low), -2), np.full(len(high), -3), o])
                where, doc, owner = (np.concatenate([x[rest], x[low], x[high], x[string]]) for x in (where, doc, owner))
            rows, h, first, same = _distinct_rows(batch.buf, where, before, after, reach, seed)
            dealt, code = owner[first], single[first]
            dealt[code >= 0] = (h[code >= 0] >> np.uint64(33)).astype(np.int64) % owners
            for kind, a, b in ((-2, reach, width - half + 1), (-3, reach - half, reach + seed)):
                dealt[code == kind] = (_hashed(rows[code == kind, a:b]) >> np.uint64(33)).astype(np.int64) % owners
            order = np.argsort(dealt, kind="stable")
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            same = back[same]
            least = np.full(len(order), _LAST)
            np.minimum.at(least, same, batch.ids[doc])
            out = list(_by_owner(dealt[order]))
            place = np.stack([where, doc, same, single]).astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([row["batch"]] * (len(out) + 1), pa.int64()), pa.array([-1] + [o for o, _ in out], pa.int64()), pa.array([place] + [rows[order[s]].tobytes() for _, s in out], pa.binary()), pa.array([least.astype("<i8").tobytes()] + [least[s].astype("<i8").tobytes() for _, s in out], pa.binary())], ["batch", "owner", "rows", "least"])

    return _told(table, answers, ["shared", "hot"], owners).mapInArrow(run, "batch long, owner long, rows binary, least binary")


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    """The bytes of a binary column without nulls, one value after the other."""
    parts = []
    for c in column.chunks:
        offsets = np.frombuffer(c.buffers()[1], "<i8" if pa.types.is_large_binary(c.type) else "<i4", count=len(c) + 1, offset=c.offset * (8 if pa.types.is_large_binary(c.type) else 4)) if len(c) else np.zeros(1, np.int64)
        if offsets[-1] > offsets[0]:
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint8), *parts])


def _by_string(rows: np.ndarray, least: np.ndarray, length: int, reach: int) -> np.ndarray:
    """What ``_sort_suffixes`` finds for the surroundings of one anchor, string
    by string: equal ones have the anchor at the same place and the same hash,
    by which the suffix arrays are cut, so that none grows with their number."""
    width, bits = rows.shape[1] - 2, np.zeros(len(rows), np.uint32)
    for o in range(reach + 1):
        valid = np.flatnonzero((o <= rows[:, width]) & (reach - o <= rows[:, width + 1]))
        at = reach - o
        h = np.zeros(len(valid), np.uint64)
        for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
            h = _mix(h + np.ascontiguousarray(rows[valid, at + k : at + k + 8]).view("<u8").ravel() * _C[k // 8 % 3])
        order = np.argsort(h, kind="stable")
        change = h[order][1:] != h[order][:-1]
        # Strings that are there once are done with, as only they have their hash.
        several = order[~(np.r_[True, change] & np.r_[change, True])] if len(order) else order
        new = np.flatnonzero(np.r_[True, h[several][1:] != h[several][:-1]]) if len(several) else np.zeros(0, np.int64)
        cuts = new[np.unique(new * length // ARRAY_BYTES, return_index=True)[1]].tolist()
        for a, b in zip(cuts, [*cuts[1:], len(several)]):
            mine = valid[several[a:b]]
            # Only one of the rows of a string is sorted, if the bytes are the same.
            first = np.r_[True, h[several[a:b]][1:] != h[several[a:b]][:-1]]
            same, text = np.cumsum(first) - 1, rows[mine, at : at + length]
            if not (text == text[first][same]).all():
                first, same = np.ones(len(mine), bool), np.arange(len(mine))
            flat = np.concatenate([text[first].ravel(), np.zeros(8, np.uint8)])
            number = equal_prefixes(flat, np.arange(int(first.sum())) * length, length)[same]
            smallest = np.full(int(number.max()) + 1, _LAST)
            np.minimum.at(smallest, number, least[mine])
            bits[mine] |= (smallest[number] < least[mine]).astype(np.uint32) << np.uint32(o)
    return bits


def _sort_suffixes(sent: DataFrame, length: int, seed: int) -> DataFrame:
    """``(batch, owner, rows, least)``: for each surrounding the bits of the
    strings in it that start in a document of smaller id than its smallest."""
    reach = length - seed
    width = 2 * reach + seed

    def decide(group: pa.Table) -> pa.Table:
        sizes = np.asarray(pc.binary_length(group.column("rows"))) // (width + 2)
        rows = _joined(group.column("rows")).reshape(-1, width + 2)
        least = _joined(group.column("least")).view("<i8")
        bits = np.zeros(len(rows), np.uint32)
        # Surroundings of one anchor stay together; arrays are cut between anchors.
        h = np.zeros(len(rows), np.uint64)
        middle = rows[:, reach : reach + seed]
        for k in range(0, seed, 8):
            h = _mix(h + np.ascontiguousarray(middle[:, k : k + 8]).view("<u8").ravel() * _C[k // 8])
        order = np.argsort(h, kind="stable")
        new = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        cuts = [0]
        for c, following in zip(new[1:].tolist(), [*new[2:].tolist(), len(rows)]):
            if (c - cuts[-1]) * width >= ARRAY_BYTES or (following - c) * width >= 2 * ARRAY_BYTES:
                cuts.append(c)
        for a, b in zip(cuts, [*cuts[1:], len(rows)]):
            if (b - a) * width >= 2 * ARRAY_BYTES:  # one anchor among very many texts
                bits[order[a:b]] = _by_string(rows[order[a:b]], least[order[a:b]], length, reach)
                continue
            part = rows[order[a:b]]
            # Equal surroundings of different batches are one.
            key = np.zeros(len(part), np.uint64)
            wide = np.zeros((len(part), -(-(width + 2) // 8) * 8), np.uint8)
            wide[:, : width + 2] = part
            for k in range(0, wide.shape[1], 8):
                key = _mix(key + np.ascontiguousarray(wide[:, k : k + 8]).view("<u8").ravel() * _C[k // 8 % 3])
            _, first, same = np.unique(key, return_index=True, return_inverse=True)
            if (part[first[same]] != part).any():
                first = same = np.arange(len(part))
            mine, low = part[first], least[order[a:b]]
            lowest = np.full(len(first), _LAST)
            np.minimum.at(lowest, same, low)
            text = np.concatenate([np.ascontiguousarray(mine[:, :width]).ravel(), np.zeros(8, np.uint8)])
            shift = np.arange(reach + 1)
            which, o = np.nonzero((shift[None, :] <= mine[:, width][:, None]) & (reach - shift[None, :] <= mine[:, width + 1][:, None]))
            number = equal_prefixes(text, which * width + reach - o, length)
            smallest = np.full(int(number.max(initial=-1)) + 1, _LAST)
            np.minimum.at(smallest, number, lowest[which])
            at = np.full((len(mine), reach + 1), _LAST)
            at[which, o] = smallest[number]
            earlier = at[same] < low[:, None]
            bits[order[a:b]] = (earlier.astype(np.uint32) << shift.astype(np.uint32)[None, :]).sum(axis=1, dtype=np.uint32)
        cut = np.cumsum(sizes)[:-1]
        return pa.table({"batch": group.column("batch"), "owner": group.column("owner"), "bits": pa.array([x.astype("<u4").tobytes() for x in np.split(bits, cut)], pa.binary())})

    return sent.where("owner >= 0").groupBy("owner").applyInArrow(decide, "batch long, owner long, bits binary")


def _cut(table: DataFrame, sent: DataFrame, answers: DataFrame, owners: int, length: int, seed: int, with_text: bool) -> DataFrame:
    reach = length - seed
    half = (reach + 1) // 2

    def run(batches):
        for row in _rows(batches):
            batch = Batch(row, length, seed)
            n = len(batch.text)
            start = np.zeros(n, bool)
            if row["told"]:
                where, doc, same, single = np.frombuffer(row["told"][0]["rows"], "<i4").reshape(4, -1)
                least = np.frombuffer(row["told"][0]["least"], "<i8")
                bits = np.concatenate([np.frombuffer(t["rows"], "<u4") for t in row["told"][1:]])
                gone = np.where(least[same] < batch.ids[doc], np.uint32((1 << (reach + 1)) - 1), bits[same])
                begin, stop = (batch.ends - batch.sizes)[doc], batch.ends[doc]
                for o in range(reach + 1):
                    at = where - o
                    hit = (gone >> np.uint32(o) & np.uint32(1)).astype(bool) & (at >= begin) & (at + length <= stop) & ((single == -1) | (single == o) | (single == (-2 if o < half else -3)))
                    start[at[hit]] = True
            for k in np.flatnonzero(batch.copy):
                start[batch.ends[k] - batch.sizes[k] : max(batch.ends[k] - length + 1, batch.ends[k] - batch.sizes[k])] = True
            total = np.concatenate([[0], np.cumsum(start)])
            covered = total[1:] > total[np.maximum(np.arange(n) - length + 1, 0)]
            out = []
            for key, a, b in zip(batch.ids.tolist(), (batch.ends - batch.sizes).tolist(), batch.ends.tolist()):
                c = covered[a:b]
                left = batch.buf[a:b][~c].tobytes() if c.any() else batch.text[a:b]
                spans = int(c[:1].sum()) + int((c[1:] & ~c[:-1]).sum())
                out.append((None if key == _LAST else key, b - a, int(c.sum()), spans, hashlib.sha256(left).hexdigest(), left))
            arrays = [pa.array(list(x), t) for x, t in zip(zip(*out), [*[pa.int64()] * 4, pa.string(), pa.binary()])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_text], names[: 5 + with_text])

    told = sent.where("owner = -1").unionByName(answers.select("batch", "owner", F.col("bits").alias("rows"), F.lit(None).cast("binary").alias("least")))
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return _told(table, told, ["rows", "least"], owners).mapInArrow(run, columns)


def _owners(docs: DataFrame, text_col: str) -> int:
    """So many that none has much more than ``OWNER_BYTES`` of the texts, however
    few splits the files have."""
    n = docs.select(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return min(max(8, docs.rdd.getNumPartitions(), -(-n // OWNER_BYTES)), 65_536)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, hot: int = HOT, *, with_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary])``,
    one row per input row; ``kept`` are the bytes that stay.

    Null and empty texts have no bytes and lose none; nor do texts shorter than
    ``length``. Rows that share an id never remove from each other; rows with a
    null id come after all others and do not remove anything. Strings are
    judged on the input. ``length - seed`` is at most 31, ``seed`` a multiple of
    eight from 16 on. An empty table gives an empty one.
    """
    if seed < 16 or seed % 8 or not 8 <= length - seed <= 31:
        raise ValueError("seed must be 16, 24, ... and 8 to 31 less than length")
    bounded_bytes(docs.sparkSession)
    owners = _owners(docs, text_col)
    table = _batch_table(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, owners)
    copies = stored(_find_copies(table, owners), "copies")
    table = _told(table, copies, ["docs", "bits"], owners, "copies")
    anchors = stored(_find_anchors(table, owners, length, seed, hot), "anchors")
    sent = stored(_surroundings(table, anchors, owners, length, seed), "surroundings", "zstd")
    answers = stored(_sort_suffixes(sent, length, seed), "answers")
    return _cut(table, sent, answers, owners, length, seed, with_text)
