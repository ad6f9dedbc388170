"""Hashed word and character n-gram features, shared by the classifiers."""

from __future__ import annotations

from array import array
from collections.abc import Callable
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import id_text
from lodestone.llm.pretoken import Cache

BUCKETS, GRAMS, CACHE_WORDS = 1 << 18, (3, 4, 5), 200_000
#: Bounds of the sample that a classifier is fitted on: rows of each class, and
#: the longest text taken (in characters).
SAMPLE_ROWS, SAMPLE_CHARS = 2500, 50_000


def features(word: str) -> list[int]:
    """Buckets of the word and of the n-grams of ``<word>``; never empty."""
    raw = f"<{word}>".encode()
    n, mask = len(raw), BUCKETS - 1
    return [crc32(raw) & mask, *[crc32(raw[a : a + g], g) & mask for g in GRAMS for a in range(n - g + 1)]]


class WordTable:
    """The distinct words of some documents with their features, flattened."""

    def __init__(self, docs: list[list[str]], features: Callable[[str], list[int]] = features):
        at: dict[str, int] = {}
        self.docs = [np.array([at.setdefault(w, len(at)) for w in d], dtype=np.int64) for d in docs]
        flat, count = array("i"), array("q")
        for w in at:
            found = features(w)
            flat.extend(found)
            count.append(len(found))
        self.flat, self.count = np.array(flat, dtype=np.int32), np.array(count, dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.count)])


class WordScores(Cache):
    """Word to the mean weight of its features, as plain floats."""

    def __init__(self, weights: np.ndarray):
        super().__init__(lambda w: float(weights[features(w)].mean()), CACHE_WORDS)


def held_out(id_col: str = "doc_id"):
    """Rows that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``rows`` documents of each class.

    Only labelled rows that are not held out and have a text of up to ``chars``
    characters count, in the order of a hash of their ids; a class has fewer
    than ``rows`` only if there are no more of them. Rows with a null id, text
    or label are left out; of an id labelled both ways the larger label is
    taken, of an id with several texts the least. The id may be of any type
    that labels and documents share.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    text = id_text(docs.where(F.col("text").isNotNull() & (F.length("text") <= chars)))
    known = known.join(text.select("doc_id"), "doc_id", "left_semi")
    pick = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        pick = some if pick is None else pick.union(some)
    chosen = [(r["doc_id"], r["y"]) for r in pick.collect()]  # at most 2 * rows pairs
    if not chosen:
        return [], np.zeros(0)
    small = docs.sparkSession.createDataFrame(chosen, f"doc_id {dict(known.dtypes)['doc_id']}, y int")
    found = text.join(F.broadcast(small), "doc_id").select("doc_id", "text", "y").toPandas()
    found = found.sort_values(["doc_id", "text"], ignore_index=True).drop_duplicates("doc_id", ignore_index=True)
    return found["text"].tolist(), found["y"].to_numpy(dtype=np.float64)
