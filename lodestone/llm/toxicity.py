"""Toxicity by multiple-instance learning.

Labels belong to documents; a document is toxic if one of its sentences is.
The score of a sentence is a logistic of the summed weights of its distinct
words, a word's weight being the sum of the weights of its hashed features: the
word itself and its beginnings. Sentence scores are combined by noisy-or,
``1 - prod(1 - p)``, and the weights and the bias are trained through it from
the document labels. Afterwards the sentence scores say where the offence is.

Training starts at the features' log-odds among the documents, drawn to zero
where few documents have them. The bias is then moved by what the threshold
does to training rows that were left out of the fit (``FOLDS`` times).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import subwords
from lodestone.llm.common import id_text
from lodestone.llm.pretoken import Cache

#: Chosen by the scores of left-out training rows: steps, their size, the pull
#: back to the log-odds, and the share of the documents that a feature's prior
#: counts for.
ROUNDS, RATE, PULL, PRIOR = 25, 0.05, 1e-3, 1 / 150
#: Features of fewer documents have no weight; characters of the beginnings.
LEAST_DOCS, BEGINNINGS = 3, (4, 5, 6, 7, 8)
#: The bias moves to where most rows are right, with at most ``FLAGGED`` of the
#: clean ones flagged.
FOLDS, FLAGGED, THRESHOLD = 5, 0.01, 0.3
#: Words remembered by a worker; a word takes a microsecond or two to compute.
CACHE_WORDS = 50_000
_TRIM = " \t\r\n.,;:!?\"'()[]{}<>|*#$%&-_"


def _split(text: str) -> tuple[list[str], list[int]]:
    """The distinct words of each sentence, and where each sentence starts
    among them (none is empty)."""
    raw = text.lower().replace("\n", " \n ").split(" ")
    words: list[str] = []
    starts: list[int] = []
    seen: set[str] = set()
    for w in raw:
        if (core := w.strip(_TRIM)) and core not in seen:
            if not seen:
                starts.append(len(words))
            seen.add(core)
            words.append(core)
        if w and w[-1] in ".!?\n" and seen:
            seen = set()
    return words, starts


def features(word: str) -> list[int]:
    """Buckets of the word and of the beginnings of ``<word>``."""
    raw, mask = f"<{word}>", subwords.BUCKETS - 1
    return [crc32(raw.encode()) & mask, *[crc32(raw[:g].encode(), g) & mask for g in BEGINNINGS if g < len(raw)]]


def noisy_or(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Document scores of sentence scores; ``first`` has each document's first."""
    return -np.expm1(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), first))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class Model:
    """Weights of the features, and the bias of a sentence."""

    def __init__(self, weights: np.ndarray, bias: float, constant: float | None = None):
        self.weights, self.bias, self.constant = weights, bias, constant

    def scorer(self):
        """``text -> (document score, sentence scores)``."""
        if self.constant is not None:
            return lambda text: (self.constant, np.zeros(0))
        of = self.weights.tolist()
        word = Cache(lambda w: sum([of[k] for k in features(w)]), CACHE_WORDS)

        def score(text: str) -> tuple[float, np.ndarray]:
            words, starts = _split(text)
            if not words:
                return 0.0, np.zeros(0)
            p = _logistic(np.add.reduceat(np.fromiter(map(word.__getitem__, words), dtype=np.float64, count=len(words)), starts) + self.bias)
            return float(noisy_or(p, np.zeros(1, np.int64))[0]), p

        return score


class _Bags:
    """Documents with a word each, as sentences of words of features."""

    def __init__(self, split: list[tuple[list[str], list[int]]]):
        self.table = table = subwords.WordTable([s[0] for s in split], features)
        self.word = np.concatenate(table.docs)
        begin = np.cumsum([0, *[len(d) for d in table.docs]])
        self.start = np.concatenate([np.array(s[1]) + o for s, o in zip(split, begin)])
        self.size = np.diff(np.append(self.start, len(self.word)))
        sentences = np.array([len(s[1]) for s in split])
        self.first, self.owner = np.cumsum(sentences) - sentences, np.repeat(np.arange(len(split)), sentences)
        self.held = [np.unique(np.concatenate([table.flat[table.start[k] : table.start[k + 1]] for k in set(d.tolist())])) for d in table.docs]

    def logits(self, weights: np.ndarray) -> np.ndarray:
        """Of each sentence, without the bias."""
        return np.add.reduceat(np.add.reduceat(weights[self.table.flat], self.table.start[:-1])[self.word], self.start)

    def fit(self, y: np.ndarray, use: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        """Weights and bias learned from the documents that ``use`` marks."""
        seen = np.zeros((2, subwords.BUCKETS))
        for found, label, used in zip(self.held, y, use):
            if used:
                seen[int(label)][found] += 1
        toxic, n = y[use].sum(), use.sum()
        odds = np.log((seen[1] + PRIOR * toxic) / (seen[0] + PRIOR * (n - toxic))) - np.log(toxic / (n - toxic))
        live = seen.sum(axis=0) >= LEAST_DOCS
        prior = np.where(live, np.maximum(odds, 0), 0)
        x = np.append(prior, -12.0)  # the bias comes last: without evidence hardly any sentence offends
        m, v, pull, share = np.zeros_like(x), np.zeros_like(x), np.append(prior, 0.0), use[self.owner] / n
        rate = np.append(np.full(len(prior), RATE), 2 * RATE)
        for t in range(1, rounds + 1):
            p = _logistic(self.logits(x[:-1]) + x[-1])
            whole = noisy_or(p, self.first)[self.owner]
            g = np.where(y[self.owner] == 1, -p * (1 - whole) / np.maximum(whole, 1e-9), p) * share
            per_word = np.bincount(self.word, np.repeat(g, self.size), len(self.table.count))
            grad = np.append((np.bincount(self.table.flat, np.repeat(per_word, self.table.count), subwords.BUCKETS) + PULL * (x - pull)[:-1]) * live, g.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            x = x - rate * (1 - (t - 1) / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        return x[:-1], float(x[-1])


def _shift(bags: _Bags, y: np.ndarray, rounds: int, threshold: float) -> float:
    """What to add to the bias, by documents that a fit did not see."""
    logits = np.zeros(len(bags.owner))
    for k in range(FOLDS):
        out = np.arange(len(y)) % FOLDS == k
        if len(set(y[~out].tolist())) < 2:
            return 0.0
        weights, bias = bags.fit(y, ~out, rounds)
        mine = out[bags.owner]
        logits[mine] = (bags.logits(weights) + bias)[mine]
    gains = []
    for move in (moves := np.arange(-4, 8.25, 0.25)):
        flagged = noisy_or(_logistic(logits + move), bags.first) >= threshold
        found, wrong = (flagged & (y == 1)).sum(), (flagged & (y == 0)).sum()
        gains.append(found - wrong if wrong <= FLAGGED * (y == 0).sum() else -np.inf)
    best = max(gains)
    # The middle of the moves that are equally good.
    return float(np.median(moves[np.array(gains) == best])) if best > -np.inf else 0.0


def train(texts: list[str], y: np.ndarray, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> Model:
    """Gradient descent with per-weight step sizes through the noisy-or.

    Without both classes among the texts that have a word the model is
    constant: the share of label 1, or 0.
    """
    split = [_split(t) for t in texts]
    some = np.array([bool(s[0]) for s in split], dtype=bool)
    if len(set(y[some].tolist())) < 2:
        return Model(np.zeros(0, np.float32), 0.0, float(y.mean()) if len(y) else 0.0)
    bags, y = _Bags([s for s in split if s[0]]), y[some]
    weights, bias = bags.fit(y, np.ones(len(y), bool), rounds)
    return Model(weights.astype(np.float32), bias + _shift(bags, y, rounds, threshold))


def fit(docs: DataFrame, labels: DataFrame, rows: int = subwords.SAMPLE_ROWS) -> Model:
    """Fitted on at most ``rows`` labelled rows of each class, none held out."""
    return train(*subwords.training_sample(docs, labels, "toxic", rows))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_sentences, worst_sentence)``.

    ``worst_sentence`` is the number of the sentence of highest score among
    those with a word (null if none). A text without a word scores 0, null
    ones too; with a constant model every row has its constant. Rows are
    independent of each other; rows with a null id are scored and not held out.
    """

    def run(batches):
        of = model.scorer()
        for batch in batches:
            both = [of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b[0] for b in both], pa.float64()), pa.array([len(b[1]) for b in both], pa.int32()), pa.array([int(b[1].argmax()) if len(b[1]) else None for b in both], pa.int32())], ["doc_id", "score", "n_sentences", "worst_sentence"])

    rows = id_text(docs, id_col, text_col)
    out = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, n_sentences int, worst_sentence int")
    return out.select("doc_id", subwords.held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "worst_sentence")


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, all columns as they
    are; repeated rows and rows with null ids or texts are judged one by one."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = model.scorer()
        for texts in batches:
            # One text at a time: a batch of long documents is not held twice.
            yield pa.array([of(t.as_py() or "")[0] for t in texts], pa.float64())

    return docs.where(run(F.col(text_col)) < threshold)
