"""Quality classifier with supervised subword embeddings.

Every hashed word and character n-gram has a learned vector. A word is the mean
of its vectors, a document the mean of its words, and a softmax gives the two
classes. Vectors and output weights are trained together by stochastic
gradient descent in numpy. A word that repeats the one before it counts as the
word ``REPEAT``, which stands for stuttering text.

The document is a mean of linear terms, so for scoring the vectors fold into
one weight for each feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import subwords
from lodestone.llm.common import id_text

DIM, EPOCHS, RATE, BATCH, THRESHOLD = 8, 4, 0.5, 32, 0.7
REPEAT = "\x00repeat"


def words(text: str) -> list[str]:
    raw = text.split()
    return raw[:1] + [b if a != b else REPEAT for a, b in zip(raw, raw[1:])]


class Model:
    def __init__(self, weights: np.ndarray, bias: float, constant: float | None = None):
        self.weights, self.bias, self.constant = weights, bias, constant

    def scorer(self):
        """``text -> score``."""
        if self.constant is not None:
            return lambda text: self.constant
        word = subwords.WordScores(self.weights)

        def score(text: str) -> float:
            found = words(text)
            mean = sum(map(word.__getitem__, found)) / len(found) if found else 0.0
            return float(1 / (1 + np.exp(-np.clip(mean + self.bias, -50, 50))))

        return score


def train(texts: list[str], y: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, batch: int = BATCH, seed: int = 7) -> Model:
    """Without both classes the model is constant: the share of label 1, or 0.5."""
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(0, np.float32), 0.0, float(y.mean()) if len(y) else 0.5)
    table, rng = subwords.WordTable([words(t) for t in texts]), np.random.default_rng(seed)
    vectors = ((rng.random((subwords.BUCKETS, dim)) - 0.5) / dim).astype(np.float32)
    output, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    full = np.array([k for k, d in enumerate(table.docs) if len(d)])
    grads, gout = np.full(subwords.BUCKETS, 1e-6, np.float32), np.full((dim, 2), 1e-6, np.float32)
    for epoch in range(epochs):
        order = rng.permutation(full)
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            used, where = np.unique(np.concatenate([table.docs[k] for k in some]), return_inverse=True)
            owner = np.repeat(np.arange(len(some)), [len(table.docs[k]) for k in some])
            # mix[d, w]: the share of word w in document d
            mix = np.bincount(owner * len(used) + where, minlength=len(some) * len(used)).reshape(len(some), -1).astype(np.float32)
            mix /= mix.sum(axis=1, keepdims=True)
            n = table.count[used]
            begin = np.cumsum(n) - n
            flat = table.flat[np.repeat(table.start[used] - begin, n) + np.arange(int(n.sum()))]
            word_vec = np.add.reduceat(vectors[flat], begin) / n[:, None]
            doc = mix @ word_vec
            z = doc @ output + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some].astype(int)] -= 1
            p /= len(some)
            g_out, g_doc = doc.T @ p, p @ output.T
            g_word = ((mix.T @ g_doc) / n[:, None]).astype(np.float32)
            g_flat = np.repeat(g_word, n, axis=0)
            rows, inverse = np.unique(flat, return_inverse=True)
            g = np.stack([np.bincount(inverse, g_flat[:, k], len(rows)) for k in range(dim)], axis=1).astype(np.float32)
            grads[rows] += (g * g).mean(axis=1)
            vectors[rows] -= rate * g / np.sqrt(grads[rows])[:, None]
            gout += g_out * g_out
            output -= rate * g_out / np.sqrt(gout)
            bias -= rate * 0.1 * p.sum(axis=0)
    difference = output[:, 1] - output[:, 0]
    return Model((vectors @ difference).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = subwords.SAMPLE_ROWS) -> Model:
    """Fitted on at most ``rows`` labelled rows of each class, none held out."""
    return train(*subwords.training_sample(docs, labels, "quality", rows))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per input row.

    A text without a word has the score of the bias alone, null ones too; with
    a constant model every row has its constant. Rows are independent of each
    other; rows with a null id are scored and not held out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    rows = id_text(docs, id_col, text_col)
    out = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
    return out.select("doc_id", subwords.held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
