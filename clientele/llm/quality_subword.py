"""Quality classifier: supervised subword embeddings.

Every word and every character n-gram of a document hashes to a learned vector, and so does the pair of equal neighbouring
words (one vector for all such pairs); the average of all goes through a softmax.
Vectors and output weights are trained together by stochastic gradient descent in numpy. Since the output is linear in
the average, scoring needs one number per slot, ``vector @ output``, instead of the vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .labelled import crc_part, fit_in_task, training_sample


PAIR = 0                         # slot of the pair of equal neighbouring words


@dataclass
class Model:
    vectors: np.ndarray          # slots x dims
    output: np.ndarray           # dims x 2
    bias: np.ndarray             # 2
    bits: int

    def margins(self) -> np.ndarray:
        """Per slot: its part in logit(1) - logit(0)."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32)

    def linear(self) -> tuple[np.ndarray, float, int]:
        return self.margins(), float(self.bias[1] - self.bias[0]), self.bits


def _bags(texts: list[str], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: distinct slots and their shares of its features."""
    bags, cuts, twice, n_words = K.Bags(bits), [0], [], 0
    for a, z in K.chunks([len(t) for t in texts], K.CHUNK // 4):
        points, docs = K.code_points(texts[a:z])
        starts = bags.add(points)
        cuts += (np.searchsorted(starts, docs[1:]) + n_words).tolist()
        twice += np.diff(np.searchsorted(K.repeats(points), docs)).tolist()
        n_words += len(starts)
    index, slots, bounds = bags.joined()
    out = []
    for i, again in enumerate(twice):
        word, times = np.unique(index[cuts[i]:cuts[i + 1]], return_counts=True)
        lengths = bounds[word + 1] - bounds[word]
        before = np.cumsum(lengths) - lengths
        at = np.repeat(bounds[word] - before, lengths) + np.arange(lengths.sum())
        share = np.append(np.repeat(times, lengths), again).astype(np.float32)
        out.append((np.append(slots[at], PAIR).astype(np.int32), share / max(1.0, share.sum())))
    return out


def fit(texts: list[str], y: np.ndarray, bits: int = 18, dims: int = 8, rounds: int = 6, rate: float = 40.0, step: int = 32, seed: int = 5) -> Model:
    """Mini-batch descent with a linearly falling rate; classes weigh alike. Fewer than two classes: a constant model.

    The rate is large because a single slot holds a small share of a document's average.
    """
    rng = np.random.default_rng(seed)
    model = Model(np.zeros((1 << bits, dims), np.float32), np.zeros((dims, 2), np.float32), np.zeros(2, np.float32), bits)
    present = sorted(set(y.tolist()))
    if len(present) < 2:
        if present:
            model.bias[present[0]] = 4.0
        return model
    model.vectors[:] = rng.uniform(-1 / dims, 1 / dims, model.vectors.shape)
    model.output[:] = rng.normal(0, 0.5, model.output.shape)
    bags = _bags(texts, bits)
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum())).astype(np.float32)
    total, done = rounds * len(y), 0
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for a in range(0, len(y), step):
            pick = order[a:a + step]
            slots = np.concatenate([bags[i][0] for i in pick])
            share = np.concatenate([bags[i][1] for i in pick])
            size = np.array([len(bags[i][0]) for i in pick])
            doc = np.repeat(np.arange(len(pick)), size)
            rows = model.vectors[slots]
            mean = np.stack([np.bincount(doc, rows[:, k] * share, len(pick)) for k in range(dims)], 1).astype(np.float32)
            logits = mean @ model.output + model.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= (weight[pick] / len(pick))[:, None]
            now = rate * (1 - done / total)
            back = p @ model.output.T
            used, inverse = np.unique(slots, return_inverse=True)
            for k in range(dims):
                model.vectors[used, k] -= now * np.bincount(inverse, share * back[doc, k], len(used)).astype(np.float32)
            model.output -= 0.02 * now * (mean.T @ p)
            model.bias -= 0.005 * now * p.sum(0)
            done += len(pick)
    return model


def score_texts(margins: np.ndarray, bias: float, bits: int, texts: list[str]) -> np.ndarray:
    """Probability of label 1; a text without words has the softmax of the bias."""
    out = np.zeros(len(texts))
    for a, z in K.chunks([len(t) for t in texts]):
        points, docs = K.code_points(texts[a:z])
        total, count = K.linear_sums(points, docs, margins, bits)
        twice = np.diff(np.searchsorted(K.repeats(points), docs))
        total, count = total + twice * margins[PAIR], count + twice
        out[a:z] = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -700, 700)))
    return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, seed: int = 17) -> Model:
    """Fits on at most ``per_class`` labelled documents of each class whose crc32(doc_id) mod 5 is not 0."""
    return fit_in_task(training_sample(docs, labels, "quality", crc_part(F.col("doc_id"), 5) != 0, per_class, seed), fit)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``: one row per input row.

    Null and blank texts get the model's score for no features; repeated rows score alike; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.linear())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = score_texts(*held.value, K.texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (crc_part(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores the threshold or more, unchanged."""
    held = docs.sparkSession.sparkContext.broadcast(model.linear())
    return K.keep_rows(docs, lambda texts: score_texts(*held.value, texts) >= threshold)
