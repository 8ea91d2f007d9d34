"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from hashed word and character n-gram weights; the
bag's probability is their noisy-or, ``1 - prod(1 - p)``. The weights are trained from document labels alone, by gradient
descent on the cross-entropy of the bag; the sentence scores then point at the offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .labelled import crc_part, fit_in_task, training_sample

ENDS = (10, 33, 46, 63)          # line feed, exclamation mark, full stop, question mark


@dataclass
class Model:
    weights: np.ndarray          # one per slot
    bias: float
    bits: int


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def sentence_bounds(points: np.ndarray) -> np.ndarray:
    """Bounds of the sentences: one ends behind each end mark; a text's leading line feed is an end mark too."""
    ends = np.flatnonzero((points == 10) | (points == 33) | (points == 46) | (points == 63)) + 1
    return np.unique(np.concatenate(([0], ends, [len(points)])))


def fit(texts: list[str], y: np.ndarray, bits: int = 18, rounds: int = 220, rate: float = 0.03, damp: float = 3e-3, sparse: float = 2e-4) -> Model:
    """Full-batch Adam with an L1 pull on the cross-entropy of the noisy-or, classes weighing alike.

    ``damp`` keeps features of single documents from moving as fast as consistent ones; the rate falls to a tenth in the last third.
    With fewer than two classes the weights stay at zero.
    """
    w, b = np.zeros(1 << bits, np.float32), -6.0
    if len(set(y.tolist())) < 2:
        return Model(w, 12.0 if len(y) and y[0] == 1 else -12.0, bits)
    bags, lo, hi, doc_cut, low, n_words = K.Bags(bits), [], [], [0], [t.lower() for t in texts], 0
    for a, z in K.chunks([len(t) for t in low], K.CHUNK // 4):
        points, docs = K.code_points(low[a:z])
        starts = bags.add(points)
        bounds = sentence_bounds(points)
        word_cut = np.searchsorted(starts, bounds)
        full = np.flatnonzero(np.diff(word_cut) > 0)               # sentences with words
        lo.append(word_cut[full] + n_words)
        hi.append(word_cut[full + 1] + n_words)
        doc_cut += (np.searchsorted(bounds[full], docs[1:]) + doc_cut[-1]).tolist()
        n_words += len(starts)
    index, slots, slot_bounds = bags.joined()
    del bags
    lo, hi, doc_cut = np.concatenate(lo), np.concatenate(hi), np.array(doc_cut)
    doc_of = np.repeat(np.arange(len(texts)), np.diff(doc_cut))
    sentence_of = np.repeat(np.arange(len(lo), dtype=np.int32), hi - lo)
    word_of = np.repeat(np.arange(len(slot_bounds) - 1, dtype=np.int32), np.diff(slot_bounds))
    share = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum()))) / len(y)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        value = np.add.reduceat(w[slots], slot_bounds[:-1]) if len(slots) else w[:0]
        total = np.concatenate(([0.0], np.cumsum(value[index], dtype=np.float64)))
        z = b + total[hi] - total[lo]
        per_doc = np.concatenate(([0.0], np.cumsum(_softplus(z))))
        bag = np.maximum(per_doc[doc_cut[1:]] - per_doc[doc_cut[:-1]], 1e-9)
        slope = np.where(y == 1, np.maximum(-1 / np.expm1(np.minimum(bag, 50)), -20.0), 1.0) * share
        dz = slope[doc_of] / (1 + np.exp(-np.clip(z, -50, 50)))
        per_word = np.bincount(index, dz[sentence_of], len(value))
        g = np.bincount(slots, per_word[word_of], len(w)).astype(np.float32)
        gb = dz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        now = rate * min(1.0, max(0.1, 3 - 3 * t / rounds))
        pace = now / (np.sqrt(v / (1 - 0.99**t)) + damp)
        w -= pace * (m / (1 - 0.9**t))
        w = np.sign(w) * np.maximum(np.abs(w) - pace * sparse, 0)
        b -= now * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-4)
    return Model(w, float(b), bits)


def _sentences(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the sentences with words, their logits, and each text's first such sentence (n + 1)."""
    points, docs = K.code_points(texts)
    bounds = sentence_bounds(points)
    starts, _ = K.words(K.is_space(points))
    full = np.diff(np.searchsorted(starts, bounds)) > 0
    total, _ = K.linear_sums(points, bounds, model.weights, model.bits)
    return bounds, np.where(full, model.bias + total, -np.inf), np.searchsorted(bounds, docs)


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    """Noisy-or per text; a text without words scores 0."""
    out = np.zeros(len(texts))
    low = [t.lower() for t in texts]
    for a, z in K.chunks([len(t) for t in low]):
        _, logits, cut = _sentences(model, low[a:z])
        out[a:z] = -np.expm1(-np.maximum(0.0, K.per_segment(_softplus(logits), None, cut)))
    return out


def locate(model: Model, text: str, at_least: float = 0.5) -> list[tuple[int, int, float]]:
    """Offending sentences of a text: start, end (code points of the text) and probability.

    Lower-casing may lengthen single letters; offsets are those of the lower-cased text then.
    """
    bounds, logits, _ = _sentences(model, [text.lower()])
    p = 1 / (1 + np.exp(-np.clip(logits, -700, 700)))
    return [(max(0, int(bounds[i]) - 1), min(len(text), int(bounds[i + 1]) - 1), float(p[i])) for i in np.flatnonzero(p >= at_least)]


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, seed: int = 11) -> Model:
    """Fits on at most ``per_class`` labelled documents of each class whose crc32(doc_id) mod 3 is not 1."""
    return fit_in_task(training_sample(docs, labels, "toxic", crc_part(F.col("doc_id"), 3) != 1, per_class, seed), fit)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Adds ``score``, ``predicted`` and ``offending`` (sentences of probability 0.5 and more) to ``doc_id`` and ``held_out``.

    One row per input row. Null and blank texts score 0; repeated rows score alike; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = K.texts_of(batch)
            p = score_texts(held.value, texts)
            spans = [[{"begin": a, "until": z, "p": q} for a, z, q in locate(held.value, t)] if s >= 0.5 else [] for t, s in zip(texts, p)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32)),
                                              pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("until", pa.int32()), ("p", pa.float64())])))],
                                             ["doc_id", "held_out", "score", "predicted", "offending"])

    rows = docs.select("doc_id", (crc_part(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, offending array<struct<begin:int,until:int,p:double>>")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, unchanged."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return K.keep_rows(docs, lambda texts: score_texts(held.value, texts) < threshold)
