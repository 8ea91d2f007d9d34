"""Bounded training samples of labelled documents, and the hold-out rule by CRC-32 of the document's id."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def crc_part(doc_id: Column, parts: int) -> Column:
    """``crc32(doc_id as text) mod parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def training_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, seed: int) -> DataFrame:
    """At most ``2 * per_class`` whole labelled texts, columns ``doc_id``, ``text`` and ``y``.

    Of each class the ``per_class`` documents with the smallest hash of their id are taken. Ids are chosen from the
    labels alone, so only the chosen texts move; their number is bounded by the parameter, whatever the input.
    Labels that contradict each other count as 1 from half on; null labels and null ids take no part.
    """
    known = (labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
             .where(train).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")))
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    picked = [known.where(F.col("y") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))            # 2 * per_class rows at most
    rows = docs.select("doc_id", "text").join(ids, "doc_id").dropDuplicates(["doc_id"])
    return rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")


def fit_in_task(sample: DataFrame, fit: Callable[[list[str], np.ndarray], Any]) -> Any:
    """Fits a model on a bounded sample in one task and returns it; rows are taken in the order of their ids."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "y": []}), *frames]).sort_values("doc_id")
        yield pd.DataFrame({"model": [pickle.dumps(fit(rows["text"].tolist(), rows["y"].to_numpy(dtype=int)))]})

    made = sample.repartition(1).mapInPandas(run, "model binary").first()
    return fit([], np.zeros(0, int)) if made is None else pickle.loads(made["model"])
