"""Mixing sources to target weights.

Documents of a source stand in a permuted order and are cut into blocks of words; a source's quota is a number of blocks,
repeats included. A splitting tree deals the quotas out among the output shards: each inner node draws its left half's part
from the multivariate hypergeometric distribution, so every block goes to exactly one shard and each shard is a fair sample
of the whole. A shard's task walks from the root to its own leaf with seeds that depend on the nodes alone: no task needs
another one's result and reruns agree. Shards take disjoint runs of each source's permuted blocks and shuffle them locally.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from clientele.functions.staging import stage

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RING = 1 << 40                   # order keys


@dataclass(frozen=True)
class Plan:
    weights: tuple[int, ...] = (3, 1, 2)      # of the sources in code point order, null last, repeating
    percent: int = 150                        # of all words
    most_times: int = 2                       # a target is at most so many times its source
    block_words: int = 64                     # words of a block; more where there would be over 5e8 blocks
    shard_words: int = 1_000_000
    bucket_docs: int = 2048                   # documents of a source ordered together
    max_sources: int = 100_000                # sources known to the driver; more raise an error
    seed: int = 7


def targets(sizes: list[int], weights: list[int], total: float, most_times: int) -> list[float]:
    """Shares of ``total`` by weight; what goes above ``most_times`` the size is shared again by weight until none is above."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > most_times * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = float(most_times * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def leaf(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one shard: the first block and the number of blocks of each source, by the walk from the root."""
    first, held, lo, hi, total = np.zeros_like(quotas), quotas.copy(), 0, shards, int(quotas.sum())
    edge = lambda k: total * k // shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(held, edge(mid) - edge(lo), method="marginals")
        if shard < mid:
            held, hi = left, mid
        else:
            first, held, lo = first + left, held - left, mid
    return first, held


def first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    end = 0
    for word in islice(WORD.finditer(text), n):
        end = word.end()
    return text[:end]


def sizes(docs: DataFrame, seed: int, rid: Column | None = None) -> DataFrame:
    """``rid`` (a number of the row, its place if not given), ``doc_id``, ``source``, ``size`` in words and the row's place ``ring`` in the permuted order."""
    trimmed = F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACE_CHARS))
    rows = docs.select((F.monotonically_increasing_id() if rid is None else rid).alias("rid"), "doc_id", "source", trimmed.alias("t"))
    rows = rows.select("rid", "doc_id", "source", F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", SPACE))).cast("long").alias("size"))
    return rows.withColumn("ring", F.pmod(F.xxhash64("source", "doc_id", "size", F.lit(seed)), F.lit(RING)))


def taken(docs: DataFrame, plan: Plan = Plan(), rid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs``: a table of documents and a table of pieces.

    Documents (one row per input row): ``rid``, ``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` (words, repeats
    counted). Pieces: ``shard``, ``rid``, ``doc_id``, ``turn`` (0, 1, ... the how manieth use), ``first_word``, ``n_words``
    and ``place``, the order within the shard.

    A null source is a source of its own, the last one. Null and empty texts have size 0 and give nothing. Repeated rows are
    rows of their own. An empty table gives empty tables. Other columns are not read. A source's last block is cut to the
    word, so the words taken equal the rounded target. ``rid`` names a stored number of the row; without it, rows are numbered
    in one scan, and the numbers can't be made again.
    """
    spark = docs.sparkSession
    rows = stage(sizes(docs, plan.seed, rid), "mix-sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    known = per_source.orderBy(F.col("source").asc_nulls_last()).limit(plan.max_sources + 1).collect()   # bounded, see max_sources
    if len(known) > plan.max_sources:
        raise ValueError(f"more than {plan.max_sources} sources")
    size = [int(r["source_size"]) for r in known]
    weights = [plan.weights[i % len(plan.weights)] for i in range(len(known))]
    goal = targets(size, weights, plan.percent / 100 * sum(size), plan.most_times)
    words = [round(g) for g in goal]
    block = max(plan.block_words, math.ceil(sum(words) / 5e8))
    table = spark.createDataFrame([(r["source"], i, size[i], goal[i], (words[i] // size[i]) if size[i] else 0, (words[i] % size[i]) if size[i] else 0,
                                    max(1, math.ceil(r["n"] / plan.bucket_docs))) for i, r in enumerate(known)],
                                  "source string, idx int, source_size long, target double, turns long, rest long, buckets long")
    rows = rows.withColumnRenamed("source", "s").join(F.broadcast(table), F.col("s").eqNullSafe(F.col("source")))   # at most max_sources rows
    rows = (rows.withColumn("bucket", F.floor(F.col("ring") * F.col("buckets") / F.lit(RING)))
            .withColumn("n_blocks", F.ceil(F.col("size") / F.lit(block))))
    before = Window.partitionBy("idx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("idx", "bucket").agg(F.sum("size").alias("w"), F.sum("n_blocks").alias("b"))
    offsets = offsets.select("idx", "bucket", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b"))
    own = Window.partitionBy("idx", "bucket").orderBy("ring", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(offsets, ["idx", "bucket"])
    rows = (rows.withColumn("word", F.col("w") + F.coalesce(F.sum("size").over(own), F.lit(0)))
            .withColumn("block", F.col("b") + F.coalesce(F.sum("n_blocks").over(own), F.lit(0)))
            .withColumn("last", F.least(F.col("size"), F.greatest(F.col("rest") - F.col("word"), F.lit(0))))    # words of the turn that is not full
            .withColumn("last_blocks", F.ceil(F.col("last") / F.lit(block))))
    rows = stage(rows.select("rid", "doc_id", "size", "idx", "source_size", "target", "turns", "n_blocks", "block", "last", "last_blocks"), "mix-order")
    totals = {r["idx"]: (int(r["a"]), int(r["b"])) for r in rows.groupBy("idx").agg(F.sum("n_blocks").alias("a"), F.sum("last_blocks").alias("b")).collect()}
    all_blocks = [totals.get(i, (0, 0))[0] for i in range(len(known))]
    quotas = np.array([(words[i] // size[i] if size[i] else 0) * all_blocks[i] + totals.get(i, (0, 0))[1] for i in range(len(known))], np.int64)
    shards = max(1, math.ceil(sum(words) / plan.shard_words))
    bins = {i: max(1, math.ceil(int(q) / shards)) for i, q in enumerate(quotas)}

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                first, count = leaf(quotas, shards, int(shard), plan.seed)
                idx = np.flatnonzero(count)
                yield pd.DataFrame({"shard": int(shard), "idx": idx.astype(np.int32), "first": first[idx], "until": first[idx] + count[idx]})

    ranges = spark.range(shards).repartition(max(1, min(shards, spark.sparkContext.defaultParallelism * 4))).mapInPandas(leaves, "shard long, idx int, first long, until long")
    scale = spark.createDataFrame([(i, all_blocks[i], bins[i]) for i in range(len(known))], "idx int, all_blocks long, bin_blocks long")
    spread = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / F.col("bin_blocks")), F.floor((F.col(z) - 1) / F.col("bin_blocks"))))
    ranges = ranges.join(F.broadcast(scale.select("idx", "bin_blocks")), "idx").withColumn("bin", spread("first", "until")).drop("bin_blocks")
    turns = rows.join(F.broadcast(scale), "idx").where((F.col("turns") > 0) | (F.col("last") > 0))
    turns = turns.select("rid", "doc_id", "idx", "bin_blocks", "all_blocks", "block", F.explode(F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("turns")), lambda k: F.struct(
        k.alias("turn"), F.when(k < F.col("turns"), F.col("size")).otherwise(F.col("last")).alias("words"),
        F.when(k < F.col("turns"), F.col("n_blocks")).otherwise(F.col("last_blocks")).alias("blocks"))), lambda x: x["words"] > 0)).alias("t"))
    turns = turns.select("rid", "doc_id", "idx", "bin_blocks", "t.turn", "t.words", (F.col("t.turn") * F.col("all_blocks") + F.col("block")).alias("a"), F.col("t.blocks").alias("n"))
    turns = turns.withColumn("z", F.col("a") + F.col("n")).withColumn("bin", spread("a", "z"))
    met = turns.join(ranges, ["idx", "bin"]).where((F.col("a") < F.col("until")) & (F.col("first") < F.col("z")))
    begin, end = F.greatest("a", "first"), F.least("z", "until")
    met = met.where(F.floor(begin / F.col("bin_blocks")) == F.col("bin"))      # an overlap that spans bins counts in its first
    pieces = met.select("shard", "rid", "doc_id", "turn", ((begin - F.col("a")) * block).alias("first_word"),
                        (F.least(F.col("words"), (end - F.col("a")) * block) - (begin - F.col("a")) * block).alias("n_words"),
                        F.xxhash64(F.lit(plan.seed), "shard", "rid", "turn", begin).alias("place"))
    sums = pieces.groupBy("rid").agg(F.sum("n_words").alias("taken"))
    result = rows.select("rid", "doc_id", "size", "source_size", "target").join(sums, "rid", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    return result, pieces


def shards(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The pieces, each shard in one partition of its own and in its shuffled order."""
    pieces = taken(docs, plan)[1]
    return pieces.repartition("shard").sortWithinPartitions("shard", "place")


def mixed(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``docs`` as the mix uses them, by shard: a row per use, with the text cut behind the words that this use takes.

    What a use takes is the sum of its pieces; it stands in the shard and at the place of its first piece, and each shard is one
    partition in its shuffled order. The rows are written once with their numbers, which both the quotas and the texts are read
    from: a second scan could be cut into other partitions and number them differently.
    ``n_chars``, if there, is set to the text's length. Rows that the mix takes nothing of, so those of null or empty texts, are left
    out; a null source is a source of its own. An empty table gives an empty one; columns may have any names.
    """
    held = stage(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "mix-rows")
    rows, pieces = taken(held.select("doc.doc_id", "doc.text", "doc.source", F.col("row").alias("number")), plan, F.col("number"))
    uses = pieces.groupBy("rid", "turn").agg(F.sum("n_words").alias("words"), F.min(F.struct("first_word", "shard", "place")).alias("at"))
    uses = uses.join(rows.select("rid", "size"), "rid").select("rid", "size", "words", "at.shard", "at.place")
    uses = stage(uses, "mix-uses")
    found = held.join(uses, F.col("row") == F.col("rid")).select("doc", "size", "words", "shard", "place")
    names = list(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, doc = batch.column("words").to_numpy(zero_copy_only=False), batch.column("doc")
            texts = doc.field("text").to_pylist()
            for i in np.flatnonzero(words < batch.column("size").to_numpy(zero_copy_only=False)):
                texts[i] = first_words(texts[i], int(words[i]))
            columns = [pa.array(texts, doc.field(c).type) if c == "text" else doc.field(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    n = min(20_000, 1 + (uses.agg(F.max("shard")).first()[0] or 0))
    out = found.repartition(n, "shard").sortWithinPartitions("shard", "place").mapInArrow(cut, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out
