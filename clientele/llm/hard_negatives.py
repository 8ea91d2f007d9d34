"""Hard negatives by exact inner products in a residue number system.

Vectors of whole numbers are reduced modulo several small primes. Each product of residue matrices runs in float32 and is
exact, because no partial sum leaves 24 bits; Chinese remaindering by balanced mixed-radix digits turns the residues into the
signed score. The first pass finds each anchor's best rows of its own label, the second one the best rows of other labels
inside a window around each of these.

Anchors come in blocks of bounded size, rows in ``strips``; a cell is a block and a strip. Tasks stream the rows of a cell past
its anchors and keep a bounded list per anchor and window, so what leaves a cell grows with the anchors alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from clientele.functions.staging import stage

DIMS = 1024                          # dimensions per float32 product
LOWEST = np.iinfo(np.int64).min
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class Plan:
    positives: int = 5
    negatives: int = 10
    low: int = 30                    # window in hundredths of the positive's score
    high: int = 90
    scale: int = 256
    anchor_block: int = 16_384       # anchors of a cell, about; the rows are copied once per block
    strips: int = 16                 # cells of a block
    tile: int = 1024                 # anchors and rows that are multiplied at once


def primes_for(bound: int, d: int) -> list[int]:
    """The largest primes whose residue products stay exact in float32, as many as scores of up to ``bound`` need."""
    p = 2 * int((2 ** 24 // max(1, min(d, DIMS))) ** 0.5) + 1
    found, product = [], 1
    while product <= 2 * bound + 1:
        if p < 3:
            raise ValueError("too many dimensions")
        if p % 2 and all(p % q for q in range(3, int(p ** 0.5) + 1, 2)):
            found.append(p)
            product *= p
        p -= 1
    return found


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Balanced residues, between -p/2 and p/2, as float32."""
    out = []
    for p in primes:
        r = x % p
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def products(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact signed inner products of all rows of ``a`` and ``b``, given as residues."""
    value, radix = None, 1
    for x, y, p in zip(a, b, primes):
        r = 0
        for at in range(0, x.shape[1], DIMS):
            r = (r + (x[:, at:at + DIMS] @ y[:, at:at + DIMS].T).astype(np.int32)) % p
        if value is None:
            value = np.where(r > p // 2, r - p, r).astype(np.int64)
        else:
            digit = (r - value % p) * pow(radix, -1, p) % p
            value = value + np.where(digit > p // 2, digit - p, digit) * radix
        radix *= p
    return value


class Best:
    """The ``k`` best (score, then smaller id) of each group so far."""

    def __init__(self, groups: int, k: int):
        self.k, self.least = k, np.full(groups, LOWEST)
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        g, s, i = np.concatenate([self.group, group]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((i, -s, g))
        g, s, i = g[order], s[order], i[order]
        place = np.arange(len(g)) - np.searchsorted(g, g)
        last = place == self.k - 1
        self.least[g[last]] = s[last]
        kept = place < self.k
        self.group, self.score, self.id = g[kept], s[kept], i[kept]


def pick(scores: np.ndarray, allowed: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of allowed scores that may be among a row's ``k`` best; ties stay in."""
    allowed = allowed & (scores >= least[:, None])
    if scores.shape[1] > k and allowed.sum() > 4 * k * len(scores):
        held = np.where(allowed, scores, LOWEST)
        allowed &= scores >= np.partition(held, scores.shape[1] - k, 1)[:, scores.shape[1] - k, None]
    return np.nonzero(allowed)


def _numbers(column: pa.ListArray, scale: int) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(column), -1)


def usable(vectors: DataFrame, plan: Plan, id_column: str, label: Column | str, column: str) -> tuple[DataFrame, int, int]:
    """``vec_id``, ``label``, ``v`` of the rows that take part, one per id; their length and a bound of all scores."""
    fine = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(column) > 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(column).alias("v"), fine.alias("fine"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.col("fine"))
    rows = stage(rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v"), "negatives-rows")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = common[0]["d"] if common else 0
    rows = rows.where(F.size("v") == d)
    norm = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + F.pow(F.floor(c.cast("double") * plan.scale).cast("double"), 2)))).first()[0] or 0.0
    if norm >= 2.0 ** 61:
        raise ValueError("a vector's inner product with itself does not fit a long")
    return rows, d, int(norm * (1 + 1e-9)) + 1


def _scan(anchors: DataFrame, rows: DataFrame, bound: int, d: int, plan: Plan, windowed: bool) -> DataFrame:
    """``anchor_id``, ``slot``, ``id``, ``score``: of each cell an anchor's best rows, per window or of its own label."""
    spark, primes = rows.sparkSession, primes_for(bound, d)
    blocks = max(1, -(-anchors.count() // plan.anchor_block))
    cells = blocks * plan.strips
    strips, none = F.lit(plan.strips), F.lit(None).cast("array<long>")
    block, strip = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), F.pmod(F.xxhash64("vec_id", F.lit(1)), strips)
    left = anchors.select(F.explode(F.sequence(block * strips, block * strips + strips - 1)).alias("cell"), F.lit(0).alias("kind"), "vec_id", "label", "v",
                          F.col("wanted") if windowed else none.alias("wanted"))
    right = rows.select(F.explode(F.sequence(strip, strip + strips * (blocks - 1), strips.cast("long"))).alias("cell"), F.lit(1).alias("kind"), "vec_id", "label", "v", none.alias("wanted"))
    # the anchors of a cell come first, its rows in the order of their ids
    dealt = left.unionByName(right).repartition(cells, "cell").sortWithinPartitions("cell", "kind", "vec_id")
    slots, k = (plan.positives, plan.negatives) if windowed else (1, plan.positives)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, own = None, [], None

        def found() -> Iterator[pa.RecordBatch]:
            if own is not None:
                best = own["best"]
                yield pa.RecordBatch.from_arrays([pa.array(own["ids"][best.group // slots]), pa.array((best.group % slots).astype(np.int32)), pa.array(best.id), pa.array(best.score)],
                                                 ["anchor_id", "slot", "id", "score"])

        def begin(parts: list[pa.RecordBatch]) -> dict:
            table = pa.Table.from_batches(parts).combine_chunks()
            ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
            low, high = np.zeros((len(ids), slots), np.int64), np.full((len(ids), slots), -1)
            if windowed:
                for i, w in enumerate(table.column("wanted").to_pylist()):
                    p = np.array(w, np.int64)
                    low[i, :len(p)], high[i, :len(p)] = -(-plan.low * p // 100), plan.high * p // 100
            return {"ids": ids, "labels": labels, "low": low, "high": high, "best": Best(len(ids) * slots, k),
                    "v": residues(_numbers(table.column("v").combine_chunks(), plan.scale), primes)}

        def meet(rows: pa.RecordBatch) -> None:
            ids, labels, best = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), own["best"]
            v = residues(_numbers(rows.column("v"), plan.scale), primes)
            for a in range(0, len(own["ids"]), plan.tile):
                s = products([x[a:a + plan.tile] for x in own["v"]], v, primes)
                mine, same = np.arange(a, a + len(s)), own["labels"][a:a + plan.tile, None] == labels[None, :]
                for slot in range(slots):
                    if windowed:
                        ok = ~same & (s >= own["low"][mine, slot, None]) & (s <= own["high"][mine, slot, None])
                    else:
                        ok = same & (own["ids"][mine, None] != ids[None, :])
                    i, j = pick(s, ok, best.least[mine * slots + slot], k)
                    best.add((a + i) * slots + slot, s[i, j], ids[j])

        for batch in batches:
            keys = batch.column("cell").to_numpy() * 2 + batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if keys[lo] // 2 != cell:
                    yield from found()
                    cell, held, own = keys[lo] // 2, [], None
                if keys[lo] % 2 == 0:
                    held.append(batch.slice(lo, hi - lo))
                elif held or own is not None:
                    if own is None:
                        own, held = begin(held), []
                    for at in range(lo, hi, plan.tile):
                        meet(batch.slice(at, min(plan.tile, hi - at)))
        yield from found()

    return dealt.mapInArrow(scan, "anchor_id long, slot int, id long, score long")


def mine(vectors: DataFrame, is_anchor: Column, plan: Plan = Plan(), id_column: str = "vec_id", label: Column | str = "label", column: str = "embedding") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    Components become ``floor(scale * x)``. ``is_anchor`` is a condition on ``vec_id``. An anchor's positives are its
    ``plan.positives`` best other rows of its label; the negatives of a positive are the ``plan.negatives`` best rows of
    another label whose hundredfold score lies between ``plan.low`` and ``plan.high`` times the positive's. Ties go to the smaller id.

    Rows with a null id, label or vector, an empty vector or one with null or non-finite numbers take no part, nor do vectors of
    another length than the most common one (the smaller of equals). Of rows with the same id the smallest label and vector
    count. Equal vectors under different ids are rows of their own. An anchor without positives, and a positive without
    negatives, has no rows. An empty table gives an empty result; inner products beyond 61 bits raise. Other columns are not read.
    """
    rows, d, bound = usable(vectors, plan, id_column, label, column)
    if not d:
        return vectors.sparkSession.createDataFrame([], OUT)
    anchors = rows.where(is_anchor)
    rank = lambda *g: F.row_number().over(Window.partitionBy(*g).orderBy(F.desc("score"), "id"))
    first = _scan(anchors, rows, bound, d, plan, False).withColumn("place", rank("anchor_id")).where(F.col("place") <= plan.positives)
    first = stage(first.select("anchor_id", (F.col("place") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    listed = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda p: p["positive_score"]).alias("wanted"))
    found = _scan(anchors.join(listed, "vec_id"), rows, bound, d, plan, True)
    found = found.withColumn("rank", rank("anchor_id", "slot")).where(F.col("rank") <= plan.negatives)
    return found.join(first, ["anchor_id", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                                                          "positive_score", F.col("score").alias("negative_score"))


ORACLE = """WITH t AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM t a JOIN t b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT a, b AS p, score AS ps, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.a, p, ps, b, score, row_number() OVER (PARTITION BY p.a, p ORDER BY score DESC, b) AS rank FROM p JOIN s ON p.a = s.a AND NOT same AND 30 * ps <= 100 * score AND 100 * score <= 90 * ps)
SELECT a AS anchor_id, p AS positive_id, CAST(rank AS INTEGER) AS rank, b AS negative_id, ps AS positive_score, score AS negative_score FROM n WHERE rank <= 10"""
