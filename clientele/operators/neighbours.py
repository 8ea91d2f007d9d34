"""Exact nearest neighbours by boxes: cells from a bounded sample, bounding boxes from all rows.

Median splits of a sample give the cells; every row is filed in one, and each cell's bounding box and size are taken from all its
rows. A row's search begins with a radius that surely holds ``k`` others, from the sizes of the boxes that lie inside it, and
narrows it in its own cell. It then visits just the cells whose box comes nearer than that radius, so the result is exact.

Equal vectors are one row of the search. Cells are cut into blocks of bounded size, whatever their number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.order_stats import dense_codes
from ..functions.staging import stage

WHOLE = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Boxes:
    sample: int = 65_536         # rows that the cells are cut on, at most
    cells: int = 2048            # at most
    rows: int = 1024             # wanted rows of a cell, as far as the number of cells allows
    block: int = 4096            # rows of a cell in one task
    tile: int = 256              # rows that are compared at once


@dataclass
class Tree:
    """Splits by one dimension each; a negative child is a leaf, ``-1 - cell``."""
    dims: list[int] = field(default_factory=list)
    cuts: list[float] = field(default_factory=list)
    kids: list[list[int]] = field(default_factory=list)

    def file(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.dims else []
        while todo:
            node, rows = todo.pop()
            right = x[rows, self.dims[node]] > self.cuts[node]
            for side, part in ((0, rows[~right]), (1, rows[right])):
                kid = self.kids[node][side]
                if kid < 0:
                    out[part] = -1 - kid
                elif len(part):
                    todo.append((kid, part))
        return out


def grow(sample: np.ndarray, cells: int) -> Tree:
    tree, made = Tree(), 0
    todo, target = [(sample, cells, None)], max(1, cells)
    if target == 1 or len(sample) < 2:
        return tree
    while todo:
        x, n, at = todo.pop()
        spread = np.ptp(x, 0) if len(x) else np.zeros(sample.shape[1])
        if n < 2 or not len(x) or spread.max() == 0:
            kid, made = -1 - made, made + 1
        else:
            d = int(spread.argmax())
            cut = float(np.median(x[:, d]))
            if cut == x[:, d].max():
                cut = float(x[:, d][x[:, d] < cut].max())
            kid = len(tree.dims)
            tree.dims.append(d)
            tree.cuts.append(cut)
            tree.kids.append([0, 0])
            right = x[:, d] > cut
            todo += [(x[right], n // 2, (kid, 1)), (x[~right], n - n // 2, (kid, 0))]
        if at is not None:
            tree.kids[at[0]][at[1]] = kid
    return tree


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _search(dealt: DataFrame, k: int, plan: Boxes) -> DataFrame:
    """``q``, ``other``, ``d``: the ``k`` nearest rows of each block to each of its queries, inside their radius; squared distances."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ids, x = None, [], None, None
        for batch in batches:
            keys = batch.column("task").to_numpy() * 2 + batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if keys[lo] // 2 != block:
                    block, held, ids = keys[lo] // 2, [], None
                if keys[lo] % 2 == 0:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                if ids is None:
                    if not held:
                        continue
                    table = pa.Table.from_batches(held)
                    ids, x, held = table.column("id").to_numpy(), _matrix(table.column("v")), []
                for a in range(lo, hi, plan.tile):
                    cut = batch.slice(a, min(plan.tile, hi - a))
                    q, own, radius = _matrix(cut.column("v")), cut.column("id").to_numpy(), cut.column("radius").to_numpy()
                    d = np.zeros((len(q), len(x)))
                    for j in range(x.shape[1]):
                        d += np.square(q[:, j, None] - x[None, :, j])
                    d[own[:, None] == ids[None, :]] = np.inf
                    edge = radius
                    if d.shape[1] > k:
                        edge = np.minimum(edge, np.partition(d, k - 1, 1)[:, k - 1])
                    r, c = np.nonzero((d <= edge[:, None]) & (d < np.inf))
                    order = np.lexsort((ids[c], d[r, c], r))
                    r, c = r[order], c[order]
                    first = np.arange(len(r)) - np.searchsorted(r, r) < k
                    r, c = r[first], c[first]
                    yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(ids[c]), pa.array(d[r, c])], ["q", "other", "d"])

    return dealt.mapInArrow(part, "q long, other long, d double")


def nearest_rows(rows: DataFrame, k: int, plan: Boxes = Boxes(), stats: dict | None = None) -> DataFrame:
    """``q``, ``other``, ``d`` (squared distance), ``rank``: the exact ``k`` nearest others of each row of ``id`` (long) and ``v``.

    Ties go to the smaller id. Vectors must be finite and of one length. ``stats`` receives ``visits`` and ``all``, the cells that rows were taken to
    and the product of rows and cells.
    """
    spark = rows.sparkSession
    n = rows.count()
    schema = "q long, other long, d double"
    if not n:
        return spark.createDataFrame([], schema + ", rank int")
    sample = _matrix(rows.orderBy(F.xxhash64("id"), "id").limit(plan.sample).select("v").toArrow().column("v"))
    tree = grow(sample, min(plan.cells, n // plan.rows))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("cell", pa.array(tree.file(_matrix(b.column("v")))))

    filed = stage(rows.select("id", "v").mapInArrow(file, "id long, v array<double>, cell long"), "boxes")
    width = sample.shape[1]
    sides = [f(F.col("v")[i]).alias(f"{c}{i}") for i in range(width) for c, f in (("l", F.min), ("h", F.max))]
    found = filed.groupBy("cell").agg(F.count("*").alias("n"), *sides).orderBy("cell").collect()            # a row per cell
    cells, sizes = np.array([r["cell"] for r in found]), np.array([r["n"] for r in found])
    low, high = (np.array([[r[f"{c}{i}"] for i in range(width)] for r in found], float) for c in "lh")
    blocks = -(-sizes // plan.block)
    starts = np.cumsum(blocks) - blocks
    tasks = int(blocks.sum())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Own rows to one block of their cell; as queries to all blocks of it, with the radius that the boxes promise."""
        for b in batches:
            v, ids, at = _matrix(b.column("v")), b.column("id").to_numpy(), np.searchsorted(cells, b.column("cell").to_numpy())
            radius = np.empty(len(v))
            for a in range(0, len(v), plan.tile):
                x = v[a:a + plan.tile]
                far = np.square(np.maximum(np.abs(x[:, None] - low[None]), np.abs(x[:, None] - high[None]))).sum(2)
                order = np.argsort(far, 1)
                inside = np.cumsum(sizes[order], 1)
                enough = (inside > k).argmax(1)                    # a row itself is among them
                whole = inside[:, -1] > k
                radius[a:a + plan.tile] = np.where(whole, np.take_along_axis(far, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0], np.inf)
            spread = np.repeat(np.arange(len(v)), blocks[at])
            task = starts[at][spread] + np.arange(len(spread)) - np.repeat(np.cumsum(blocks[at]) - blocks[at], blocks[at])
            home = starts[at] + (ids % blocks[at])
            rows_ = np.concatenate([np.arange(len(v)), spread])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([home, task])), pa.array(np.repeat([0, 1], [len(v), len(spread)])), pa.array(ids[rows_]),
                                              b.column("v").take(pa.array(rows_)), pa.array(radius[rows_])], ["task", "kind", "id", "v", "radius"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their radius, to all blocks of other cells whose box it reaches."""
        for b in batches:
            v, ids, own, radius = _matrix(b.column("v")), b.column("id").to_numpy(), np.searchsorted(cells, b.column("cell").to_numpy()), b.column("radius").to_numpy()
            for a in range(0, len(v), plan.tile):
                x = v[a:a + plan.tile]
                near = np.square(np.maximum(0.0, np.maximum(low[None] - x[:, None], x[:, None] - high[None]))).sum(2)
                near[np.arange(len(x)), own[a:a + plan.tile]] = np.inf
                r, c = np.nonzero(near * (1 - 1e-12) <= radius[a:a + plan.tile, None])
                r, c = r[near[r, c] < np.inf], c[near[r, c] < np.inf]
                spread = np.repeat(np.arange(len(r)), blocks[c])
                task = starts[c][spread] + np.arange(len(spread)) - np.repeat(np.cumsum(blocks[c]) - blocks[c], blocks[c])
                at = a + r[spread]
                yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(np.ones(len(task), np.int64)), pa.array(ids[at]), b.column("v").take(pa.array(at)), pa.array(radius[at])],
                                                 ["task", "kind", "id", "v", "radius"])

    columns = "task long, kind long, id long, v array<double>, radius double"
    place = lambda d: d.repartitionById(min(tasks, 20_000), F.pmod("task", F.lit(min(tasks, 20_000))).cast("int")).sortWithinPartitions("task", "kind")
    top = lambda d: d.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("d", "other"))).where(F.col("rank") <= k)
    dealt = stage(filed.mapInArrow(deal, columns), "dealt")
    best = stage(top(_search(place(dealt), k, plan)), "own-cell")
    kth = best.groupBy(F.col("q").alias("id")).agg(F.count("*").alias("c"), F.max("d").alias("kth")).where(F.col("c") == k)
    first = dealt.where("kind = 1").groupBy("id").agg(F.min("radius").alias("promised"))
    asks = filed.join(first, "id").join(kth, "id", "left").select("id", "v", "cell", F.least("promised", F.coalesce("kth", F.lit(float("inf")))).alias("radius"))
    visits = stage(asks.mapInArrow(visit, columns), "visits")
    if stats is not None:
        stats.update(visits=visits.count() + dealt.where("kind = 1").count(), all=n * len(cells))
    homes = dealt.where("kind = 0")
    return top(_search(place(homes.unionByName(visits)), k, plan).unionByName(best.drop("rank")))


def near_neighbours(rows: DataFrame, key: str, columns: list[str], k: int = 15, plan: Boxes = Boxes()) -> DataFrame:
    """``key``, ``other``, ``v``, ``w``, ``d``, ``rank``: the exact ``k`` nearest other rows, ties to the smaller key; ``d`` is squared.

    Rows with equal values are one row of the search, which lists as many of their keys as can matter.
    """
    vec = F.array(*[F.col(c).cast("double") for c in columns]).alias("v")
    base = stage(rows.select(key, vec), "neighbours")
    if dict(base.dtypes)[key] in WHOLE:
        base = base.withColumn("_id", F.col(key).cast("long"))
    else:
        base = stage(base.join(dense_codes(base, key, "_id", "long"), key), "neighbours")
    classes = stage(base.groupBy("v").agg(F.min("_id").alias("rep")), "classes")
    few = base.select("v", F.col("_id").alias("other"), F.row_number().over(W.partitionBy("v").orderBy("_id")).alias("_r")).where(F.col("_r") <= k + 1)
    few = stage(few.join(classes, "v").select("rep", "other", "v"), "copies")
    near = stage(nearest_rows(classes.select(F.col("rep").alias("id"), "v"), k, plan), "near")
    listed = near.select(F.col("q").alias("rep"), F.col("other").alias("_o"), "d").join(few.select(F.col("rep").alias("_o"), "other", F.col("v").alias("w")), "_o").select("rep", "other", "w", "d")
    listed = listed.unionByName(few.select("rep", "other", F.col("v").alias("w"), F.lit(0.0).alias("d")))
    cut = listed.withColumn("_r", F.row_number().over(W.partitionBy("rep").orderBy("d", "other"))).where(F.col("_r") <= k + 1).drop("_r")
    own = base.join(classes, "v").select(key, "_id", "v", "rep")
    both = own.join(cut, "rep").where(F.col("_id") != F.col("other"))
    names = base.select(F.col("_id").alias("other"), F.col(key).alias("_key"))
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("_id").orderBy("d", "other"))).where(F.col("rank") <= k)
    return ranked.join(names, "other").select(key, F.col("_key").alias("other"), "v", "w", "d", "rank")
