"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is filed in one of its leaves. A query walks the tree best bin first: a
priority queue holds the nodes seen so far by the inner product of query and centre, and the best one is opened next. How many
leaves are visited is calibrated: a bounded set of queries is answered exactly, and the visits are widened until the wanted
part of the true neighbours lies in the visited leaves. Leaves and their queries meet in cells of bounded size; the first few
leaves give each query a score that what it finds in the others must reach.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from clientele.functions.staging import stage


@dataclass(frozen=True)
class Plan:
    k: int = 20
    recall: float = 0.95             # wanted on the calibration queries
    sample: int = 20_000             # vectors that the tree is fitted on, at most
    sample_numbers: int = 4_000_000  # numbers in these vectors, at most
    leaf_rows: int = 256             # wanted rows of a leaf, as far as the sample allows so many leaves
    branches: int = 16
    calibration: int = 200           # queries answered exactly, at most
    first_leaves: int = 8            # leaves that set the score which the others must reach
    block_rows: int = 2048           # rows of a leaf in one cell
    block_queries: int = 4096        # queries of a leaf in one cell
    seed: int = 3


@dataclass
class Tree:
    centres: np.ndarray = None
    children: list[list[int]] = field(default_factory=list)      # empty: a leaf

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest centre at each level."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = node
                continue
            c = self.centres[kids]
            near = np.argmin((c * c).sum(1) - 2 * x[rows] @ c.T, 1)
            todo += [(kid, rows[near == j]) for j, kid in enumerate(kids) if (near == j).any()]
        return out

    def leaves(self) -> int:
        return sum(not c for c in self.children)

    def visit(self, scores: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves in best-bin-first order, given the scores of all nodes."""
        heap, found = [(-scores[0], 0)], []
        while heap and len(found) < most:
            node = heapq.heappop(heap)[1]
            if self.children[node]:
                for kid in self.children[node]:
                    heapq.heappush(heap, (-scores[kid], kid))
            else:
                found.append(node)
        return found


def fit(x: np.ndarray, leaves: int, branches: int, seed: int) -> Tree:
    """Hierarchical k-means until a node holds about ``len(x) / leaves`` sample rows, or rows that are all alike."""
    rng, tree = np.random.default_rng(seed), Tree()
    centres, cap = [x.mean(0) if len(x) else np.zeros(1)], max(1, math.ceil(len(x) / max(1, leaves)))
    tree.children.append([])
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        k = min(branches, math.ceil(len(rows) / cap))
        if k < 2:
            continue
        own = x[rows]
        c = own[rng.choice(len(rows), k, replace=False)]
        for _ in range(8):
            near = np.argmin((c * c).sum(1) - 2 * own @ c.T, 1)
            size = np.bincount(near, minlength=k)
            sums = np.stack([np.bincount(near, own[:, j], k) for j in range(own.shape[1])], 1)
            c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        near = np.argmin((c * c).sum(1) - 2 * own @ c.T, 1)
        if (near == near[0]).all():
            continue
        for j in range(k):
            part = rows[near == j]
            if len(part):
                tree.children[node].append(len(centres))
                tree.children.append([])
                todo.append((len(centres), part))
                centres.append(c[j])
    tree.centres = np.asarray(centres)
    return tree


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id``, ``v``: vectors that take part, one per id.

    Vectors that are null, empty, zero, or hold null or non-finite numbers take no part, nor do null ids and vectors of another
    length than the most common one (the smaller of equals). Of rows with the same id the smallest vector counts.
    """
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(column, lambda x: x != 0)
    rows = vectors.where(F.col(id_column).isNotNull() & (F.size(column) > 0) & fine).select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (common[0]["d"] if common else 0))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 1))


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of query, id and score of each query's ``k`` best rows, its own left out; exact, ties to the smaller id.

    The matrix product only preselects (with slack for its rounding); scores are sums of products of the two vectors.
    """
    s = q @ x.T
    s[q_ids[:, None] == x_ids[None, :]] = -np.inf
    n = min(k, s.shape[1])
    edge = np.partition(s, s.shape[1] - n, 1)[:, s.shape[1] - n]
    edge = np.where(np.isfinite(edge), edge - 1e-9 * (1 + np.abs(edge)), edge)
    rows, cols = np.nonzero((s >= edge[:, None]) & (s > -np.inf))
    exact = np.concatenate([(q[rows[a:a + 65536]] * x[cols[a:a + 65536]]).sum(1) for a in range(0, len(rows), 65536)]) if len(rows) else np.zeros(0)
    order = np.lexsort((x_ids[cols], -exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], x_ids[cols[place < k]], exact[place < k]


def search(vectors: DataFrame, is_query: Column, plan: Plan = Plan(), id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The ``plan.k`` nearest rows found of each query: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (inner product).

    ``is_query`` is a condition on ``vec_id``; queries are rows of ``vectors``. See ``usable`` for rows that take no part.
    Equal vectors under different ids are rows of their own. With fewer candidates than ``k`` all are returned; without any,
    the result is empty. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = stage(usable(vectors, id_column, column), "ann-usable")
    n, d = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    order = F.xxhash64("vec_id", F.lit(plan.seed))
    sample = matrix(rows.orderBy(order, "vec_id").limit(min(plan.sample, max(1, plan.sample_numbers // d))).toPandas()["v"])
    tree = fit(sample, max(1, min(n // plan.leaf_rows, len(sample) // 8)), plan.branches, plan.seed)
    held = spark.sparkContext.broadcast(tree)                      # no more nodes than the sample has rows

    def file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(leaf=held.value.assign(matrix(f["v"])))

    kind = dict(rows.dtypes)["v"]
    filed = stage(rows.mapInPandas(file, f"vec_id long, v {kind}, leaf long"), "ann-filed")
    queries = filed.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    probes = queries.orderBy(F.xxhash64("query_id", F.lit(plan.seed)), "query_id").limit(plan.calibration).toPandas()
    visits = _calibrate(filed, probes, tree, plan)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), 256):
                part = f.iloc[a:a + 256]
                yield part.assign(leaves=[np.asarray(held.value.visit(s, visits), np.int64) for s in matrix(part["q"]) @ held.value.centres.T])

    # a row per query: its vector is copied to the leaves on the way to the cells, not in a task's memory
    walks = stage(queries.mapInPandas(walk, f"query_id long, q {kind}, leaves array<long>"), "ann-walks")
    walks = walks.select("query_id", "q", F.posexplode("leaves").alias("place", "leaf"))
    top = lambda d: d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= plan.k)
    first = stage(top(_meet(filed, walks.where(F.col("place") < plan.first_leaves).withColumn("least", F.lit(float("-inf"))), plan)).drop("rank"), "ann-first")
    least = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == plan.k).drop("n")
    rest = walks.where(F.col("place") >= plan.first_leaves).join(least, "query_id", "left").fillna(float("-inf"), ["least"])
    return top(_meet(filed, rest, plan).unionByName(first)).select("query_id", "rank", "vec_id", "score")


def _meet(filed: DataFrame, walks: DataFrame, plan: Plan) -> DataFrame:
    """``query_id``, ``vec_id``, ``score``: of each cell of a leaf a query's best rows that reach its ``least``."""
    cut = lambda c, most: F.ceil(F.count(F.lit(1)) / F.lit(most)).alias(c)
    cells = filed.groupBy("leaf").agg(cut("blocks", plan.block_rows)).join(walks.groupBy("leaf").agg(cut("chunks", plan.block_queries)), "leaf")
    cells = stage(cells, "ann-cells")                              # a row per leaf
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = filed.join(cells, "leaf").select("leaf", part("vec_id", "blocks").alias("block"), every("chunks").alias("chunk"), "vec_id", "v")
    right = walks.join(cells, "leaf").select("leaf", every("blocks").alias("block"), part("query_id", "chunks").alias("chunk"), "query_id", "q", "least")
    k = plan.k

    def meet(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        ids, least, vx, vi, out = q["query_id"].to_numpy(), q["least"].to_numpy(), matrix(x["v"]), x["vec_id"].to_numpy(), []
        for a in range(0, len(q), 512):
            i, near, score = best(matrix(q["q"].iloc[a:a + 512]), ids[a:a + 512], vx, vi, k)
            kept = score >= least[a:a + 512][i]
            out.append(pd.DataFrame({"query_id": ids[a:a + 512][i[kept]], "vec_id": near[kept], "score": score[kept]}))
        return pd.concat(out)

    return left.groupBy("leaf", "block", "chunk").cogroup(right.groupBy("leaf", "block", "chunk")).applyInPandas(meet, "query_id long, vec_id long, score double")


def _calibrate(filed: DataFrame, probes: pd.DataFrame, tree: Tree, plan: Plan) -> int:
    """Leaves to visit so that the probes' exact neighbours lie in them to the part ``plan.recall``."""
    leaves = tree.leaves()
    if leaves == 1 or not len(probes):
        return leaves
    q, ids, k = matrix(probes["q"]), probes["query_id"].to_numpy(), plan.k

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame({"i": [], "vec_id": [], "score": [], "leaf": []})
        for f in frames:
            for a in range(0, len(f), 4096):
                part = f.iloc[a:a + 4096]
                i, near, score = best(q, ids, matrix(part["v"]), part["vec_id"].to_numpy(), k)
                leaf = part.set_index("vec_id")["leaf"].reindex(near).to_numpy()
                kept = pd.concat([kept, pd.DataFrame({"i": i, "vec_id": near, "score": score, "leaf": leaf})])
                kept = kept.sort_values(["i", "score", "vec_id"], ascending=[True, False, True]).groupby("i").head(k)
        yield kept.astype({"i": "int64", "vec_id": "int64", "leaf": "int64"})

    found = filed.mapInPandas(exact, "i long, vec_id long, score double, leaf long")
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "vec_id"))
    true = found.withColumn("r", rank).where(F.col("r") <= k).select("i", "leaf").toPandas()       # k rows per probe
    places = {}
    for i, s in enumerate(q @ tree.centres.T):
        places |= {(i, leaf): at for at, leaf in enumerate(tree.visit(s, leaves), 1)}
    needed = np.sort([places[x] for x in true.itertuples(index=False, name=None)])
    return int(needed[min(len(needed) - 1, math.ceil(plan.recall * len(needed)) - 1)]) if len(needed) else leaves
