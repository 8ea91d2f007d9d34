"""Whitening of embeddings by a polarisation covariance in whole numbers.

Components are scaled to whole numbers ``x`` and centred without rounding as ``z = n * x - S`` (``n`` vectors, sums ``S``).
Only squares are aggregated: the sum of ``z_i ** 2`` for every dimension and of ``(z_i + z_j) ** 2`` for every pair of
dimensions. The cross-covariances are differences of these variances, ``2 z_i z_j = (z_i + z_j)^2 - z_i^2 - z_j^2``. All sums
are exact, so they depend neither on the order nor on the partitions of the rows; the covariance is rounded once and goes to
``eigh``. The driver holds numbers per pair of dimensions, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clientele.functions.staging import stage

LIMB = 21                            # bits of a limb: 2 ** 16 products of two limbs add up inside a long
ROWS = 4096                          # rows that are squared at once
SAFE = 1 << 62
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass
class Model:
    n: int
    sums: list[int]                  # per dimension, over the fit list
    wide: bool                       # whether centred values exceed a long
    values: np.ndarray               # eigenvalues, falling; one that is nil to double precision is 0
    vectors: np.ndarray              # unit eigenvectors as columns
    trace: float
    identity_error: float | None = None


def _limbs(z: np.ndarray) -> list[np.ndarray]:
    most, out = int(np.abs(z).max(initial=0)), []
    while most >> LIMB:
        out.append(z & ((1 << LIMB) - 1))
        z, most = z >> LIMB, most >> LIMB
    return [*out, z]


def square_sums(z: np.ndarray, axis: int) -> np.ndarray:
    """Exact sums of squares along an axis of at most 2 ** 16 whole numbers, as Python integers."""
    if z.dtype == object:
        return (z * z).sum(axis)
    parts, how = _limbs(z), "ij,ij->j" if axis == 0 else "ij,ij->i"
    total = np.zeros(z.shape[1 - axis], object)
    for a, x in enumerate(parts):
        for b in range(a, len(parts)):
            total += np.einsum(how, x, parts[b]).astype(object) * ((1 + (b > a)) << LIMB * (a + b))
    return total


def pair_squares(z: np.ndarray) -> np.ndarray:
    """Sums of squares of each dimension, followed by those of the sums of each pair i < j in row order."""
    d = z.shape[1]
    return np.concatenate([square_sums(z, 0), *(square_sums(z[:, i + 1:] + z[:, i:i + 1], 0) for i in range(d - 1))])


def _vectors(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _totals(rows: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Exact sums over all rows of what ``of`` gives for a batch, each added up as limbs of 32 bits in longs."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                total = total + of(_vectors(batch.slice(a, ROWS), d))
        cells = []
        for cell, v in enumerate(total if isinstance(total, np.ndarray) else ()):
            v, place = int(v), 0
            while v not in (0, -1):
                cells.append((cell, place, v & 0xFFFFFFFF))
                v, place = v >> 32, place + 1
            if v:
                cells.append((cell, place, v))
        c, p, v = zip(*cells) if cells else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(p, pa.int32()), pa.array(v, pa.int64())], ["cell", "place", "v"])

    found: dict[int, int] = {}
    # a few rows per pair of dimensions
    for r in rows.mapInArrow(part, "cell int, place int, v long").groupBy("cell", "place").agg(F.sum("v").alias("v")).collect():
        found[r["cell"]] = found.get(r["cell"], 0) + (r["v"] << 32 * r["place"])
    return [found.get(i, 0) for i in range(max(found, default=-1) + 1)]


def centred(x: np.ndarray, model: Model) -> np.ndarray:
    sums = np.array(model.sums, object if model.wide else np.int64)
    return (x.astype(object) if model.wide else x) * model.n - sums


def project(z: np.ndarray, model: Model, k: int) -> np.ndarray:
    """Whitened values of the first ``k`` components; NaN where the component has no variance."""
    centre = np.array([[v / model.n for v in row] for row in z], float).reshape(z.shape) if model.wide else z / model.n
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model.values[:k] > 0, centre @ model.vectors[:, :k] / np.sqrt(model.values[:k]), np.nan)


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = 256) -> tuple[DataFrame, int]:
    """``vec_id``, ``x`` of the vectors that take part, and their length."""
    fine = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(column, lambda c: F.floor(c.cast("double") * scale))
    rows = vectors.where(F.col(column).isNotNull() & fine).select(F.col(id_column).cast("long").alias("vec_id"), whole.alias("x"))
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = common[0]["d"] if common else 0
    return rows.where(F.size("x") == d), d


def fit(rows: DataFrame, d: int, components: int = 4) -> Model | None:
    """Means, eigenvalues and eigenvectors over each distinct vector ``x`` once; None without vectors.

    A vector that makes up much of the table is one row per task before anything is shuffled.
    """
    listed = stage(rows.select("x").distinct(), "whitening-list")
    n = listed.count()
    if not n or not d:
        return None
    sums = _totals(listed, d, lambda x: x.astype(object).sum(0) if np.abs(x.astype(float)).max(initial=0) >= 2.0 ** 46 else x.sum(0).astype(object))
    sums += [0] * (d - len(sums))
    low, high = listed.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    model = Model(n, sums, 4 * n * max(abs(low), abs(high), 1) >= SAFE, np.zeros(d), np.eye(d), 0.0)
    squares = _totals(listed, d, lambda x: pair_squares(centred(x, model)))
    squares += [0] * (d * (d + 1) // 2 - len(squares))
    v, at = np.zeros((d, d)), d
    for i in range(d):
        v[i, i] = squares[i] / n ** 3
        for j in range(i + 1, d):
            v[i, j] = v[j, i] = (squares[at] - squares[i] - squares[j]) / (2 * n ** 3)
            at += 1
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    peak = np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0)
    model.vectors = vectors * np.where(peak < 0, -1.0, 1.0)        # the largest entry is positive
    model.values = np.where(values > d * np.finfo(float).eps * max(values[0], 0.0), values, 0.0)
    model.trace = sum(squares[:d]) / n ** 3
    model.identity_error = _identity_error(listed, d, model, components)
    return model


def _identity_error(listed: DataFrame, d: int, model: Model, components: int) -> float | None:
    """Largest entry of the whitened values' own covariance minus the identity, over the fit list; components without variance left out."""
    k = int((model.values[:components] > 0).sum())
    if not k:
        return None

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                w = project(centred(_vectors(batch.slice(a, ROWS), d), model), model, k)
                total += np.concatenate([w.T @ w, w.sum(0)[None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "v"])

    sums = np.zeros((k + 1) * k)
    for r in listed.mapInArrow(part, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        sums[r["cell"]] = r["v"]
    sums = sums.reshape(k + 1, k) / model.n
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())


def apply(rows: DataFrame, d: int, model: Model, components: int = 4) -> DataFrame:
    """A row per vector and component, see ``whiten``."""
    k = min(components, d)
    share = model.values[:k] / model.trace if model.trace else np.full(k, np.nan)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                cut = batch.slice(a, ROWS)
                z, m = centred(_vectors(cut, d), model), cut.num_rows
                far = [v if v < 10 ** 38 else None for v in square_sums(z, 1)]
                columns = [cut.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                           pa.array(np.full(m * k, model.n)), pa.array(far, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), k))),
                           pa.array(project(z, model, k).ravel(), from_pandas=True), pa.array(np.tile(share, m), from_pandas=True),
                           pa.array([model.identity_error] * (m * k), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT.replace("38,0", "").split(", ")])

    return rows.mapInArrow(part, OUT)


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """``vec_id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    A vector that is null, or holds null or non-finite numbers, takes no part; nor does one of another length than the most
    common one (the smaller of equals). Repeated rows and null ids stay rows of their own, each distinct vector counts once in
    the fit. Where a component has no variance ``whitened`` is null; where no component has any, so are ``explained`` and
    ``identity_error``. ``deviation`` is null beyond 38 digits. Numbers beyond a long count as its ends. Without usable vectors
    the result is empty. Other columns are not read.
    """
    rows, d = usable(vectors, id_column, column, scale)
    model = fit(rows, d, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    return apply(rows, d, model, components)
