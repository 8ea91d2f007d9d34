"""Vectors of members on their way to blocks: a few wide rows instead of a row per posting."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def packed_type(wide: bool) -> np.dtype:
    return np.dtype([("d", "<i8" if wide else "<u4"), ("w", "<f8"), ("band", "u1")])


@dataclass(frozen=True)
class Dealt:
    blocks: int
    wide: bool                       # dimensions need more than 32 bits
    postings: int = field(default=0, compare=False)


def pack(rows: DataFrame, wide: bool) -> DataFrame:
    """``rows`` by member, as a row per block of ``to`` (and batch), whose ``data`` holds the member's postings for it."""
    kind = packed_type(wide)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = batch.column("to")
            sizes = np.diff(to.offsets.to_numpy())
            at = np.repeat(np.arange(batch.num_rows), sizes)
            if not len(at):
                continue
            block = to.flatten().to_numpy()
            m, which, d, band, w, after, low, x = (batch.column(c).to_numpy()[at] for c in ("m", "kind", "d", "band", "w", "next", "low", "x"))
            order = np.lexsort((m, block, which))
            block, m, which, after, low, x = (c[order] for c in (block, m, which, after, low, x))
            first = np.flatnonzero(np.concatenate(([True], (np.diff(block) != 0) | (np.diff(m) != 0) | (np.diff(which) != 0))))
            data = np.empty(len(order), kind)
            data["d"], data["w"], data["band"] = d[order], w[order], band[order]
            ends = np.append(first, len(order)).astype(np.int32) * kind.itemsize
            values = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(block[first].astype(np.int32)), pa.array(which[first].astype(np.int32)), pa.array(m[first]), pa.array(np.minimum.reduceat(after, first)),
                                              pa.array(np.minimum.reduceat(low, first)), pa.array(x[first]), values], ["block", "kind", "m", "next", "low", "x", "data"])

    near = rows.repartition("m").sortWithinPartitions("kind", "m")
    return near.mapInArrow(part, "block int, kind int, m long, next double, low double, x double, data binary")


def unpack(batch: pa.RecordBatch, wide: bool) -> dict[str, np.ndarray]:
    """The postings of packed rows, with the columns of their rows."""
    kind, column = packed_type(wide), batch.column("data")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(kind)
    sizes = np.diff(ends) // kind.itemsize
    return {c: np.repeat(batch.column(c).to_numpy(), sizes) for c in ("m", "next", "low", "x")} | {"d": data["d"].astype(np.int64), "w": data["w"].copy(), "band": data["band"].astype(np.int64)}
