"""Vectorised text kernels for Arrow batches: words, hashed subword features, sums per segment.

Everything works on whole texts of one batch at a time; batches are bounded by Spark's own
``spark.sql.execution.arrow.maxBytesPerBatch`` and cut further into chunks of about ``CHUNK`` characters
(one text is never cut here).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 20
SPACES = (9, 10, 11, 12, 13, 32)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def chunks(sizes: list[int], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to about ``limit``; a range holds one item at least."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > limit:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each behind a line feed of its own and with one at the end, and the n + 1 bounds of the texts."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n" * bool(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate(([0], np.cumsum(lengths)))


def is_space(points: np.ndarray) -> np.ndarray:
    return (points == 32) | ((points >= 9) & (points <= 13))


def words(space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of characters that are not spaces."""
    edge = np.diff(np.concatenate(([1], space.view(np.int8), [1])))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, kept between calls."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run ``values[start:end]``, equal for equal runs."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(values))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(values.astype(np.uint64) + np.uint64(1)) * up)))
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def per_segment(values: np.ndarray, positions: np.ndarray | None, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds; with ``positions`` (ascending), of those that lie between them."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    cut = bounds if positions is None else np.searchsorted(positions, bounds)
    return total[cut[1:]] - total[cut[:-1]]


GRAMS = (3, 4, 5)


def gram_slots(points: np.ndarray, space: np.ndarray, bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the character n-grams inside words (a word is framed by one space on either side), and where they start."""
    size = len(points) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    seen = np.concatenate(([0], np.cumsum(space, dtype=np.int32)))
    inside = seen[n - 1:n - 1 + size] == seen[1:1 + size]          # no space but at the first or last place
    at = np.flatnonzero(inside)
    framed = np.where(space, np.uint32(32), points)
    h = np.full(len(at), 2166136261 + n, np.uint32)
    for k in range(n):
        h = (h ^ framed[at + k]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))) >> np.uint32(32 - bits), at


def word_slots(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    return (run_hashes(points, starts, ends) >> np.uint64(64 - bits)).astype(np.uint32)


def repeats(points: np.ndarray) -> np.ndarray:
    """Where words start that equal the word before them."""
    starts, ends = words(is_space(points))
    hashes = run_hashes(points, starts, ends)
    return starts[1:][hashes[1:] == hashes[:-1]]


def linear_sums(points: np.ndarray, bounds: np.ndarray, weights: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Per segment: the sum of the weights of all its features (words and n-grams), and their number."""
    space = is_space(points)
    starts, ends = words(space)
    total = per_segment(weights[word_slots(points, starts, ends, bits)], starts, bounds)
    count = per_segment(np.ones(len(starts)), starts, bounds)
    for n in GRAMS:
        slots, at = gram_slots(points, space, bits, n)
        total += per_segment(weights[slots], at, bounds)
        count += np.diff(np.searchsorted(at, bounds))
    return total, count


class Bags:
    """For training: the words of a sequence of chunks as indices into their distinct words, with the slots of each distinct word.

    A word's slots are made once, in the first chunk that holds it, so memory follows the number of distinct words.
    """

    def __init__(self, bits: int) -> None:
        self.bits, self.seen = bits, np.zeros(0, np.uint64)
        self.hashes, self.names, self.slots, self.sizes = [], [], [], []

    def add(self, points: np.ndarray) -> np.ndarray:
        """Takes a chunk in and returns the starts of its words."""
        starts, ends = words(is_space(points))
        hashes = run_hashes(points, starts, ends)
        names, first = np.unique(hashes, return_index=True)
        fresh = ~np.isin(names, self.seen)
        names, first = names[fresh], first[fresh]
        picked = [points[max(0, starts[i] - 1):ends[i]] for i in first]          # with the space before it
        line = np.concatenate([*picked, [10]]).astype(np.uint32)
        bounds = np.concatenate(([0], np.cumsum([len(p) for p in picked]))).astype(np.int64)
        s, e = words(is_space(line))
        slots, where = [word_slots(line, s, e, self.bits)], [s.astype(np.int32)]
        for n in GRAMS:
            got, at = gram_slots(line, is_space(line), self.bits, n)
            slots.append(got)
            where.append(at.astype(np.int32))
        slots, where = np.concatenate(slots), np.concatenate(where)
        order = np.argsort(where, kind="stable")
        self.hashes.append(hashes)
        self.names.append(names)
        self.slots.append(slots[order])
        self.sizes.append(np.diff(np.searchsorted(where[order], bounds)))
        self.seen = np.union1d(self.seen, names)
        return starts

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of each word; slots of the distinct words and their bounds."""
        if not self.names:
            return np.zeros(0, np.int32), np.zeros(0, np.uint32), np.zeros(1, np.int64)
        names = np.concatenate(self.names)
        order = np.argsort(names).astype(np.int32)
        names = names[order]
        index = np.concatenate([order[np.searchsorted(names, h)] for h in self.hashes])
        return index, np.concatenate(self.slots), np.concatenate(([0], np.cumsum(np.concatenate(self.sizes))))


def keep_rows(docs: DataFrame, wanted: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """The rows of ``docs``, whole and unchanged, whose text ``wanted`` accepts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted(texts_of(batch)), pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
