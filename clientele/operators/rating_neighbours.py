"""Neighbours of users on single items: for every rating wanted, the most similar of those who rated the item.

Users with wanted ratings are dealt into blocks; a block holds their known ratings and what is wanted of them. Everybody's ratings
come by in packed rows, one member after the other, as far as the block has their items. A member's sums over common items, and the
wanted ratings it can help with, are both known when it has passed, so no pair of users leaves its block. Where much would be sent,
the blocks are filled in several passes, and the files of a pass are deleted before the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.staging import drop_staged, free_shuffles, stage
from .cosine import DIGITS, Lists
from .packed import pack, unpack

NAMES = ["n", "sx", "sy", "sxy", "sxx", "syy"]


class _Block:
    """Known and wanted ratings of a block's users, and the neighbours found so far."""

    def __init__(self, known: list[dict], wanted: list[dict], k: int, centred: bool, shrinkage: float):
        of = lambda rows, c: np.concatenate([r[c] for r in rows]) if rows else np.zeros(0, np.int64 if c in "md" else float)
        self.users = np.unique(np.concatenate([of(known, "m"), of(wanted, "m")]))
        self.known = self._lists(of(known, "d"), np.searchsorted(self.users, of(known, "m")), of(known, "w"))
        target = np.argsort(of(wanted, "d"), kind="stable")
        self.user, self.item = np.searchsorted(self.users, of(wanted, "m")[target]), of(wanted, "d")[target]
        self.wanted = self._lists(self.item, np.arange(len(self.item)), None)
        self.k, self.centred, self.shrinkage = k, centred, shrinkage
        self.kept: list[np.ndarray] = []
        self.held = 0

    @staticmethod
    def _lists(d: np.ndarray, who: np.ndarray, value: np.ndarray | None) -> tuple:
        order = np.argsort(d, kind="stable")
        return (*np.unique(d[order], return_index=True, return_counts=True), who[order], None if value is None else value[order])

    @staticmethod
    def sizes(lists: tuple, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each posting's list, and its length."""
        if not len(lists[0]):
            return np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
        at = np.minimum(np.searchsorted(lists[0], d), len(lists[0]) - 1)
        return at, np.where(lists[0][at] == d, lists[2][at], 0)

    @staticmethod
    def _meet(lists: tuple, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rep = np.repeat(np.arange(len(n)), n)
        return rep, lists[1][at][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)

    def pass_by(self, m: np.ndarray, d: np.ndarray, w: np.ndarray, mean: np.ndarray) -> None:
        """Whole members, ordered."""
        others, other = np.unique(m, return_inverse=True)
        rep, mine = self._meet(self.wanted, *self.sizes(self.wanted, d))
        target, by = self.wanted[3][mine], other[rep]
        gain = (w - mean)[rep] if self.centred else w[rep]
        fine = self.users[self.user[target]] != others[by]
        target, by, gain = target[fine], by[fine], gain[fine]
        asked, back = np.unique(self.user[target] * len(others) + by, return_inverse=True)
        if not len(asked):
            return
        rep, mine = self._meet(self.known, *self.sizes(self.known, d))
        key = self.known[3][mine] * len(others) + other[rep]
        place = np.minimum(np.searchsorted(asked, key), len(asked) - 1)
        common = asked[place] == key
        place, x, y = place[common], self.known[4][mine[common]], w[rep[common]]
        n, sx, sy, sxy, sxx, syy = (np.bincount(place, v, len(asked)) for v in (np.ones(len(x)), x, y, x * y, x * x, y * y))
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.centred:
                num, den = n * sxy - sx * sy, np.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
            else:
                num, den = sxy, np.sqrt(sxx * syy)
            sim = np.where((n > 0) & (den != 0), num / den, 0.0)
            sim = np.round(sim * (n / (n + self.shrinkage)) if self.shrinkage else sim, DIGITS)
        sim = sim[back]
        good = ~(sim <= 0)                                  # no number ranks above all, as in SQL
        self.kept.append(np.rec.fromarrays([target[good], others[by[good]], sim[good], gain[good]], names="t,v,sim,gain"))
        self.held += int(good.sum())
        if self.held > 4 * self.k * len(self.item) + 100_000:
            self.prune()

    def prune(self) -> None:
        x = np.concatenate(self.kept)
        x = x[np.lexsort((x["v"], -np.where(np.isnan(x["sim"]), np.inf, x["sim"]), x["t"]))]
        x = x[np.arange(len(x)) - np.searchsorted(x["t"], x["t"]) < self.k]
        self.kept, self.held = [x], len(x)

    def rows(self) -> pa.RecordBatch:
        if self.held:
            self.prune()
        x = np.concatenate(self.kept) if self.kept else np.rec.fromarrays([np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2, names="t,v,sim,gain")
        t, first = np.unique(x["t"], return_index=True)
        of = lambda v: np.add.reduceat(v, first) if len(first) else np.zeros(0)
        return pa.RecordBatch.from_arrays([pa.array(self.users[self.user[t]], pa.int64()), pa.array(self.item[t], pa.int64()), pa.array(np.diff(np.append(first, len(x))), pa.int64()),
                                           pa.array(of(x["sim"] * x["gain"]) / of(x["sim"]))], ["u", "target", "neighbours", "e"])


def neighbour_estimates(train: DataFrame, targets: DataFrame, k: int, centred: bool, shrinkage: float, plan: Lists = Lists()) -> DataFrame:
    """``u``, ``target``, ``neighbours``, ``e``: the mean rating (or deviation) of the nearest ``k`` who rated the target, weighted by similarity.

    ``train``: ``m``, ``d`` (whole numbers), ``w``, ``mean``, a row per user and item. ``targets``: ``m``, ``d``. Ties go to the smaller user.
    Targets without any such neighbour have no row.
    """
    train = stage(train, "known")
    n, least, most = train.agg(F.count("*"), F.min("d"), F.max("d")).first()
    low, high = targets.agg(F.min("d"), F.max("d")).first()
    blocks, wide = plan.blocks(n), any(x is not None and not 0 <= x < 1 << 32 for x in (least, most, low, high))
    block = F.pmod(F.xxhash64("m"), F.lit(blocks)).cast("int").alias("block")
    wanted = targets.distinct().select("m", "d", block)
    known = train.join(targets.select("m").distinct(), "m", "left_semi").select("m", "d", "w", block)
    places = known.select("d", "block").unionByName(wanted.select("d", "block")).groupBy("d").agg(F.collect_set("block").alias("to"))     # no more than the blocks
    places = stage(places.join(train.groupBy("d").agg(F.count("*").alias("n")), "d").select("d", "to", F.ceil(F.col("n") / plan.chunk).cast("int").alias("parts"), "n"), "places")
    passes = plan.passes(places.agg(F.sum(F.col("n") * F.size("to"))).first()[0] or 0, n)
    free_shuffles(train.sparkSession)
    zero = F.lit(0.0)

    def rows(df: DataFrame, kind: int, w, mean, to) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "m", "d", F.lit(0).alias("band"), w.alias("w"), mean.alias("next"), zero.alias("low"), zero.alias("x"), to.alias("to"))

    def dealt(i: int) -> DataFrame:
        """What the blocks of a pass need."""
        here = lambda b: F.pmod(b, F.lit(passes)) == i
        asked = places.withColumn("to", F.filter("to", here)).where(F.size("to") > 0)
        pieces = asked.select("d", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "to")
        coming = train.join(asked.select("d", "parts"), "d").withColumn("part", F.pmod(F.xxhash64("m", F.lit(1)), "parts").cast("int")).join(pieces, ["d", "part"])
        all_ = rows(known.where(here(F.col("block"))), 0, F.col("w"), zero, F.array("block")).unionByName(rows(wanted.where(here(F.col("block"))), 1, zero, zero, F.array("block")))
        all_ = all_.unionByName(rows(coming, 2, F.col("w"), F.col("mean"), F.col("to")))
        return pack(all_, wide).repartitionById(min(blocks, 20_000), F.col("block")).sortWithinPartitions("block", "kind", "m")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, own, wait = None, ([], []), None, None

        def take(come: dict, all_of_it: bool) -> dict:
            """Whole members, about ``plan.products`` products at a time; gives back the last one, which may go on."""
            m, d, w, mean = (come[c] for c in ("m", "d", "w", "next"))
            stop = len(m) if all_of_it else int(np.searchsorted(m, m[-1]))
            ends = np.flatnonzero(np.diff(m[:stop], append=m[stop - 1] + 1)) + 1 if stop else []
            made = np.concatenate(([0], np.cumsum(own.sizes(own.known, d[:stop])[1] + own.sizes(own.wanted, d[:stop])[1])))
            lo = 0
            for i, end in enumerate(ends):
                if i + 1 == len(ends) or made[ends[i + 1]] - made[lo] > plan.products:
                    own.pass_by(m[lo:end], d[lo:end], w[lo:end], mean[lo:end])
                    lo = end
            return {c: v[stop:] for c, v in come.items()}

        def close() -> Iterator[pa.RecordBatch]:
            if own is not None:
                if len(wait["m"]):
                    take(wait, True)
                yield own.rows()

        for batch in batches:
            keys = batch.column("block").to_numpy().astype(np.int64) * 3 + batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if keys[lo] // 3 != block:
                    yield from close()
                    block, held, own, wait = keys[lo] // 3, ([], []), None, None
                come = unpack(batch.slice(lo, hi - lo), wide)
                if keys[lo] % 3 < 2:
                    held[keys[lo] % 3].append(come)
                    continue
                if own is None:
                    own = _Block(*held, k, centred, shrinkage)
                    held = None
                wait = take(come if wait is None else {c: np.concatenate((wait[c], come[c])) for c in come}, False)
        yield from close()

    found = None
    for i in range(passes):
        more = dealt(i).mapInArrow(part, "u long, target long, neighbours long, e double")
        if passes > 1:
            more = stage(more, "estimates")
            free_shuffles(train.sparkSession)
        found = more if found is None else found.unionByName(more)
    if passes > 1:
        drop_staged(places)
    return found
