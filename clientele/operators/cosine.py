"""Cosine similarity joins by norm-prefix inverted lists.

The dimensions get one global order: bands of list length, short lists first. ``rest(t)`` is the norm of a member's unit vector
from band ``t`` on. Two members whose first common list lies in band ``t`` reach at most ``rest_a(t) * rest_b(t)`` together, so a
posting matters to another member only while that product reaches the wanted similarity. Where a member is cut off at band ``t``,
the same product bounds what its sums lack; a sum that could pass with it is completed in the end.

Members are dealt into blocks of bounded size. A directory says which blocks hold a list; postings go to the blocks of their list,
long lists in chunks, and each block sums its pairs while the members stream by. No list is joined with itself, and no pair is
shuffled but those that may be in the result. What a member sends to a block is packed into rows of some 13 bytes a posting, and
a join of all pairs takes a member to half of the blocks only, as the other half comes to its own. Where much would be sent, members
come by in several passes, and the files of a pass are deleted before the next: disk holds what the blocks have and one pass.

The search for the nearest ``k`` runs over short lists first. That gives every member a k-th similarity that long lists have to
beat; only members with long lists go on, against what their bound still reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.order_stats import dense_codes
from ..functions.staging import drop_staged, free_shuffles, stage
from .packed import Dealt, pack, unpack

SLACK = 1e-9
DIGITS = 10                          # similarities are rounded before they are compared
BANDS = 64
WHOLE = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Lists:
    postings: int = 262_144          # postings of a block, about; a member is never divided
    chunk: int = 4096                # members of a list that are dealt out together
    short: int = 1024                # lists of the first round of a search have at most about so many members
    products: int = 2_000_000        # products that a block sums at once, about
    many: int = 36                   # from so many blocks on, blocks grow instead, as every further one gets its copies of postings
    largest: int = 6_000_000         # postings of a grown block, about
    sent: int = 40_000_000           # postings that are sent to blocks in one pass, about, or
    share: float = 3.0               # so many times all postings, if that is more

    def passes(self, sent: float, n: int) -> int:
        return max(1, int(np.ceil(sent / max(self.sent, self.share * n))))

    def blocks(self, n: int) -> int:
        least = max(1, -(-n // self.postings))
        return least if least <= self.many else max(self.many, -(-n // self.largest))


def _postings(ratings: DataFrame, member: str, dimension: str, value: str, plan: Lists) -> tuple[DataFrame, DataFrame, int]:
    """``block``, ``m``, ``d``, ``band``, ``parts``, ``w``, ``rest``, ``next``, ``low``; the codes ``m`` of the members, in their order; blocks."""
    rows = ratings.select(member, F.col(dimension).alias("_d"), F.col(value).cast("double").alias("_v")).where((F.col("_v") != 0) & F.col(dimension).isNotNull())
    codes = rows.groupBy(member).agg(F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_norm"))
    if dict(rows.dtypes)[member] in WHOLE:                         # ids that are whole numbers are their own codes
        codes = codes.withColumn("m", F.col(member).cast("long"))
    else:
        codes = stage(dense_codes(rows, member, "m", "long").join(codes, member), "members")
    lists = rows.groupBy("_d").agg(F.count("*").alias("_n")).select(
        "_d", F.floor(F.log2("_n")).cast("int").alias("band"), F.ceil(F.col("_n") / plan.chunk).cast("int").alias("parts"))
    if dict(rows.dtypes)["_d"] in WHOLE:
        lists = lists.withColumn("d", F.col("_d").cast("long"))
    else:
        lists = stage(lists.withColumn("d", F.monotonically_increasing_id()), "lists")
    base = rows.join(codes, member).join(lists, "_d").select("m", "d", "band", "parts", (F.col("_v") / F.col("_norm")).alias("w"))
    base = stage(base, "weights")
    sums = base.groupBy("m", "band").agg(F.sum(F.col("w") * F.col("w")).alias("s"))
    later = W.partitionBy("m").orderBy(F.desc("band"))                                  # a row per band of a member
    norms = sums.select("m", "band", F.sqrt(F.sum("s").over(later.rowsBetween(W.unboundedPreceding, 0))).alias("rest"),
                        F.sqrt(F.coalesce(F.sum("s").over(later.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).alias("next"))
    norms = norms.withColumn("low", F.min("rest").over(W.partitionBy("m")))
    n, least, most = base.agg(F.count("*"), F.min("d"), F.max("d")).first()
    blocks, wide = plan.blocks(n), n > 0 and (least < 0 or most >= 1 << 32)
    block = F.pmod(F.xxhash64("m"), F.lit(blocks)).cast("int").alias("block")
    postings = stage(base.join(norms, ["m", "band"]).select(block, "m", "d", "band", "parts", "w", "rest", "next", "low"), "postings")
    drop_staged(base)
    free_shuffles(base.sparkSession)
    return postings, codes.select(member, "m"), Dealt(blocks, wide, n)


def _deal(own: DataFrame, postings: DataFrame, reach: Column, least: Column, dealt: Dealt, half: bool = False) -> DataFrame:
    """The blocks' own postings, each followed by the postings of others that may matter to it, packed.

    ``reach``: what a member of ``own`` asks of another's ``rest`` in a band, as a column on ``own``; the larger, the more it takes.
    ``half``: of two different blocks only one gets the other's postings.
    """
    reaching = _reaching(own, reach)
    return _to_blocks(_own(own, reaching, least, dealt), _coming(postings, _directory(own, reaching), dealt, half), dealt)


def _reaching(own: DataFrame, reach: Column) -> DataFrame:
    """``block``, ``band``, ``reach``: the most that a block asks in a band; it never rises with the band."""
    per = own.groupBy("block", "band").agg(F.max(reach).alias("r"))
    return per.select("block", "band", F.max("r").over(W.partitionBy("block").orderBy(F.desc("band"))).alias("reach"))


def _directory(own: DataFrame, reaching: DataFrame) -> DataFrame:
    """``d``, ``band``, ``parts``, ``held``: the blocks that hold a list, no more than there are."""
    held = own.select("block", "d", "band", "parts").distinct().join(F.broadcast(reaching), ["block", "band"])
    return held.groupBy("d", "band", "parts").agg(F.collect_list(F.struct("block", "reach")).alias("held"))


def _own(own: DataFrame, reaching: DataFrame, least: Column, dealt: Dealt) -> DataFrame:
    rows = own.join(F.broadcast(reaching), ["block", "band"]).select(F.lit(0).alias("kind"), "m", "d", "band", "w", "next", F.col("reach").alias("low"), least.alias("x"), F.array("block").alias("to"))
    return pack(rows, dealt.wide)


def _coming(postings: DataFrame, directory: DataFrame, dealt: Dealt, half: bool) -> DataFrame:
    directory = directory.select("d", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "held")
    coming = postings.select("block", "m", "d", "band", "w", "rest", "next", "low", F.pmod(F.xxhash64("m", F.lit(1)), "parts").cast("int").alias("part"))

    def wanted(x: Column) -> Column:
        reached = F.col("rest") * x["reach"] >= 1 - SLACK
        apart = F.pmod(x["block"] - F.col("block"), F.lit(dealt.blocks)) * 2
        return reached & ((apart < dealt.blocks) | ((apart == dealt.blocks) & (x["block"] < F.col("block")))) if half else reached

    to = F.transform(F.filter("held", wanted), lambda x: x["block"]).alias("to")
    met = coming.join(directory, ["d", "part"]).select(F.lit(1).alias("kind"), "m", "d", "band", "w", "next", "low", F.lit(0.0).alias("x"), to)
    return pack(met.where(F.size("to") > 0), dealt.wide)


def _to_blocks(own: DataFrame, coming: DataFrame, dealt: Dealt) -> DataFrame:
    return own.unionByName(coming).repartitionById(min(dealt.blocks, 20_000), F.col("block")).sortWithinPartitions("block", "kind", "m")


class _Block:
    """A block's own vectors by list, and what it knows of the pairs of its members."""

    def __init__(self, rows: list[dict[str, np.ndarray]], k: int | None, last: int | None):
        m, d, band, w, after, reach, least = (np.concatenate([r[c] for r in rows]) for c in ("m", "d", "band", "w", "next", "low", "x"))
        self.members, at, local = np.unique(m, return_index=True, return_inverse=True)
        self.least, self.k, self.last, self.reach = least[at], k, last, reach.min()
        squares = np.zeros((len(self.members), BANDS + 1))
        np.add.at(squares, (local, band), w * w)
        if last is not None:                                                             # bands that are not dealt out
            squares[local, BANDS] = np.square(after)
        self.rest = np.sqrt(np.cumsum(squares[:, ::-1], 1)[:, ::-1])
        order = np.argsort(d, kind="stable")
        self.lists, self.starts, self.sizes = np.unique(d[order], return_index=True, return_counts=True)
        self.local, self.weights = local[order], w[order]
        self.kept: list[np.ndarray] = []
        self.held = 0

    def products(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each posting's list, and how many products it makes."""
        at = np.minimum(np.searchsorted(self.lists, d), len(self.lists) - 1)
        return at, np.where(self.lists[at] == d, self.sizes[at], 0)

    def meet(self, m: np.ndarray, at: np.ndarray, n: np.ndarray, w: np.ndarray, band: np.ndarray, after: np.ndarray, low: np.ndarray) -> None:
        """Vectors of others, as far as they were sent."""
        others, first, other = np.unique(m, return_index=True, return_inverse=True)
        left = np.minimum.reduceat(after, first)
        if self.last is None:        # what was not sent lies behind the last band sent, if its least norm fails anywhere
            off = np.where(low[first] * self.reach < 1 - SLACK, np.maximum.reduceat(band, first) + 1, -1)
        else:
            off = np.where(left > 0, self.last + 1, -1)
        rep = np.repeat(np.arange(len(m)), n)
        mine = self.starts[at][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        key = self.local[mine] * len(others) + other[rep]
        order = np.argsort(key, kind="stable")
        key, value = key[order], (w[rep] * self.weights[mine])[order]
        cut = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0)))
        key, s = key[cut], np.add.reduceat(value, cut)
        a, b = key // len(others), key % len(others)
        open_ = np.where(off[b] < 0, 0.0, self.rest[a, off[b]] * left[b])
        low, high = np.round(s - open_, DIGITS), np.round(s + open_, DIGITS)
        if self.k is None:           # pairs of two blocks come once, those of one block from both sides
            same = np.isin(others, self.members, assume_unique=True)
            fine = ~same[b] | (self.members[a] < others[b])
        else:
            fine = self.members[a] != others[b]
        fine &= (high > 0) & (high >= np.round(self.least[a] - SLACK, DIGITS))
        self.kept.append(np.rec.fromarrays([a[fine], others[b][fine], s[fine], low[fine], high[fine], off[b][fine]], names="a,b,s,low,high,cut"))
        self.held += int(fine.sum())
        if self.k is not None and self.held > 8 * self.k * len(self.members) + 100_000:
            self.prune()

    def prune(self) -> None:
        """Drop what cannot be among the k best any more; each member's k-th lower bound becomes its least."""
        x = np.concatenate(self.kept)
        x = x[np.lexsort((x["b"], -x["low"], x["a"]))]
        place = np.arange(len(x)) - np.searchsorted(x["a"], x["a"])
        last = place == self.k - 1
        kth = np.full(len(self.members), -np.inf)
        kth[x["a"][last]] = x["low"][last]
        self.least = np.maximum(self.least, kth)
        closed = x["low"] == x["high"]
        keep = (place < self.k) | (x["high"] > kth[x["a"]]) | ~closed & (x["high"] >= kth[x["a"]])
        self.kept, self.held = [x[keep]], int(keep.sum())

    def rows(self) -> pa.RecordBatch:
        if self.k is not None and self.held:
            self.prune()
        x = np.concatenate(self.kept) if self.kept else np.rec.fromarrays([np.zeros(0)] * 6, names="a,b,s,low,high,cut")
        a, b = self.members[x["a"].astype(np.int64)], x["b"].astype(np.int64)
        if self.k is None:
            a, b = np.minimum(a, b), np.maximum(a, b)
        cut = pa.array(x["cut"].astype(np.int32), mask=x["low"] == x["high"])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b), pa.array(x["s"].astype(float)), pa.array(x["low"].astype(float)), cut], ["a", "b", "s", "low", "cut"])


def _sum(dealt: DataFrame, k: int | None, plan: Lists, wide: bool, last: int | None = None) -> DataFrame:
    """``a``, ``b``, ``s``, ``low``, ``cut`` of pairs that may pass: the sum so far and its lower bound; ``cut`` is null where it is complete, else the first band that it lacks.

    ``last``: where given, bands behind it were not dealt out, and ``next`` is the norm of all behind it; all others were dealt out whole.
    """
    names = ["m", "d", "w", "band", "next", "low"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, own, wait = None, [], None, None

        def take(rows: list[np.ndarray], all_of_it: bool) -> list[np.ndarray] | None:
            """Meets all whole members of ``rows`` and gives back the last one, which may go on in the next batch."""
            m = rows[0]
            stop = len(m) if all_of_it else int(np.searchsorted(m, m[-1]))
            at, n = own.products(rows[1])
            ends = np.flatnonzero(np.diff(m[:stop], append=m[stop - 1] + 1 if stop else 0)) + 1      # behind each member
            made, lo, total = np.concatenate(([0], np.cumsum(n))), 0, 0
            for i, end in enumerate(ends):
                nxt = ends[i + 1] if i + 1 < len(ends) else None
                if nxt is None or made[nxt] - made[lo] > plan.products:
                    if made[end] > made[lo]:
                        own.meet(m[lo:end], at[lo:end], n[lo:end], *(r[lo:end] for r in rows[2:]))
                    lo = end
            return None if all_of_it else [r[stop:] for r in rows]

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal wait
            if own is not None:
                if wait is not None and len(wait[0]):
                    take(wait, True)
                wait = None
                yield own.rows()

        for batch in batches:
            keys = batch.column("block").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if keys[lo] // 2 != block:
                    yield from close()
                    block, held, own, wait = keys[lo] // 2, [], None, None
                if keys[lo] % 2 == 0:
                    held.append(unpack(batch.slice(lo, hi - lo), wide))
                    continue
                if own is None:
                    own, held = _Block(held, k, last), []
                come = unpack(batch.slice(lo, hi - lo), wide)
                rows = [come[c] for c in names]
                wait = take(rows if wait is None else [np.concatenate(x) for x in zip(wait, rows)], False)
        yield from close()

    return dealt.mapInArrow(part, "a long, b long, s double, low double, cut int")


def _summed(own: DataFrame, postings: DataFrame, reach: Column, least: Column, dealt: Dealt, k: int | None, plan: Lists, label: str, half: bool = False, last: int | None = None) -> DataFrame:
    """What ``_sum`` finds in the blocks of ``own``, written.

    In a pass a part of the members comes by, whole members each, and all blocks are there again. A search keeps the best of all
    passes so far.
    """
    spark, reaching = own.sparkSession, _reaching(own, reach)
    directory = stage(_directory(own, reaching), "directory")
    sent = directory.agg(F.sum(F.pow(F.lit(2.0), F.col("band")) * 1.5 * F.size("held"))).first()[0] or 0.0     # a list of band t has 1.5 * 2^t postings, about
    n = plan.passes(sent / 2 if half else sent, dealt.postings)
    mine = _own(own, reaching, least, dealt)
    mine = stage(mine, "own") if n > 1 else mine
    free_shuffles(spark)
    found = None
    for i in range(n):
        some = postings.where(F.pmod(F.xxhash64("m", F.lit(2)), F.lit(n)) == i) if n > 1 else postings
        more = stage(_sum(_to_blocks(mine, _coming(some, directory, dealt, half), dealt), k, plan, dealt.wide, last), label)
        free_shuffles(spark)
        if found is None or k is None:
            found = more if found is None else found.unionByName(more)
            continue
        before, found = found, stage(_best(found.unionByName(more), k), label)
        drop_staged(before)
        drop_staged(more)
        free_shuffles(spark)
    drop_staged(directory)
    if n > 1:
        drop_staged(mine)
    return found


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each ``a`` by their lower bounds, and the unfinished sums that may still be among them."""
    order = W.partitionBy("a").orderBy(F.desc("low"), "b")
    ranked = found.withColumns({"_k": F.row_number().over(order), "_kth": F.nth_value("low", k).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    high = 2 * F.col("s") - F.col("low") + 2.0 * 10 ** -DIGITS                            # both bounds are as far from the sum, but for their rounding
    return ranked.where((F.col("_k") <= k) | (F.col("cut").isNotNull() & (high >= F.col("_kth")))).select(*found.columns)


def _complete(found: DataFrame, postings: DataFrame, stats: dict | None) -> DataFrame:
    """``a``, ``b``, ``similarity`` of all pairs found; sums that stopped short get what the later bands add."""
    short = found.where(F.col("cut").isNotNull())
    n = short.count()
    if stats is not None:
        stats["verified"] = stats.get("verified", 0) + n
    whole = found.where(F.col("cut").isNull()).select("a", "b", F.col("s").alias("similarity"))
    if not n:
        return whole
    own = postings.select(F.col("m").alias("a"), "d", F.col("band").alias("t"), F.col("w").alias("wa"))
    theirs = postings.select(F.col("m").alias("b"), "d", F.col("w").alias("wb"))
    more = short.join(own, "a").where(F.col("t") >= F.col("cut")).join(theirs, ["b", "d"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("more"))
    return whole.unionByName(short.join(more, ["a", "b"], "left").select("a", "b", (F.col("s") + F.coalesce("more", F.lit(0.0))).alias("similarity")))


def _names(pairs: DataFrame, codes: DataFrame, member: str) -> DataFrame:
    kind = dict(codes.dtypes)[member]
    if kind in WHOLE:
        return pairs.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "similarity")
    of = lambda c: codes.select(F.col("m").alias(c), F.col(member).alias(f"_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "similarity")


def cosine_pairs(ratings: DataFrame, member: str, dimension: str, value: str = "rating", min_similarity: float = 0.0,
                 plan: Lists = Lists(), stats: dict | None = None) -> DataFrame:
    """Cosine similarity of members over their dimensions, pairs a < b of at least ``min_similarity`` and more than zero.

    ``ratings`` has one row per member and dimension. ``stats`` receives ``verified``, the pairs whose sum had to be completed.
    """
    postings, codes, dealt = _postings(ratings, member, dimension, value, plan)
    low = max(min_similarity, 0.0)
    reach = F.col("rest") / F.lit(low) if low else F.lit(1e300)
    found = _summed(postings, postings, reach, F.lit(low), dealt, None, plan, "pairs", half=True)
    done = _complete(found, postings, stats).where((F.round("similarity", DIGITS) >= F.lit(round(low, DIGITS))) & (F.round("similarity", DIGITS) > 0))
    return _names(done, codes, member)


def _nearest(ratings: DataFrame, member: str, dimension: str, k: int, value: str, plan: Lists, stats: dict | None) -> DataFrame:
    """``a``, ``b``, ``similarity``: pairs that hold the ``k`` nearest of every ``a``."""
    postings, codes, dealt = _postings(ratings, member, dimension, value, plan)
    band = int(np.log2(max(1, plan.short)))
    short, long_ = F.col("band") <= band, F.col("band") > band
    going_on = stage(postings.where(long_).groupBy("m").agg(F.max("rest").alias("beyond")), "open")
    rare = postings.where(short).join(going_on, "m", "left").withColumn("next", F.coalesce("beyond", F.lit(0.0)))
    first = _summed(rare, rare, F.lit(1e300), F.lit(0.0), dealt, k, plan, "first", last=band)
    going_on = going_on.select("m")
    done = first.join(going_on.withColumnRenamed("m", "a"), "a", "left_anti").select("a", "b", F.round("s", DIGITS).alias("similarity"))
    n = going_on.count()
    if stats is not None:
        stats["open"] = n
    if n:
        top = F.row_number().over(W.partitionBy("a").orderBy(F.desc("low")))
        kth = first.withColumn("_k", top).where(F.col("_k") == k).select(F.col("a").alias("m"), F.col("low").alias("_least"))
        asked = postings.join(going_on, "m").join(kth, "m", "left").withColumn("_least", F.greatest(F.coalesce("_least", F.lit(0.0)), F.lit(0.0)))
        asked = stage(asked, "asked")
        reach = F.when(F.col("_least") > 0, F.col("rest") / F.col("_least")).otherwise(1e300)
        found = _summed(asked, postings, reach, F.col("_least"), dealt, k, plan, "second")
        done = done.unionByName(_complete(found, postings, stats))
    return _names(done.withColumn("similarity", F.round("similarity", DIGITS)).where("similarity > 0"), codes, member)


def nearest_members(ratings: DataFrame, member: str, dimension: str, k: int, value: str = "rating", plan: Lists = Lists(), stats: dict | None = None) -> DataFrame:
    """The exact ``k`` most similar others per member, ``(member, other, similarity, rank)``; ties: smallest id.

    Members with the same direction are collapsed to one representative first, so copies cost nothing: they are each other's
    nearest, and a neighbour class stands for its smallest ids.
    """
    norms = ratings.groupBy(member).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_norm"))
    unit = ratings.join(norms, member).where(F.col("_norm") > 0).select(member, dimension, F.round(F.col(value) / F.col("_norm"), 12).alias("w"))
    code = lambda salt: F.sum(F.xxhash64(F.col(dimension), F.col("w"), F.lit(salt)).cast("decimal(38,0)"))
    signed = unit.groupBy(member).agg(F.count("*").alias("_n"), code(1).alias("_s1"), code(2).alias("_s2"))
    key = ["_n", "_s1", "_s2"]
    belongs = stage(signed.join(signed.groupBy(*key).agg(F.min(member).alias("_rep")), key).select(member, "_rep"), "classes")
    reps = stage(unit.join(belongs.where(F.col(member) == F.col("_rep")), member).select(member, dimension, "w"), "reps")
    scored = _nearest(reps, member, dimension, k, "w", plan, stats)
    near = _first(scored.select(F.col("a").alias("_rep"), F.col("b").alias("_other"), "similarity"), ["_rep"], [F.desc("similarity"), F.asc("_other")], k)
    ids = stage(_first(belongs.select("_rep", F.col(member).alias("other")), ["_rep"], [F.asc("other")], k + 1), "ids")
    expanded = near.join(ids.withColumnRenamed("_rep", "_other"), "_other").select("_rep", "other", "similarity")
    copies = ids.select("_rep", "other", F.lit(1.0).alias("similarity"))
    listed = _first(expanded.unionByName(copies), ["_rep"], [F.desc("similarity"), F.asc("other")], k + 1)
    mine = belongs.join(listed, "_rep").where(F.col(member) != F.col("other")).select(F.col(member).alias("member"), "other", "similarity")
    ranked = mine.withColumn("rank", F.row_number().over(W.partitionBy("member").orderBy(F.desc("similarity"), F.asc("other"))))
    return ranked.where(F.col("rank") <= k)


def _first(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_k") <= k).drop("_k")
