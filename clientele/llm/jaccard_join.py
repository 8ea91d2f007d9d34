"""Jaccard join in the metric space of shingle sets.

Pivots make regions, and a document is copied into a further region where the triangle inequality can't rule out that a
neighbour lives there. Two kinds of pivots take turns:

* At the root, whole documents are useless as pivots: almost all are at distance 1 from almost all others, so no ball
  separates anything. The pivots there are the one-shingle sets. A document is nearest to the pivots that it holds, of which
  the first in a global order (rare ones first) gives its Voronoi region. A set at distance 1/4 or less lacks at most a quarter
  of the document's shingles, so copies in the regions of its first quarter are enough to meet every neighbour. Shingles that
  nobody else has make regions of one, which are not written.
* Inside a region documents are the pivots, the most central first. Distances to a pivot are exact. Members of one component
  need no comparison with each other, so a region ends when one component is left. Else its largest component is the inside.
  For ``INNER`` rounds the pivots, more in each round, come from the inside: in a family of near copies most outer
  members are linked with one of a few inner ones. Then they come from the outer members that are still left. An inner member
  stays for these only while its distances to all pivots lie within 1/4 of the range of theirs. Pairs that share too few of the
  shingles still to come are not compared: if they are linked, they meet in an earlier region.

Equal sets are one class from the start, so copies are never compared. Before any region is made, documents that share too few
of the shingles in a prefix (three tenths, by hash) with any other document at all are dropped: none can be their neighbour.
What is left is a small part, of which all shingles are counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from clientele.functions.staging import drop_staged, free_shuffles, stage

from . import kernels as K
from .components import components

N = 5                            # words of a shingle
MULTIPLIERS = K.mix64(np.arange(1, N + 1, dtype=np.uint64)) | np.uint64(1)
BYTES = np.arange(256, dtype=np.uint8)
SPACE = np.isin(BYTES, K.SPACES)
HEAVY_SHARE = 500                # a shingle in more than one of so many documents is heavy
HEAVY_MOST = 100_000             # heavy shingles known to every task, the most frequent ones
SALTS = 1024                     # parts that the documents of a heavy shingle are counted in
BLOOM_BITS = 25                  # size of the filter of wanted classes, as a power of two
PAIRS = 512                      # members compared with one copy of a pivot
INNER = 2                        # rounds with pivots from the inside


def linked(inter, n, m):
    return 100 * inter >= 75 * (n + m - inter)


def enough(common: Column, n: Column, m: Column) -> Column:
    """Whether sets of these sizes can be linked if they share at most ``common`` shingles."""
    return 175 * common >= 75 * (n + m)


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    for a, z in K.chunks([len(t) for t in texts], K.CHUNK // 4):
        raw = [t.encode().lower() for t in texts[a:z]]             # bytes: A-Z only
        data = np.frombuffer(b"\n" + b"\n".join(raw), np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
        starts, ends = K.words(SPACE[data])
        w = K.run_hashes(data, starts, ends)
        cut = np.searchsorted(starts, bounds)
        grams = np.zeros(max(0, len(w) - N + 1), np.uint64)
        for k in range(N):
            grams += w[k:k + len(grams)] * MULTIPLIERS[k]
        grams = K.mix64(grams)
        for i in range(z - a):
            lo, hi = cut[i], cut[i + 1]
            if hi - lo >= N:
                s = np.sort(grams[lo:hi - N + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif hi > lo:
                yield K.mix64(np.array([(w[lo:hi] * MULTIPLIERS[:hi - lo]).sum() + np.uint64(hi - lo)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def class_of(s: np.ndarray) -> int:
    """64-bit name of a set."""
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n`` and ``c`` of every row; ``heavy`` holds, once per batch, the shingles found in many of its rows."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            sets = list(shingle_sets(K.texts_of(batch)))
            h, count = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0))
            often = count >= max(4, len(sets) // HEAVY_SHARE)
            heavy = [[{"h": int(a), "k": int(b)} for a, b in zip(h[often].view(np.int64), count[often])]] + [None] * (len(sets) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()),
                                              pa.array(heavy[:len(sets)], pa.list_(pa.struct([("h", pa.int64()), ("k", pa.int64())])))], ["doc_id", "n", "c", "heavy"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, c long, heavy array<struct<h:bigint,k:bigint>>")


def _sets(docs: DataFrame, schema: str, make) -> DataFrame:
    """One call of ``make`` per batch with the names and sets of its classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            classes = {}
            for s in shingle_sets(K.texts_of(batch)):
                if len(s):
                    classes.setdefault(class_of(s), s)
            if classes:
                yield from make(classes)
    return docs.select("text").mapInArrow(run, schema)


def _prefixes(docs: DataFrame) -> DataFrame:
    """``h``, ``c``: of each class the first quarter of its shingles by hash, and a twentieth more."""
    def make(classes):
        sizes = np.array([min(len(s), len(s) - (3 * len(s) + 3) // 4 + max(1, len(s) // 20)) for s in classes.values()])
        h = np.concatenate([s[:k] for s, k in zip(classes.values(), sizes)])
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.repeat(np.fromiter(classes, np.int64, len(classes)), sizes))], ["h", "c"])

    return _sets(docs, "h long, c long", make)


def _filter(names: DataFrame, bits: int = BLOOM_BITS) -> Callable[[np.ndarray], np.ndarray]:
    """A test of names for those in the column ``c`` (and a few more: it is a Bloom filter of fixed size), for use in tasks."""
    mask = (1 << bits) - 1
    places = names.select(F.explode(F.array(F.col("c").bitwiseAND(mask), F.shiftright("c", bits).bitwiseAND(mask))).alias("at"))
    words = places.groupBy(F.shiftright("at", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("b")).toPandas()   # 2**20 rows at most
    table = np.zeros(1 << (bits - 5), np.uint64)
    table[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.uint64)
    held = names.sparkSession.sparkContext.broadcast(table)

    def test(names: np.ndarray) -> np.ndarray:
        found = np.ones(len(names), bool)
        for at in (names & mask, (names >> bits) & mask):
            found &= (held.value[at >> 5] >> (at & 31).astype(np.uint64) & np.uint64(1)).astype(bool)
        return found

    return test


def _wanted(docs: DataFrame, names: DataFrame) -> DataFrame:
    """``c`` and ``s``, the whole sets of the classes named (and of a few more)."""
    test = _filter(names)

    def make(classes):
        names = np.fromiter(classes, np.int64, len(classes))
        names = names[test(names)]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([classes[c].tobytes() for c in names.tolist()], pa.binary())], ["c", "s"])

    rows = _sets(docs, "c long, s binary", make)
    return stage(rows.groupBy("c").agg(F.first("s").alias("s")), "jaccard-sets")


def _only(sets: DataFrame, names: DataFrame) -> DataFrame:
    """The sets of the classes named (and of a few more), so that a join sends no others."""
    test = _filter(names, min(BLOOM_BITS, max(10, (16 * names.count()).bit_length())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(test(batch.column("c").to_numpy())))

    return sets.select("c", "s").mapInArrow(run, "c long, s binary")


def _heavy(docs: DataFrame, heavy: DataFrame) -> DataFrame:
    found = heavy.orderBy(F.desc("k"), "h").limit(HEAVY_MOST).toPandas()           # bounded
    return docs.sparkSession.createDataFrame(found, "h long, often long")


def _shared(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows ``c``, ``h`` whose shingle another class has too, with ``k``, in how many rows it is found."""
    rows = rows.join(F.broadcast(known), "h", "left")                              # HEAVY_MOST rows at most
    w = Window.partitionBy("h", F.when(F.col("often").isNotNull(), F.pmod(F.xxhash64("c"), F.lit(SALTS))))   # heavy ones are known to be shared
    rows = rows.select("c", "h", F.coalesce("often", F.count(F.lit(1)).over(w)).alias("k"), (F.col("often").isNotNull() | (F.min("c").over(w) != F.max("c").over(w))).alias("shared"))
    return rows.where("shared").drop("shared")


def _candidates(docs: DataFrame, classes: DataFrame, known: DataFrame) -> DataFrame:
    """Classes that share enough of their prefix with others to have a neighbour at all (copies may let a few more pass)."""
    found = _shared(_prefixes(docs), known).groupBy("c").agg(F.count(F.lit(1)).alias("f"))
    least = F.greatest(F.lit(1).cast("long"), F.floor(3 * F.col("n") / 80))
    return stage(found.join(classes, "c").where(F.col("f") >= least).select("c"), "jaccard-candidates")


def _regions(sets: DataFrame, known: DataFrame) -> DataFrame:
    """The root regions ``h`` that each candidate is copied into, with its size ``n``, the number ``r`` of its shared shingles
    from ``h`` on in the order of rarity, and how central it is (``z``: how common its shingles are).

    A candidate needs three quarters of its shingles shared. In the order of rarity, what it holds beyond these and one more
    are its regions.
    """
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            own = [np.frombuffer(s, np.int64) for s in batch.column("s").to_pylist()]
            size = [len(s) for s in own]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("c").to_numpy(), size)), pa.array(np.concatenate(own))], ["c", "h"])

    flagged = _shared(sets.mapInArrow(spread, "c long, h long"), known).groupBy("c").agg(F.sort_array(F.collect_set(F.struct("k", "h"))).alias("f"))
    n = F.floor(F.octet_length("s") / 8)
    least = F.ceil(3 * n / 4).cast("int")
    kept = flagged.join(sets.select("c", n.alias("n"), least.alias("least")), "c").where(F.size("f") >= F.col("least"))
    z = F.aggregate("f", F.lit(0.0), lambda t, x: t + F.log2(x["k"].cast("double"))) / F.col("n")
    # all that is made of a whole array is made before it is exploded, else it would be made again for every element
    kept = kept.select("c", "n", z.alias("z"), F.size("f").alias("size"), F.slice("f", F.lit(1), F.greatest(F.lit(0), F.size("f") - F.col("least") + 1)).alias("first"))
    rows = kept.select("c", "n", "z", "size", F.posexplode("first").alias("i", "x"))
    rows = stage(rows.select(F.col("x.h").alias("h"), "c", "n", (F.col("size") - F.col("i")).cast("long").alias("r"), "z"), "jaccard-regions")
    least_n = rows.groupBy("h").agg(F.min("n").alias("low"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    kept = stage(rows.join(least_n, "h").where(enough(F.col("r"), F.col("n"), F.col("low"))).drop("low"), "jaccard-regions")
    drop_staged(rows)
    return kept


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``c``, ``p``, ``inter``, ``linked`` of pairs ``c``, ``p``: the pivot's set is sent once for every ``PAIRS`` members, and no set
    that is in no pair."""
    sets = _only(sets, pairs.select("c").unionByName(pairs.select(F.col("p").alias("c"))))
    parts = pairs.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / F.lit(PAIRS)).alias("parts"))
    members = pairs.join(parts, "p").select("c", "p", F.pmod(F.xxhash64("c"), "parts").alias("part"), F.lit(1).alias("role"))
    pivots = parts.select(F.col("p").alias("c"), "p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    rows = members.unionByName(pivots).join(sets, "c").select("p", "part", "role", "c", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivot = None, np.zeros(0, np.uint64)
        for batch in K.slices(batches):
            out = []
            for p, part, role, c, s in zip(*(batch.column(k).to_pylist() for k in ("p", "part", "role", "c", "s"))):
                own = np.frombuffer(s, np.uint64)
                if role == 0:
                    now, pivot = (p, part), own
                elif now == (p, part):
                    at = np.searchsorted(pivot, own)
                    inter = int((pivot[np.minimum(at, len(pivot) - 1)] == own).sum())
                    out.append((c, p, inter, int(linked(inter, len(own), len(pivot)))))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(4)], ["c", "p", "inter", "linked"])

    return rows.repartition("p", "part").sortWithinPartitions("p", "part", "role").mapInArrow(run, "c long, p long, inter long, linked long")


def _label(labels: DataFrame | None, dist: DataFrame) -> DataFrame:
    """``node``, ``root``: what is known of components so far.

    A class without a label takes that of a pivot it is linked with. Then each label that a link joins with a smaller one becomes the
    smallest such, and what that one became. Classes with one label are connected, but for a while connected classes may have
    several labels: that costs comparisons, no links.
    """
    links, grown = dist.where("linked = 1").select("c", "p"), None
    found = links.join(dist.select(F.col("p").alias("c")).distinct(), "c", "left_anti").groupBy("c").agg(F.min("p").alias("p"))
    pivots = links.select(F.col("p").alias("node")).distinct()
    if labels is None:
        labels = found.select(F.col("c").alias("node"), F.col("p").alias("root")).unionByName(pivots.select("node", F.col("node").alias("root")))
    else:
        alone = pivots.join(labels, "node", "left_anti").select("node", F.col("node").alias("root"))
        labels = grown = stage(labels.unionByName(alone), "jaccard-labels")
        fresh = found.join(labels.select(F.col("node").alias("c")), "c", "left_anti").join(labels.withColumnRenamed("node", "p"), "p")
        labels = labels.unionByName(fresh.select(F.col("c").alias("node"), "root"))
    labels = stage(labels, "jaccard-labels")
    of = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
    ends = links.join(of("c"), "c").join(of("p"), "p").where("_c <> _p").select(F.greatest("_c", "_p").alias("root"), F.least("_c", "_p").alias("less"))
    hooks = stage(ends.groupBy("root").agg(F.min("less").alias("less")), "jaccard-hooks")
    last = hooks.join(hooks.select(F.col("root").alias("less"), F.col("less").alias("least")), "less", "left").select("root", F.coalesce("least", "less").alias("to"))
    merged = stage(labels.join(last, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "jaccard-labels")
    for done in (labels, hooks, *([grown] if grown is not None else [])):
        drop_staged(done)
    return merged


def _open(state: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The regions in which documents of several components are left, with each member's component and whether it lies outside
    (``u``) the region's main one; as long as all are alone, all lie outside."""
    if roots is None:
        return state.withColumns({"comp": F.col("c"), "u": F.lit(True)})
    state = state.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("root", "c")).drop("root")
    per = state.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(F.max(F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"))
    return state.join(per.where("comps > 1"), "h").withColumn("u", (F.col("main.k") == 1) | (F.col("comp") != F.col("main.comp"))).drop("main", "comps")


def _round(state: DataFrame, known: DataFrame | None, sets: DataFrame, pivots: int, inner: bool) -> tuple[DataFrame, DataFrame]:
    """New distances, and the members that go on: the pivots, now compared with all of other components, and what no window holds drop out.

    ``inner``: pivots come from the inside of each region that has one, else from the outer members.
    """
    slot = F.pmod(F.xxhash64("c"), F.lit(pivots))
    able = state.where("u")
    if inner:
        inside = state.where("NOT u")
        able = inside.unionByName(able.join(inside.select("h").distinct(), "h", "left_anti"))
    chosen = able.groupBy("h", slot.alias("slot")).agg(F.max(F.struct("z", "c", "n", "r", "comp")).alias("q"))
    chosen = stage(chosen.select("h", F.col("q.c").alias("p"), F.col("q.n").alias("m"), F.col("q.r").alias("s"), F.col("q.comp").alias("other")), "jaccard-pivots")
    pairs = state.join(chosen, "h").where("c <> p")
    fresh = pairs.where(enough(F.least("r", "s"), F.col("n"), F.col("m")) & (F.col("comp") != F.col("other"))).select("c", "p").distinct()
    if known is not None:
        fresh = fresh.join(known.select("c", "p"), ["c", "p"], "left_anti")
    fresh = stage(fresh, "jaccard-pairs")
    dist = stage(_distances(fresh, sets), "jaccard-distances")
    known = dist if known is None else known.unionByName(dist)
    apart = 1 - F.col("inter") / (F.col("n") + F.col("m") - F.col("inter"))
    met = pairs.join(known, ["c", "p"], "left")                    # without a distance, sizes give its bounds
    met = met.select("h", "c", "n", "r", "z", "comp", "u", "p", F.coalesce(apart, 1 - F.least("n", "m") / F.greatest("n", "m")).alias("lo"), F.coalesce(apart, F.lit(1.0)).alias("hi"))
    members = met.groupBy("h", "c", "n", "r", "z", "comp", "u").agg(F.map_from_entries(F.collect_list(F.struct("p", F.struct("lo", "hi")))).alias("d"))
    members = stage(members.join(chosen.select("h", F.col("p").alias("c")), ["h", "c"], "left_anti"), "jaccard-members")
    outer = members.where("u").select("h", F.explode("d").alias("p", "x")).groupBy("h", "p").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))
    outer = outer.groupBy("h").agg(F.collect_list(F.struct("p", "lo", "hi")).alias("st"))
    window = F.forall("st", lambda s: (~F.map_contains_key("d", s["p"])) | (F.element_at("d", s["p"])["hi"] + 0.25000001 >= s["lo"]) & (F.element_at("d", s["p"])["lo"] - 0.25000001 <= s["hi"]))
    left = stage(members.join(outer, "h").where(F.col("u") | window).select("h", "c", "n", "r", "z"), "jaccard-state")
    for done in (chosen, fresh, members):
        drop_staged(done)
    return dist, left


def linked_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (``doc_id``, ``n``, ``c``), and the component (``root``) of each class (``node``) that is linked with a smaller one."""
    rows = stage(_documents(docs), "jaccard-documents")
    classes = rows.where("n > 0").groupBy("c").agg(F.first("n").alias("n"))
    total = rows.count()
    heavy = rows.select(F.explode("heavy").alias("x")).groupBy("x.h").agg(F.sum("x.k").alias("k")).where(F.col("k") * HEAVY_SHARE >= total)
    often = _heavy(docs, heavy)
    found = _candidates(docs, classes, often)
    free_shuffles(docs.sparkSession)
    sets = _wanted(docs, found)
    free_shuffles(docs.sparkSession)
    regions = _regions(sets, often)
    known, labels, turn, state = None, None, 0, stage(_open(regions, None), "jaccard-open")
    drop_staged(regions)
    free_shuffles(docs.sparkSession)
    while not state.isEmpty():
        dist, left = _round(state, known, sets, 2 ** turn if turn <= INNER else 4 ** (turn - INNER), 0 < turn <= INNER)
        known, turn, before = dist if known is None else known.unionByName(dist), turn + 1, labels
        labels = _label(labels, dist)
        opened = stage(_open(left, labels), "jaccard-open")
        for done in (state, left, *([before] if before is not None else [])):
            drop_staged(done)
        state = opened
        free_shuffles(docs.sparkSession)
    if known is None:
        return rows, docs.sparkSession.createDataFrame([], "node long, root long")
    return rows, components(known.where("linked = 1").select(F.col("c").alias("a"), F.col("p").alias("b")))


def join(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``: one row per input row.

    Null and blank texts have no shingles and are linked with nothing; texts of one to four words are one shingle. Equal sets
    are linked. Rows with equal ids are rows of their own; a null id is never the smallest. Other columns are not read.
    Shingles and sets are told apart by 64-bit hashes.
    """
    rows, roots = linked_classes(docs)
    least = rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("rep"))
    named = least.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    named = stage(named, "jaccard-classes")
    best = named.groupBy("root").agg(F.min("rep").alias("best"))
    named = named.join(best, "root").select("c", "best")
    out = rows.where("n > 0").join(named, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("best", "doc_id").alias("component_id"))
    return out.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, but of each component only the one with the smallest id (null ids last, then the first row).

    The rows are written once with their numbers, which both the join and the result are read from: a second scan could be cut
    into other partitions and number them differently. Rows without shingles (null, empty or blank texts) all stay. An empty table
    gives an empty one; columns may have any names.
    """
    held = stage(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "jaccard-rows")
    key = F.struct(F.col("doc.doc_id").isNull().alias("z"), F.col("doc.doc_id").alias("d"), F.col("row").alias("r"))
    kept = join(held.select(key.alias("doc_id"), F.col("doc.text").alias("text"))).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.r").alias("kept"))
    return held.join(kept, F.col("row") == F.col("kept"), "left_semi").select("doc.*")


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                                     ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT w.doc_id, count(g)::BIGINT AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
e AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM e JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
c AS (WITH RECURSIVE r(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y) SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT doc_id, n AS n_shingles, m AS component_id FROM n JOIN c ON c.x = doc_id
"""
