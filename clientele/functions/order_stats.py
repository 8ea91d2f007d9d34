"""Exact quantiles, ranks and running totals without a single-task global sort.

Quantiles: a monotone bucket number is derived from each value. Bucket sizes are pre-aggregated, prefix sums run over the
buckets (some ten thousand rows, whatever the data size), and only the rows inside a bucket are ordered. Ranks and running
totals: rows are dealt out by ranges of value and key. Results do not depend on where the bounds fall.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .core import col, first_match, one_row
from .staging import stage

_SCALE = 1000.0
_STEPS = 1024.0


def bucket_of(value) -> Column:
    """Monotone bucket of a number: log-spaced, 0.1 % wide, at most ~740,000 per sign over all doubles and
    some 20,000 for values up to ten million."""
    v = col(value).cast("double")
    return (F.signum(v) * F.floor(F.log1p(F.abs(v) * _SCALE) * _STEPS)).cast("int")


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group; NULL values are ignored.

    Equal values are counted before the first shuffle, so hot groups shrink at once, and the
    ordering step sees only the buckets which hold a wanted rank.
    """
    counts = (df.where(col(value).isNotNull())
                .groupBy(*keys, col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
                .withColumn("_b", bucket_of("_v")))
    sizes = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    upto = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    pos = {n: F.lit(float(p)) * (F.col("_total") - 1) for n, p in probs.items()}
    probes = F.array(*[F.struct(F.lit(n).alias("q"), pos[n].alias("pos"), F.lit(side).alias("side"),
                                rounded(pos[n]).cast("long").alias("r"))
                       for n in probs for side, rounded in (("lo", F.floor), ("hi", F.ceil))])
    holders = (sizes.withColumn("_before", F.sum("_bn").over(upto) - F.col("_bn"))
                    .withColumn("_total", F.sum("_bn").over(whole))
                    .withColumn("_want", F.filter(probes, lambda w: (w["r"] >= F.col("_before"))
                                                  & (w["r"] < F.col("_before") + F.col("_bn"))))
                    .where(F.size("_want") > 0)
                    .select(*keys, "_b", "_before", "_want"))
    inside = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    placed = _join_null_safe(counts, holders, [*keys, "_b"]).withColumn("_upto", F.sum("_n").over(inside) + F.col("_before"))
    hits = (placed.withColumn("_w", F.explode("_want"))
                  .where((F.col("_w.r") < F.col("_upto")) & (F.col("_w.r") >= F.col("_upto") - F.col("_n")))
                  .select(*keys, "_v", F.col("_w.q").alias("_q"), F.col("_w.side").alias("_side"), F.col("_w.pos").alias("_pos")))

    def interpolated(name: str) -> Column:
        mine = F.col("_q") == name
        lo = F.max(F.when(mine & (F.col("_side") == "lo"), F.col("_v")))
        hi = F.max(F.when(mine & (F.col("_side") == "hi"), F.col("_v")))
        pos = F.max(F.when(mine, F.col("_pos")))
        return (lo + (hi - lo) * (pos - F.floor(pos))).alias(name)

    return hits.groupBy(*keys).agg(*[interpolated(n) for n in probs])


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join on columns with the same names; NULL keys match each other."""
    renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"_r_{k}"), keys, right)
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond).drop(*[f"_r_{k}" for k in keys])


def quantiles(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """One row of exact whole-table quantiles."""
    return grouped_quantiles(df, [], value, probs)


def column_quantiles(df: DataFrame, columns: list[str], probs: dict[str, float]) -> DataFrame:
    """One row with ``<column>_<name>`` for several columns, computed in one job."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "_name", "_x")
    per = grouped_quantiles(long, ["_name"], "_x", probs)
    return per.agg(*[F.max(F.when(F.col("_name") == c, F.col(n))).alias(f"{c}_{n}") for c in columns for n in probs])


def qcut_many(df: DataFrame, bins: dict[str, tuple[str, list]]) -> DataFrame:
    """Quantile bins on raw values for several columns, ``{column: (output, labels)}`` with equally long labels:
    right-closed, lowest value included, duplicate edges dropped (a value goes to the first bin whose upper
    edge it does not exceed)."""
    q = len(next(iter(bins.values()))[1])
    edges = one_row(column_quantiles(df, list(bins), {f"e{i}": i / q for i in range(1, q)}))
    tmp = df.withColumn("_edges", edges)
    for c, (out, labels) in bins.items():
        rules = [(F.col(c) <= F.col(f"_edges.{c}_e{i}"), labels[i - 1]) for i in range(1, q)]
        tmp = tmp.withColumn(out, F.when(F.col(c).isNotNull(), first_match(rules, labels[q - 1])))
    return tmp.drop("_edges")


def qcut_values(df: DataFrame, value: str, q: int, out: str, labels: list | None = None) -> DataFrame:
    return qcut_many(df, {value: (out, labels or list(range(1, q + 1)))})


def _numbered(df: DataFrame, value: str, key: str, descending: bool, totals: list[str]) -> DataFrame:
    """Adds ``_rank`` (1-based, ties by key) and, per name in ``totals``, running sums ``_cum_<name>``.

    Rows are dealt out by ranges of ``(value, key)`` whose bounds Spark samples, so a hot value is split along its keys and the
    cells follow the number of rows. They are written before use, since the bounds differ from run to run; prefix sums run over the
    cells' totals, and rows are ordered only inside their cell.
    """
    by_value = F.col(value).desc() if descending else F.col(value).asc()
    held = stage(df.repartitionByRange(by_value, F.col(key).asc()).withColumn("_cell", F.spark_partition_id()), "ranked")
    before = W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)           # a row per cell
    sizes = held.groupBy("_cell").agg(F.count("*").alias("_n"), *[F.sum(t).alias(f"_s_{t}") for t in totals])
    names = ["_n", *[f"_s_{t}" for t in totals]]
    starts = sizes.select("_cell", *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_off{m}") for m in names])
    cell = W.partitionBy("_cell").orderBy(by_value, F.col(key).asc())
    upto = cell.rowsBetween(W.unboundedPreceding, 0)
    ranked = held.withColumn("_rn", F.row_number().over(cell))
    for t in totals:
        ranked = ranked.withColumn(f"_run_{t}", F.sum(t).over(upto))
    cums = [(F.col(f"_run_{t}") + F.col(f"_off_s_{t}")).alias(f"_cum_{t}") for t in totals]
    return ranked.join(starts, "_cell").select(*df.columns, (F.col("_rn") + F.col("_off_n")).cast("long").alias("_rank"), *cums)


def global_rank(df: DataFrame, value: str, key: str, out: str = "rank", descending: bool = False) -> DataFrame:
    """Exact 1-based rank of every row; ties broken by ascending ``key``; rows with a NULL value drop out."""
    return _numbered(df.where(col(value).isNotNull()), value, key, descending, []).withColumnRenamed("_rank", out)


def running_share(df: DataFrame, value: str, key: str) -> DataFrame:
    """Rows by falling value with ``rank``, ``running`` total (exact decimal sum of cents)."""
    money = df.withColumn("_money", F.col(value).cast("decimal(28,4)"))
    return (_numbered(money, value, key, True, ["_money"])
            .withColumnRenamed("_rank", "rank")
            .withColumn("running", F.col("_cum__money").cast("double")).drop("_cum__money", "_money"))


def rank_bin(rank: Column, n: Column, q: int) -> Column:
    """Closed form of quantile bins over ranks 1..n: bin 1..q."""
    cells = F.greatest(F.lit(1), F.ceil((rank - 1) * F.lit(q) / F.when(n > 1, n - 1)))
    return F.coalesce(cells, F.lit(1)).cast("int")


def qcut_rank(df: DataFrame, value: str, key: str, q: int, out: str, descending: bool = False) -> DataFrame:
    """Quantile bins 1..q on first-come ranks, so every bin is evenly filled even with heavy ties."""
    n = one_row(df.where(col(value).isNotNull()).agg(F.count("*").alias("n"))).getField("n")
    ranked = global_rank(df, value, key, "_rk", descending)
    return ranked.withColumn(out, rank_bin(F.col("_rk"), n, q)).drop("_rk")


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """Per distinct value: count ``n`` and the average-tie rank ``avg_rank`` over the whole table."""
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("n")).withColumn("_b", bucket_of("_v"))
    sizes = counts.groupBy("_b").agg(F.sum("n").alias("_bn"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_b", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy("_b").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    return (counts.withColumn("_pre", F.coalesce(F.sum("n").over(inside), F.lit(0)))
                  .join(starts, "_b")
                  .select(F.col("_v").alias(value), "n",
                          (F.col("_pre") + F.col("_off") + (F.col("n") + 1) / 2).alias("avg_rank")))


def lag_within(df: DataFrame, key: str, ts: str, tie: str, out: str) -> DataFrame:
    """Previous ``ts`` of the same key, by a carry over cells.

    Rows are dealt out by ranges of ``(key, ts, tie)`` whose bounds Spark samples, so a key's history is cut into as many cells as it
    needs. They are written before use, since the bounds differ from run to run. Inside a cell the previous row is at hand; a cell's
    first row takes the last row of the cell before it, from a table with a row per cell.
    """
    held = stage(df.repartitionByRange(F.col(key).asc(), F.col(ts).asc(), F.col(tie).asc()).withColumn("_cell", F.spark_partition_id()), "lagged")
    mine = F.struct(F.col(key).alias("k"), F.col(ts).alias("t"), F.col(tie).alias("i"))
    carried = held.groupBy("_cell").agg(F.max(mine).alias("_last")).select("_cell", F.lag("_last").over(W.orderBy("_cell")).alias("_carry"))
    inside = W.partitionBy("_cell").orderBy(key, ts, tie)
    rows = held.withColumn("_before", F.lag(mine).over(inside)).join(carried, "_cell")
    before = F.coalesce("_before", "_carry")
    return rows.select(*df.columns, F.when(before["k"].eqNullSafe(F.col(key)), before["t"]).alias(out))


def dense_codes(df: DataFrame, key: str, out: str, kind: str = "int") -> DataFrame:
    """0-based codes in key order for a dimension's distinct keys."""
    distinct = df.select(key).distinct()
    parts = distinct.repartitionByRange(key).sortWithinPartitions(key).withColumn("_m", F.monotonically_increasing_id())
    # written before use: the numbering depends on the sampled range bounds
    held = stage(parts.select(key, F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("_i")), "codes")
    counts = held.groupBy("_p").agg(F.count("*").alias("_n"))   # one row per partition
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_p", before.alias("_s"))
    return held.join(starts, "_p").select(key, (F.col("_i") + F.col("_s")).cast(kind).alias(out))
