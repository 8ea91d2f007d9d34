"""Small reusable table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.core import one_row, ratio
from ..functions.order_stats import grouped_quantiles, quantiles, running_share


def fill_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs replaced by the column's exact median."""
    out = df
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(c), one_row(quantiles(df, c, {"m": 0.5})).getField("m")))
    return out


def winsor_filter(df: DataFrame, arm: str, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows strictly inside the arm's quantiles."""
    edges = grouped_quantiles(df, [arm], value, {"_lo": low, "_hi": high})
    return (df.join(edges, arm).where((F.col(value) > F.col("_lo")) & (F.col(value) < F.col("_hi")))
              .drop("_lo", "_hi"))


def top_groups(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most frequent keys (ties: smallest key)."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def semi_join_topk(df: DataFrame, key: str, k: int) -> DataFrame:
    return df.join(top_groups(df, key, k), key, "left_semi")


def topk_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per group; Spark limits each group before the shuffle as well as after it."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def last_n_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the ``n`` latest groups of a small, already grouped table."""
    keep = df.select(key).distinct().orderBy(F.desc(key)).limit(n)
    return df.join(keep, key, "left_semi")


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between minimum and maximum; the maximum falls into the last bin."""
    span = one_row(df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    lo, hi = span.getField("lo"), span.getField("hi")
    at = F.least(F.lit(bins - 1), F.floor(F.try_divide((F.col(value) - lo) * bins, hi - lo)))
    return (df.where(F.col(value).isNotNull()).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin"))
              .agg(F.count("*").alias("n")))


def pct_change(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Growth in percent against the previous row of a small time-ordered table (one row per period)."""
    previous = F.lag(value).over(W.orderBy(order))
    return df.withColumn(out, ratio(F.col(value) - previous, previous) * 100)


def pareto_curve(df: DataFrame, value: str, key: str) -> DataFrame:
    """Rows by falling value with their share of rows and of the running total."""
    totals = one_row(df.agg(F.sum(F.col(value).cast("decimal(28,4)")).cast("double").alias("total"), F.count("*").alias("n")))
    ranked = running_share(df.select(key, value), value, key)
    return ranked.withColumns({"cumulative_pct": ratio("running", totals.getField("total")),
                               "customer_pct": ratio("rank", totals.getField("n"))})


def every_nth_point(ranked: DataFrame, n_points: int = 100) -> DataFrame:
    """Evenly spaced points of a ranked curve, first and last included."""
    n = one_row(ranked.agg(F.count("*").alias("n"))).getField("n")
    spots = ranked.sparkSession.range(n_points).select(
        (F.floor(F.col("id") * (n - 1) / F.lit(n_points - 1)) + 1).cast("long").alias("rank")).distinct()
    return ranked.join(F.broadcast(spots), "rank")   # at most n_points rows


def top_share(df: DataFrame, value: str, key: str, share: float = 0.2) -> DataFrame:
    """Count, mean and sum of the top share of rows, and their part of the total."""
    totals = one_row(df.agg(F.sum(value).alias("total"), F.count("*").alias("n")))
    ranked = running_share(df.select(key, value), value, key)
    top = ranked.where(F.col("rank") <= F.floor(totals.getField("n") * F.lit(share)))
    return top.agg(F.count("*").alias("customers"), F.avg(value).alias("mean_value"), F.sum(value).alias("sum_value"),
                   ratio(F.sum(value), F.max(totals.getField("total"))).alias("share_of_total"))
