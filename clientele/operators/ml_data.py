"""Model data: splits, folds, scaling, weights, oversampling and generated features."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import finite_or_zero, flag, one_row, ratio
from ..functions.order_stats import column_quantiles, global_rank, grouped_quantiles
from ..functions.sampling import unit_hash
from ..functions.staging import stage
from .neighbours import near_neighbours

# Features of the churn models (nothing that contains the recency itself).
CHURN_FEATURES = ["total_orders", "total_revenue", "avg_order_value", "order_value_std", "customer_lifetime_days",
                  "orders_per_month", "value_consistency", "avg_freight_value", "customer_value_score",
                  "avg_revenue_per_quarter", "total_items", "avg_days_between_orders"]


def sanitized(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite_or_zero(F.col(c).cast("double")) for c in columns})


# --- splits -----------------------------------------------------------------------------------

def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Column ``is_test``: the rows of each label below that label's exact quantile of a key hash."""
    drawn = df.withColumn("_u", unit_hash(F.col(key), seed))
    edge = grouped_quantiles(drawn, [label], "_u", {"_edge": test_share})
    return drawn.join(edge, label).withColumn("is_test", flag(F.col("_u") < F.col("_edge"))).drop("_u", "_edge")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 7) -> DataFrame:
    """Column ``fold`` in 0..folds-1 with equal shares of every label."""
    drawn = df.withColumn("_u", unit_hash(F.col(key), seed))
    edges = grouped_quantiles(drawn, [label], "_u", {f"_e{i}": i / folds for i in range(1, folds)})
    fold = sum((flag(F.col("_u") >= F.col(f"_e{i}")) for i in range(1, folds)), F.lit(0))
    return drawn.join(edges, label).withColumn("fold", fold).drop("_u", *[f"_e{i}" for i in range(1, folds)])


# --- scaling and weights --------------------------------------------------------------------------

def scale_standard(df: DataFrame, columns: list[str], fit_on: DataFrame) -> DataFrame:
    """z-scores with mean and population spread of ``fit_on``; constant columns are only centred."""
    stats = fit_on.agg(*[e for c in columns for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    tmp = df.withColumn("_st", one_row(stats))
    z = lambda c: (F.col(c) - F.col(f"_st.m_{c}")) / F.when(F.col(f"_st.s_{c}") == 0, 1.0).otherwise(F.col(f"_st.s_{c}"))
    return tmp.withColumns({c: z(c) for c in columns}).drop("_st")


def scale_robust(df: DataFrame, columns: list[str], fit_on: DataFrame) -> DataFrame:
    """(x - median) / interquartile range with the exact quantiles of ``fit_on``, all columns in one job."""
    q = column_quantiles(fit_on, columns, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    stats = q.select(*[e for c in columns for e in (F.col(f"{c}_q2").alias(f"m_{c}"), (F.col(f"{c}_q3") - F.col(f"{c}_q1")).alias(f"s_{c}"))])
    tmp = df.withColumn("_st", one_row(stats))
    z = lambda c: (F.col(c) - F.col(f"_st.m_{c}")) / F.when(F.col(f"_st.s_{c}") == 0, 1.0).otherwise(F.col(f"_st.s_{c}"))
    return tmp.withColumns({c: z(c) for c in columns}).drop("_st")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per label, and the weight of positives against negatives."""
    counts = df.groupBy(label).agg(F.count("*").alias("rows"))
    whole = one_row(df.agg(F.count("*").alias("n"), F.countDistinct(label).alias("k"), F.sum(label).alias("pos")))
    n, k, pos = (whole.getField(x) for x in ("n", "k", "pos"))
    return counts.withColumns({"weight": ratio(n, k * F.col("rows")), "scale_pos_weight": ratio(n - pos, pos)})


def with_class_weights(df: DataFrame, label: str) -> DataFrame:
    return df.join(class_weights(df, label).select(label, "weight"), label)


# --- generated features ------------------------------------------------------------------------------

def interaction_columns(columns: list[str]) -> dict[str, Column]:
    """Products and ratios of every pair, by name; a zero divisor counts as one."""
    new = {}
    for a, b in combinations(columns, 2):
        safe = F.when(F.col(b) == 0, F.lit(1.0)).otherwise(F.col(b))
        new[f"{a}_x_{b}"] = F.col(a) * F.col(b)
        new[f"{a}_div_{b}"] = F.col(a) / safe
    return new


def interactions(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns(interaction_columns(columns))


def anova_scores(df: DataFrame, candidates: dict[str, Column], label: str) -> DataFrame:
    """``feature``, ``f_value`` of the one-way analysis of variance over the label, null where a feature does not vary inside the labels.

    Counts, means and variances of all candidates per label come from one aggregate; the candidates are never a table of their own.
    """
    values = array_to_vector(F.array(*[c.cast("double") for c in candidates.values()]))
    stats = df.select(label, values.alias("v")).groupBy(label).agg(F.count("*").alias("n"), Summarizer.metrics("mean", "variance").summary(F.col("v")).alias("s"))
    names = F.array(*[F.lit(c) for c in candidates])
    rows = stats.select(label, "n", F.posexplode(F.arrays_zip(names.alias("feature"), vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("var"))).alias("i", "x"))
    rows = rows.select(label, "n", "x.feature", "x.mean", "x.var")                       # a row per label and candidate
    n, k = F.sum("n"), F.count("*")
    within = F.sum(F.col("var") * (F.col("n") - 1))
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - F.sum(F.col("n") * F.col("mean")) * F.sum(F.col("n") * F.col("mean")) / n
    return rows.groupBy("feature").agg(F.try_divide(between / (k - 1), F.nullif(within / (n - k), F.lit(0.0))).alias("f_value"))


# --- oversampling ---------------------------------------------------------------------------------

def smote(df: DataFrame, key: str, label: str, columns: list[str], ratio_to: float = 0.6, k: int = 15, seed: int = 42) -> DataFrame:
    """Synthetic minority rows up to ``ratio_to`` of the majority: points between a row and one of its ``k`` nearest
    neighbours. The label 1 is the minority. Returns the new rows only, ``(columns, label)``."""
    counts = one_row(df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))
    minority = stage(df.where(F.col(label) == 1).select(key, *columns), "minority")
    wanted = F.greatest(F.lit(0), F.floor(counts.getField("neg") * F.lit(ratio_to)) - counts.getField("pos"))
    ranked = global_rank(minority.select(key, unit_hash(F.col(key), seed).alias("_h")), "_h", key, "_turn").select(key, "_turn")
    pos = F.greatest(F.lit(1), counts.getField("pos"))
    copies = F.floor(wanted / pos) + flag(F.col("_turn") <= wanted % pos)
    plan = (ranked.withColumn("_copies", copies.cast("int")).where(F.col("_copies") > 0)
                  .select(key, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")))
    near = near_neighbours(minority, key, columns, k)
    degree = near.groupBy(key).agg(F.count("*").alias("_deg"))
    chosen = plan.join(degree, key).withColumn("rank", (F.floor(unit_hash(F.col(key), F.col("_copy"), "which", seed) * F.col("_deg")) + 1).cast("int"))
    between = unit_hash(F.col(key), F.col("_copy"), "gap", seed)
    mixed = chosen.join(near, [key, "rank"]).withColumn("_g", between)
    point = F.zip_with("v", "w", lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    rows = mixed.select(F.col(key).alias("from_key"), F.col("other").alias("to_key"), "_g", point.alias("pt"))
    return rows.select("from_key", "to_key", *[(F.col("pt")[i]["x"] + F.col("_g") * (F.col("pt")[i]["y"] - F.col("pt")[i]["x"])).alias(c)
                                              for i, c in enumerate(columns)], F.lit(1).alias(label))
