"""Cohort analysis by month of first purchase.

The order table is aggregated to ``(cohort month, months since)`` first; everything after that works on
this matrix in long form, whose size is bounded by the calendar and not by the customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.core import cut, month_index, month_label, one_row, ratio
from .features import PERSON, TS

CAC = 50.0


def cohort_base(orders: DataFrame) -> DataFrame:
    """Orders with cohort month, order month and months since the person's first purchase."""
    first = orders.groupBy(PERSON).agg(F.min(TS).alias("first_purchase_date"))
    return orders.join(first, PERSON).withColumns({
        "cohort_month": month_label("first_purchase_date"), "order_month": month_label(TS),
        "cohort_index": month_index("first_purchase_date", TS)})


METRICS = {"customers": lambda: F.countDistinct(PERSON), "orders": lambda: F.countDistinct("order_id"),
           "revenue": lambda: F.round(F.sum("items_value"), 2)}


def cohort_matrix(base: DataFrame, metric: str = "customers", by: list[str] | None = None) -> DataFrame:
    """Long retention matrix: ``value`` and its percentage of month 0 per cohort (and segment)."""
    keys = [*(by or []), "cohort_month"]
    cells = base.groupBy(*keys, "cohort_index").agg(METRICS[metric]().alias("value"))
    return _with_share(cells, keys)


def _with_share(cells: DataFrame, keys: list[str]) -> DataFrame:
    start = F.max(F.when(F.col("cohort_index") == 0, F.col("value"))).over(W.partitionBy(*keys))
    return cells.withColumn("retention", ratio("value", start) * 100)


def cohort_matrix_from_features(customers: DataFrame) -> DataFrame:
    """Matrix of customers by the month they were last seen, relative to the first purchase."""
    cells = customers.groupBy(month_label("first_purchase_date").alias("cohort_month"),
                              month_index("first_purchase_date", "last_purchase_date").alias("cohort_index")).agg(
        F.count("*").alias("value"))
    return _with_share(cells, ["cohort_month"])


def all_periods(base: DataFrame) -> list[int]:
    """Every month number from 0 to the last one in the table (a number of columns, bounded by the calendar)."""
    last = base.agg(F.max("cohort_index")).first()[0]
    return list(range((last or 0) + 1))


def wide(matrix: DataFrame, periods: list[int], value: str = "retention") -> DataFrame:
    """Cohorts as rows, months as columns ``m0``, ``m1`` ..."""
    cells = [F.max(F.when(F.col("cohort_index") == p, F.col(value))).alias(f"m{p}") for p in periods]
    return matrix.groupBy("cohort_month").agg(*cells)


def cohort_quality(base: DataFrame) -> DataFrame:
    per = base.groupBy("cohort_month").agg(
        F.countDistinct(PERSON).alias("cohort_size"), F.count("*").alias("total_orders"),
        F.round(F.sum("items_value"), 2).alias("total_revenue"), F.max("cohort_index").alias("cohort_age"))
    third = base.where("cohort_index = 3").groupBy("cohort_month").agg(F.countDistinct(PERSON).alias("retained_3m"))
    per = per.join(third, "cohort_month", "left").withColumns({
        "avg_order_value": ratio("total_revenue", "total_orders"),
        "orders_per_customer": ratio("total_orders", "cohort_size"),
        "revenue_per_customer": ratio("total_revenue", "cohort_size"),
        "retention_3m": ratio("retained_3m", "cohort_size") * 100})
    parts = ["revenue_per_customer", "orders_per_customer", "retention_3m"]
    mean = {p: F.avg(p).over(W.partitionBy()) for p in parts}   # one row per month: a small table
    score = (ratio("revenue_per_customer", mean[parts[0]]) * 0.4 + ratio("orders_per_customer", mean[parts[1]]) * 0.3
             + F.coalesce(ratio(F.coalesce("retention_3m", F.lit(0.0)), mean[parts[2]]), F.lit(0.0)) * 0.3)
    return per.withColumn("quality_score", score).withColumn("cohort_quality", cut(
        "quality_score", [0, 0.8, 1.2, float("inf")], ["Below Average", "Average", "Above Average"], True))


def cohort_ltv_curve(base: DataFrame, months: int = 24) -> DataFrame:
    """Cumulative value per cohort and month: ``ltv`` in money per customer, ``ltv_ratio`` as the sum of
    revenue retention over customer retention. Months beyond the observed ones follow an exponential
    decay fitted to the retention of the last observed month."""
    cells = base.groupBy("cohort_month", "cohort_index").agg(
        F.countDistinct(PERSON).alias("customers"), F.round(F.sum("items_value"), 2).alias("revenue"))
    w = W.partitionBy("cohort_month")
    start = lambda c: F.max(F.when(F.col("cohort_index") == 0, F.col(c))).over(w)
    cells = cells.withColumns({"size": start("customers"), "first_revenue": start("revenue")})
    cells = cells.withColumns({
        "kept": ratio("customers", "size"), "money": ratio("revenue", "size"),
        "ratio": ratio(ratio("revenue", "first_revenue"), ratio("customers", "size"))})
    observed = one_row(cells.agg(F.max("cohort_index").alias("last"))).getField("last")
    tail = cells.where(F.col("cohort_index") == observed).agg(F.avg("kept").alias("kept"))
    decay = -F.ln(one_row(tail).getField("kept")) / (observed + 1)
    means = cells.groupBy("cohort_month").agg(F.avg("money").alias("mean_money"), F.avg("ratio").alias("mean_ratio"))
    grid = means.withColumn("month", F.explode(F.sequence(F.lit(0), F.lit(months - 1)))).withColumn("month", F.col("month").cast("long"))
    known = cells.select("cohort_month", F.col("cohort_index").alias("month"), "money", "ratio")
    filled = grid.join(known, ["cohort_month", "month"], "left")
    fade = F.exp(-decay * F.col("month"))
    step = lambda v, mean: (F.when(F.col("month") <= observed, F.coalesce(F.col(v), F.lit(0.0))).otherwise(F.col(mean) * fade))
    upto = W.partitionBy("cohort_month").orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    return filled.select("cohort_month", "month", F.sum(step("money", "mean_money")).over(upto).alias("ltv"),
                         F.sum(step("ratio", "mean_ratio")).over(upto).alias("ltv_ratio"))


def cohort_ltv(base: DataFrame, months: int = 24, cac: float = CAC) -> DataFrame:
    curve = cohort_ltv_curve(base, months)
    at = lambda m: F.max(F.when(F.col("month") == m - 1, F.col("ltv")))
    return curve.groupBy("cohort_month").agg(
        at(6).alias("ltv_6m"), at(12).alias("ltv_12m"), at(months).alias("ltv_end"),
        F.max(F.when(F.col("month") == months - 1, F.col("ltv_ratio"))).alias("ltv_ratio_end"),
        F.min(F.when(F.col("ltv") > cac, F.col("month"))).alias("months_to_payback"))


def cohort_by_segment(base: DataFrame, segment: str, periods: tuple[int, ...] = (0, 1, 3, 6, 12)) -> DataFrame:
    """Mean retention over cohorts at chosen months, for every segment in one pass."""
    cells = cohort_matrix(base, "customers", [segment]).where(F.col("cohort_index").isin(*periods))
    return cells.groupBy(F.col(segment).alias("segment"), F.col("cohort_index").alias("period")).agg(F.avg("retention").alias("avg_retention"))


def cohort_forecast(matrix: DataFrame, history: int = 12, ahead: int = 3, trend_periods: int = 6, periods: int = 12) -> DataFrame:
    """Next cohorts: mean curve of the recent cohorts plus each month's linear trend over all cohorts."""
    recent = matrix.select("cohort_month").distinct().orderBy(F.desc("cohort_month")).limit(history)
    curve = matrix.join(recent, "cohort_month", "left_semi").where(F.col("cohort_index") < periods).groupBy("cohort_index").agg(
        F.avg("retention").alias("mean"), F.stddev_samp("retention").alias("confidence_band"))
    x = F.row_number().over(W.partitionBy("cohort_index").orderBy("cohort_month")) - 1
    trend = (matrix.where(F.col("cohort_index") < trend_periods).withColumn("x", x).groupBy("cohort_index")
             .agg(F.regr_slope("retention", "x").alias("s"), F.count("*").alias("n"))
             .select("cohort_index", F.when(F.col("n") > 3, F.col("s")).alias("slope")))
    rows = curve.join(trend, "cohort_index", "left").withColumn("future_month", F.explode(F.sequence(F.lit(1), F.lit(ahead))))
    shifted = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("mean") + F.col("slope") * F.col("future_month")))
    return rows.select("future_month", F.col("cohort_index").alias("period"),
                       F.coalesce(shifted * F.when(F.col("slope").isNotNull(), 1.0), "mean").alias("predicted_retention"), "confidence_band")


def cohort_summary(base: DataFrame) -> DataFrame:
    matrix = cohort_matrix(base)
    at = lambda p: F.avg(F.when(F.col("cohort_index") == p, F.col("retention"))).alias(f"avg_retention_month_{p}")
    best = F.max_by("cohort_month", F.struct("quality_score", "cohort_month")).alias("best")
    return matrix.agg(F.countDistinct("cohort_month").alias("total_cohorts"), at(1), at(3), at(6)).withColumns({
        "best_cohort": one_row(cohort_quality(base).agg(best)).getField("best"),
        "avg_ltv_12m": one_row(cohort_ltv(base).agg(F.avg("ltv_12m").alias("v"))).getField("v")})


def retention_curve_stats(matrix: DataFrame) -> DataFrame:
    """Mean, spread and step of retention per month since first purchase."""
    per = matrix.groupBy(F.col("cohort_index").alias("period")).agg(
        F.avg("retention").alias("mean_retention"), F.stddev_samp("retention").alias("std_retention"))
    step = F.col("mean_retention") - F.lag("mean_retention").over(W.orderBy("period"))
    return per.withColumn("change", F.coalesce(step, F.lit(100.0)))
