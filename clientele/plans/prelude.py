"""SQL fragments shared by the checking queries, and staged inputs shared by the Spark queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.staging import stage
from ..operators import features as ft
from ..sources.star import Star


def days(a: str, b: str) -> str:
    return f"CAST(floor((epoch_us({b}) - epoch_us({a})) / 86400000000.0) AS BIGINT)"


# Results are rounded for comparison. The nudge makes exact ties (x.xxxx5) go up on every engine.
NUDGE = 1.000000000001


def r(expr: str, digits: int = 4, name: str | None = None) -> str:
    return f"round(({expr}) * {NUDGE:.12f}, {digits})" + (f" AS {name}" if name else "")


def rd(c, name: str | None = None, digits: int = 4) -> Column:
    value = F.round((F.col(c) if isinstance(c, str) else c) * F.lit(NUDGE), digits)
    return value.alias(name or c)


def rnd(*cols: str, digits: int = 4) -> list[Column]:
    return [rd(c, digits=digits) for c in cols]


def rank_bin(rank: str, n: str, q: int) -> str:
    return f"CAST(coalesce(greatest(1, ceil(({rank} - 1) * {q} / nullif({n} - 1, 0))), 1) AS INTEGER)"


def ncdf(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.3275911 * {x}))"
    poly = (f"(((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} "
            f"+ 0.254829592) * {t})")
    erf = f"(1.0 - {poly} * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} >= 0 THEN 0.5 * (1.0 + {erf}) ELSE 0.5 * (1.0 - {erf}) END)"


SEGMENT_8 = """CASE WHEN r_ >= 4 AND f_ >= 4 AND m_ >= 4 THEN 'Champions'
  WHEN r_ >= 3 AND f_ >= 3 AND m_ >= 4 THEN 'Loyal Customers'
  WHEN r_ >= 3 AND f_ <= 2 AND m_ >= 3 THEN 'Potential Loyalists'
  WHEN r_ >= 4 AND f_ <= 2 THEN 'New Customers'
  WHEN r_ <= 2 AND f_ >= 3 AND m_ >= 3 THEN 'At Risk'
  WHEN r_ <= 2 AND f_ >= 4 AND m_ >= 4 THEN 'Cant Lose Them'
  WHEN r_ <= 2 AND f_ <= 2 AND m_ <= 2 THEN 'Lost' ELSE 'Others' END"""


def value_bin(x: str, edges: str, labels: list) -> str:
    n = len(labels)
    arms = " ".join(f"WHEN {x} <= {edges}[{i}] THEN {labels[i - 1]!r}" for i in range(1, n))
    return f"CASE {arms} ELSE {labels[n - 1]!r} END"


PRE = f"""
WITH cust AS (SELECT c_custkey AS customer_unique_id, n_name AS customer_state, c_mktsegment AS customer_city
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
ord AS (SELECT o_orderkey AS order_id, o_custkey AS customer_unique_id, o_orderdate AS ts,
  CASE WHEN o_orderstatus = 'F' THEN 'delivered' ELSE 'open' END AS order_status,
  o_orderdate + INTERVAL 60 DAY AS est, o_totalprice AS payment_value, o_orderpriority AS payment_type,
  1 + o_orderkey % 10 AS payment_installments, 1 AS payment_sequential FROM orders),
rev AS (SELECT o_orderkey AS order_id, 1 + o_orderkey % 5 AS review_score,
  CASE WHEN o_orderpriority LIKE '1-%' THEN o_orderpriority END AS review_comment_message,
  o_orderdate + INTERVAL 70 DAY AS review_creation_date,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 72 DAY END AS review_answer_timestamp
  FROM orders WHERE o_orderstatus <> 'P'),
itm AS (SELECT l_orderkey AS order_id, l_partkey AS product_id, l_extendedprice AS price,
  l_extendedprice * l_tax AS freight_value, l_shipdate AS shipped_at FROM lineitem),
prod AS (SELECT p_partkey AS product_id, p_type AS category, p_brand AS brand FROM part),
dlv AS (SELECT order_id, min(shipped_at) AS carrier, max(shipped_at) AS delivered FROM itm GROUP BY 1),
lin AS (SELECT order_id, count(*) AS n_items, round(sum(price), 2) AS items_value,
  round(sum(freight_value), 4) AS freight_total FROM itm GROUP BY 1),
fact AS (SELECT ord.*, n_items, items_value, freight_total FROM ord JOIN lin USING (order_id)),
ref AS (SELECT max(ts) AS ref FROM ord),
upp AS (SELECT customer_unique_id, count(DISTINCT product_id) AS unique_products_purchased
  FROM itm JOIN ord USING (order_id) GROUP BY 1),
agg AS (SELECT customer_unique_id, count(*) AS total_orders, round(sum(payment_value), 2) AS total_revenue,
  coalesce(round(stddev_samp(payment_value), 2), 0) AS order_value_std, median(payment_value) AS median_order_value,
  min(ts) AS first_purchase_date, max(ts) AS last_purchase_date, CAST(sum(n_items) AS BIGINT) AS total_items,
  round(sum(freight_total), 4) AS freight_paid FROM fact GROUP BY 1),
f1 AS (SELECT agg.*, unique_products_purchased, customer_state, customer_city,
  {days('last_purchase_date', 'ref')} AS recency_days, total_orders AS frequency, total_revenue AS monetary_value,
  {days('first_purchase_date', 'last_purchase_date')} AS customer_lifetime_days,
  total_revenue / total_orders AS avg_order_value, freight_paid / total_items AS avg_freight_value,
  unique_products_purchased / total_orders AS product_diversity_score
  FROM agg JOIN upp USING (customer_unique_id) JOIN cust USING (customer_unique_id), ref),
f2 AS (SELECT *, customer_lifetime_days / total_orders AS avg_days_between_orders,
  total_orders / greatest(customer_lifetime_days / 30.0, 1) AS orders_per_month,
  unique_products_purchased / total_orders AS products_per_order,
  order_value_std / greatest(avg_order_value, 1) AS value_consistency,
  ln(1 + total_revenue) * ln(1 + total_orders) AS customer_value_score,
  greatest(ceil(customer_lifetime_days / 90), 1) AS lifetime_quarters,
  total_revenue / greatest(ceil(customer_lifetime_days / 90), 1) AS avg_revenue_per_quarter FROM f1),
feat AS (SELECT *, CASE WHEN (avg_days_between_orders < 90 AND recency_days > 180)
  OR (avg_days_between_orders >= 90 AND total_orders > 1 AND recency_days > 365)
  OR (total_orders = 1 AND recency_days > 540) THEN 1 ELSE 0 END AS churned,
  CASE WHEN (orders_per_month > 1 AND recency_days > 90)
  OR (orders_per_month > 0.5 AND orders_per_month <= 1 AND recency_days > 180)
  OR (orders_per_month <= 0.5 AND recency_days > 365) THEN 1 ELSE 0 END AS churned_velocity FROM f2),
edges AS (SELECT quantile_cont(recency_days, [0.2, 0.4, 0.6, 0.8]) AS re,
  quantile_cont(monetary_value, [0.2, 0.4, 0.6, 0.8]) AS me, count(*) AS n FROM feat),
rfm0 AS (SELECT feat.*, CASE WHEN recency_days <= re[1] THEN 5 WHEN recency_days <= re[2] THEN 4
  WHEN recency_days <= re[3] THEN 3 WHEN recency_days <= re[4] THEN 2 ELSE 1 END AS r_,
  {rank_bin('row_number() OVER (ORDER BY frequency, customer_unique_id)', 'n', 5)} AS f_,
  CASE WHEN monetary_value <= me[1] THEN 1 WHEN monetary_value <= me[2] THEN 2
  WHEN monetary_value <= me[3] THEN 3 WHEN monetary_value <= me[4] THEN 4 ELSE 5 END AS m_ FROM feat, edges),
rfm AS (SELECT *, {SEGMENT_8} AS customer_segment FROM rfm0)
"""


PARTS = {"median": {"median_order_value"}, "home": {"customer_state", "customer_city"},
         "products": {"unique_products_purchased", "products_per_order", "product_diversity_score"}}


def base_features(spark, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Customer features with behaviour ratios and the lifecycle churn label, not yet staged."""
    s = Star(spark, sf_dir)
    parts = tuple(p for p, cols in PARTS.items() if columns is None or cols & set(columns))
    feats = ft.customer_features(s.orders(), s.items(), s.payments(), s.customers(), parts=parts)
    out = ft.behaviour_ratios(feats).withColumn("churned", ft.churn_lifecycle())
    return out.select(*columns) if columns else out


def staged_features(spark, sf_dir: str, columns: list[str]) -> DataFrame:
    """Customer features written once for queries which rank or bin them; only the wanted columns."""
    return stage(base_features(spark, sf_dir, columns), "features")


RFM_COLUMNS = ["customer_unique_id", "recency_days", "frequency", "monetary_value", "total_orders", "avg_order_value",
               "customer_lifetime_days", "avg_days_between_orders", "customer_state", "first_purchase_date",
               "last_purchase_date", "churned"]


def segmented(spark, sf_dir: str) -> DataFrame:
    """Features, RFM scores and the eight-way segment."""
    feats = staged_features(spark, sf_dir, RFM_COLUMNS)
    return ft.rfm_scores_exact(feats).withColumn("customer_segment", ft.segment_8())
