"""Canonical input tables and the `conform` operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.core import elapsed_days, one_row, ratio, at_least

_S, _D, _I, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


# Column names of the public e-commerce data set this library analyses.
CUSTOMERS = _struct(customer_id=_S, customer_unique_id=_S, customer_zip_code_prefix=_S,
                    customer_city=_S, customer_state=_S)
ORDERS = _struct(order_id=_S, customer_id=_S, order_status=_S, order_purchase_timestamp=_TS,
                 order_approved_at=_TS, order_delivered_carrier_date=_TS,
                 order_delivered_customer_date=_TS, order_estimated_delivery_date=_TS)
ORDER_ITEMS = _struct(order_id=_S, order_item_id=_I, product_id=_S, seller_id=_S,
                      shipping_limit_date=_TS, price=_D, freight_value=_D)
ORDER_PAYMENTS = _struct(order_id=_S, payment_sequential=_I, payment_type=_S,
                         payment_installments=_I, payment_value=_D)
ORDER_REVIEWS = _struct(review_id=_S, order_id=_S, review_score=_I, review_comment_title=_S,
                        review_comment_message=_S, review_creation_date=_TS, review_answer_timestamp=_TS)
PRODUCTS = _struct(product_id=_S, product_category_name=_S)
CATEGORY_TRANSLATION = _struct(product_category_name=_S, product_category_name_english=_S)

# Defaults of the customer table and the columns which may stand in for a missing one.
FEATURE_DEFAULTS = {"monetary_value": 0.0, "frequency": 1, "recency_days": 365,
                    "customer_lifetime_days": 0, "avg_order_value": 0.0, "churned": 0}
FEATURE_ALIASES = {"monetary_value": "total_revenue", "frequency": "total_orders"}


def conform(df: DataFrame, reference_date: Column | None = None) -> DataFrame:
    """Add the required customer columns: alias, then derivation, then default.

    Recency is derived from ``last_purchase_date`` where possible instead of defaulting to a year.
    """
    out = df
    for name, default in FEATURE_DEFAULTS.items():
        if name in out.columns:
            continue
        alias = FEATURE_ALIASES.get(name)
        if alias in out.columns:
            value = F.col(alias)
        elif name == "recency_days" and "last_purchase_date" in out.columns:
            ref = reference_date
            if ref is None:
                ref = one_row(df.agg(F.max("last_purchase_date").alias("m"))).getField("m")
            value = elapsed_days(F.col("last_purchase_date"), ref)
        elif name == "avg_order_value":
            value = ratio("monetary_value", at_least("frequency", 1))
        else:
            value = F.lit(default)
        out = out.withColumn(name, value)
    return out
