"""Adapter: presents an order/line/customer star schema as the canonical tables.

Columns without a counterpart are deterministic stand-ins (see README).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .io import spread


@dataclass(frozen=True)
class Star:
    """Lazy readers over one data folder; nothing is read until a query runs."""

    spark: SparkSession
    path: str

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}.parquet")

    def customers(self) -> DataFrame:
        nation = self.raw("nation").select("n_nationkey", F.col("n_name").alias("customer_state"))
        return (self.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
                .select(F.col("c_custkey").alias("customer_unique_id"), "customer_state",
                        F.col("c_mktsegment").alias("customer_city")))

    def orders(self) -> DataFrame:
        ts = F.col("o_orderdate")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_unique_id"),
            F.when(F.col("o_orderstatus") == "F", "delivered").otherwise("open").alias("order_status"),
            ts.alias("order_purchase_timestamp"),
            (ts + F.expr("INTERVAL 60 DAYS")).alias("order_estimated_delivery_date"))

    def payments(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"), F.lit(1).alias("payment_sequential"),
            F.col("o_orderpriority").alias("payment_type"),
            (1 + F.pmod("o_orderkey", F.lit(10))).alias("payment_installments"),
            F.col("o_totalprice").alias("payment_value"))

    def items(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            F.col("l_extendedprice").alias("price"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
            F.col("l_shipdate").alias("shipped_at"))

    def deliveries(self) -> DataFrame:
        """First shipment of an order stands for the carrier hand-over, the last one for delivery."""
        return self.raw("lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(
            F.min("l_shipdate").alias("order_delivered_carrier_date"),
            F.max("l_shipdate").alias("order_delivered_customer_date"))

    def reviews(self) -> DataFrame:
        """Every order which is not pending has a review; urgent ones carry a comment."""
        day = F.col("o_orderdate")
        return self.raw("orders").where(F.col("o_orderstatus") != "P").select(
            F.col("o_orderkey").alias("order_id"), (1 + F.pmod("o_orderkey", F.lit(5))).alias("review_score"),
            F.when(F.col("o_orderpriority").startswith("1-"), F.col("o_orderpriority")).alias("review_comment_message"),
            (day + F.expr("INTERVAL 70 DAYS")).alias("review_creation_date"),
            F.when(F.col("o_orderstatus") == "F", day + F.expr("INTERVAL 72 DAYS")).alias("review_answer_timestamp"))

    def products(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("product_id"),
                                       F.col("p_type").alias("product_category_name"),
                                       F.col("p_brand").alias("product_brand"))

    def events(self) -> DataFrame:
        return self.raw("events")

    def review_texts(self) -> DataFrame:
        texts = self.raw("documents").select(
            F.col("doc_id").alias("review_id"), F.col("text").alias("review_comment_message"),
            (1 + F.pmod("doc_id", F.lit(5))).alias("review_score"),
            F.pmod("doc_id", F.lit(150)).alias("customer_unique_id"))
        return spread(texts, "review_id")

    def vectors(self) -> DataFrame:
        return self.raw("embeddings")
