"""Queries for sources, projections, joins, aggregates, windows, sorts, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F, types as T

from ..functions import core as c
from ..functions import order_stats as os_
from ..functions.probability import normal_cdf
from ..functions.sampling import sample_rows
from ..functions.staging import stage, staging_path
from ..operators import features as ft
from ..operators import relational as rel
from ..sources import io, schema
from ..sources.star import Star
from .prelude import PRE, base_features, days, ncdf, r, rank_bin, rd, rnd, staged_features, value_bin
from .registry import REG

P, TS = ft.PERSON, ft.TS
n_ = lambda name="n": F.count("*").alias(name)
money = lambda col, name: F.round(F.sum(col), 2).alias(name)
day = lambda col: F.date_format(col, "yyyy-MM-dd")


# --- sources and sinks --------------------------------------------------------------------------

ORDER_FILE = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("status", T.StringType()),
                           T.StructField("placed", T.TimestampType()), T.StructField("total", T.DoubleType())])


def order_file(spark, sf):
    return Star(spark, sf).raw("orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("placed"), F.col("o_totalprice").alias("total"))


@REG.add("scan_csv", "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total, strftime(max(o_orderdate), '%Y-%m-%d') AS latest FROM orders GROUP BY 1")
def _(spark, sf):
    path = staging_path(spark, "orders-csv")
    io.sink_csv(order_file(spark, sf), path)
    return io.scan_csv(spark, path, ORDER_FILE).groupBy("status").agg(
        n_(), money("total", "total"), day(F.max("placed")).alias("latest"))


@REG.add("scan_parquet", "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def _(spark, sf):
    lines = io.scan_parquet(spark, f"{sf}/lineitem.parquet").where(F.col("l_shipdate") >= "1998-01-01")
    return lines.groupBy("l_returnflag").agg(n_(), money("l_extendedprice", "total"))


@REG.add("sink_parquet", "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(spark, sf):
    path = staging_path(spark, "orders-parquet")
    io.sink_parquet(order_file(spark, sf), path, ["status"])
    return io.scan_parquet(spark, path).groupBy("status").agg(n_(), money("total", "total"))


@REG.add("sink_csv", "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def _(spark, sf):
    path = staging_path(spark, "customers-csv")
    io.sink_csv(Star(spark, sf).raw("customer").select("c_custkey", "c_mktsegment", "c_acctbal"), path)
    fields = T.StructType().add("c_custkey", "long").add("c_mktsegment", "string").add("c_acctbal", "double")
    return io.scan_csv(spark, path, fields).groupBy(F.col("c_mktsegment").alias("segment")).agg(n_(), money("c_acctbal", "balance"))


@REG.add("sink_json", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def _(spark, sf):
    rows = Star(spark, sf).raw("orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(
        n_(), money("o_totalprice", "total"))
    # one document per status; the list inside is bounded by the number of priorities
    docs = rows.groupBy("status").agg(F.collect_list(F.struct("priority", F.struct("n", "total").alias("kpi"))).alias("by_priority"))
    path = staging_path(spark, "dashboard-json")
    io.sink_json(docs, path)
    back = spark.read.schema(docs.schema).json(path).select("status", F.explode("by_priority").alias("e"))
    return back.select("status", "e.priority", "e.kpi.n", "e.kpi.total")


@REG.add("cache_hot", "SELECT 'orders' AS source, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders UNION ALL SELECT 'delivered', count(*), round(sum(o_totalprice), 2) FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    with io.cache_hot(order_file(spark, sf)) as hot:
        whole = stage(hot.agg(n_(), money("total", "total")).select(F.lit("orders").alias("source"), "n", "total"), "hot")
        part = stage(hot.where("status = 'F'").agg(n_(), money("total", "total")).select(F.lit("delivered").alias("source"), "n", "total"), "hot")
    return whole.unionByName(part)


@REG.add("conform", PRE + f"SELECT customer_unique_id, monetary_value, frequency, {days('last_purchase_date', '(SELECT max(last_purchase_date) FROM feat)')} AS recency_days, 0 AS customer_lifetime_days, {r('avg_order_value', 4, 'avg_order_value')}, 0 AS churned FROM feat")
def _(spark, sf):
    bare = base_features(spark, sf, [P, "total_orders", "total_revenue", "last_purchase_date"])
    return schema.conform(bare).select(P, "monetary_value", "frequency", "recency_days", "customer_lifetime_days", *rnd("avg_order_value"), "churned")


@REG.add("parse_timestamps", "SELECT o_orderpriority AS priority, count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS latest, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS unparsed FROM orders GROUP BY 1")
def _(spark, sf):
    text = F.date_format("o_orderdate", io.TIMESTAMP_FORMAT)
    rows = Star(spark, sf).raw("orders").select(
        F.col("o_orderpriority").alias("priority"), text.alias("strict"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("about "), text)).otherwise(text).alias("lenient"))
    parsed = io.parse_timestamps(io.parse_timestamps(rows, ["strict"]), ["lenient"], lenient=True)
    return parsed.groupBy("priority").agg(n_(), day(F.max("strict")).alias("latest"), F.count_if(F.col("lenient").isNull()).alias("unparsed"))


# --- projections, filters, predicates ------------------------------------------------------------

@REG.add("project_prune", "SELECT p_brand AS brand, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def _(spark, sf):
    s = Star(spark, sf)
    return (s.items().select("product_id", "price").join(s.products().select("product_id", "product_brand"), "product_id")
            .groupBy(F.col("product_brand").alias("brand")).agg(n_(), money("price", "total")))


@REG.add("filter_delivered", PRE + "SELECT customer_unique_id, count(*) AS n FROM ord WHERE order_status = 'delivered' GROUP BY 1")
def _(spark, sf):
    return ft.filter_delivered(Star(spark, sf).orders()).groupBy(P).agg(n_())


@REG.add("filter_isin", PRE + ", top AS (SELECT customer_state FROM cust GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) SELECT customer_state, customer_city, count(*) AS n FROM cust WHERE customer_state IN (SELECT customer_state FROM top) AND customer_city IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2")
def _(spark, sf):
    people = Star(spark, sf).customers()
    return (rel.semi_join_topk(people, "customer_state", 5).where(F.col("customer_city").isin("BUILDING", "MACHINERY"))
            .groupBy("customer_state", "customer_city").agg(n_()))


@REG.add("filter_drop_null", PRE + "SELECT review_score, count(*) AS n FROM rev WHERE review_comment_message IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return Star(spark, sf).reviews().na.drop(subset=["review_comment_message"]).groupBy("review_score").agg(n_())


@REG.add("fill_const", PRE + f"SELECT customer_unique_id, {r('avg(coalesce(review_score, 3.5))', 4, 'rating')} FROM ord LEFT JOIN rev USING (order_id) GROUP BY 1")
def _(spark, sf):
    s = Star(spark, sf)
    rows = s.orders().join(s.reviews().withColumn("review_score", F.col("review_score").cast("double")), "order_id", "left").fillna({"review_score": 3.5})
    return rows.groupBy(P).agg(F.avg("review_score").alias("rating")).select(P, *rnd("rating"))


@REG.add("fill_median", PRE + f", x AS (SELECT customer_unique_id, review_score FROM ord LEFT JOIN rev USING (order_id)), m AS (SELECT median(review_score) AS m FROM x) SELECT customer_unique_id, {r('avg(coalesce(review_score, m))', 4, 'rating')} FROM x, m GROUP BY 1")
def _(spark, sf):
    s = Star(spark, sf)
    rows = s.orders().join(s.reviews(), "order_id", "left").select(P, F.col("review_score").cast("double").alias("review_score"))
    return rel.fill_median(rows, ["review_score"]).groupBy(P).agg(F.avg("review_score").alias("rating")).select(P, *rnd("rating"))


@REG.add("sanitize_non_finite", f"SELECT l_returnflag, round(sum(CASE WHEN l_discount = 0 THEN 0 ELSE l_quantity / l_discount END), 2) AS total, count(CASE WHEN l_discount = 0 THEN 1 END) AS replaced FROM lineitem GROUP BY 1")
def _(spark, sf):
    raw = Star(spark, sf).raw("lineitem")
    x = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity") / F.when(F.col("l_discount") != 0, F.col("l_discount")))
    return raw.withColumn("x", x).groupBy("l_returnflag").agg(
        money(c.finite_or_zero("x"), "total"), F.count_if(F.col("x") == float("inf")).alias("replaced"))


@REG.add("clip", f"SELECT l_linestatus, round(sum(least(greatest(l_quantity, 5), 40)), 2) AS clipped, round(sum(greatest(l_quantity, 10)), 2) AS floored FROM lineitem GROUP BY 1")
def _(spark, sf):
    return Star(spark, sf).raw("lineitem").groupBy("l_linestatus").agg(
        money(c.clip("l_quantity", 5.0, 40.0), "clipped"), money(c.at_least("l_quantity", 10.0), "floored"))


@REG.add("case_rules", "SELECT CASE WHEN o_totalprice > 300000 AND o_orderpriority < '3' THEN 'urgent big' WHEN o_totalprice > 300000 THEN 'big' WHEN o_orderpriority < '3' THEN 'urgent' ELSE 'plain' END AS kind, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    big, urgent = F.col("o_totalprice") > 300000, F.col("o_orderpriority") < "3"
    kind = c.first_match([(big & urgent, "urgent big"), (big, "big"), (urgent, "urgent")], "plain")
    return Star(spark, sf).raw("orders").groupBy(kind.alias("kind")).agg(n_())


@REG.add("map_lookup", PRE + f"SELECT order_id, CASE review_score WHEN 1 THEN 0.15 WHEN 2 THEN 0.10 WHEN 3 THEN 0.05 WHEN 4 THEN 0.02 WHEN 5 THEN 0.01 ELSE 0.05 END::DOUBLE AS return_rate FROM ord LEFT JOIN rev USING (order_id)")
def _(spark, sf):
    from ..operators.metrics import RETURN_RATES
    s = Star(spark, sf)
    return s.orders().join(s.reviews(), "order_id", "left").select("order_id", c.lookup("review_score", RETURN_RATES, 0.05).alias("return_rate"))


@REG.add("flag_columns", PRE + "SELECT order_id, coalesce(CAST(review_score <= 2 AS INTEGER), 0) AS is_poor, CAST(payment_value > 200000 AS INTEGER) AS is_large FROM ord LEFT JOIN rev USING (order_id)")
def _(spark, sf):
    s = Star(spark, sf)
    return (s.orders().join(s.payments(), "order_id").join(s.reviews(), "order_id", "left")
            .select("order_id", c.flag(F.col("review_score") <= 2).alias("is_poor"), c.flag(F.col("payment_value") > 200000).alias("is_large")))


@REG.add("rename_flatten", f"SELECT o_orderstatus, count(*) AS price_count, round(sum(o_totalprice), 2) AS price_sum, {r('avg(o_totalprice)', 3, 'price_mean')}, {r('stddev_samp(o_totalprice)', 2, 'price_std')}, strftime(min(o_orderdate), '%Y-%m-%d') AS date_min, strftime(max(o_orderdate), '%Y-%m-%d') AS date_max FROM orders GROUP BY 1")
def _(spark, sf):
    return Star(spark, sf).raw("orders").groupBy("o_orderstatus").agg(
        n_("price_count"), money("o_totalprice", "price_sum"), rd(F.avg("o_totalprice"), "price_mean", 3),
        rd(F.stddev_samp("o_totalprice"), "price_std", 2), day(F.min("o_orderdate")).alias("date_min"), day(F.max("o_orderdate")).alias("date_max"))


@REG.add("null_insensitive_numeric", "SELECT count(*) AS n, count(v) AS numbers, CAST(sum(v) AS BIGINT) AS total FROM (SELECT TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN split_part(o_orderpriority, '-', 1) ELSE o_orderpriority END AS BIGINT) AS v FROM orders)")
def _(spark, sf):
    text = F.when(F.col("o_orderstatus") == "F", F.split_part("o_orderpriority", F.lit("-"), F.lit(1))).otherwise(F.col("o_orderpriority"))
    return Star(spark, sf).raw("orders").select(text.try_cast("bigint").alias("v")).agg(n_(), F.count("v").alias("numbers"), F.sum("v").alias("total"))


# --- joins ---------------------------------------------------------------------------------------

@REG.add("join_inner_star", PRE + "SELECT customer_state, count(*) AS orders, round(sum(payment_value), 2) AS paid, round(sum(items_value), 2) AS items_value FROM fact JOIN cust USING (customer_unique_id) GROUP BY 1")
def _(spark, sf):
    s = Star(spark, sf)
    return (ft.order_facts(s.orders(), s.items(), s.payments()).join(s.customers(), P).groupBy("customer_state")
            .agg(n_("orders"), money("payment_value", "paid"), money("items_value", "items_value")))


@REG.add("join_left_reviews", PRE + "SELECT customer_unique_id, count(*) AS orders, count(review_score) AS reviewed FROM ord LEFT JOIN rev USING (order_id) GROUP BY 1")
def _(spark, sf):
    s = Star(spark, sf)
    return s.orders().join(s.reviews(), "order_id", "left").groupBy(P).agg(n_("orders"), F.count("review_score").alias("reviewed"))


@REG.add("join_left_dim", "SELECT coalesce(en, 'untranslated') AS category, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN (SELECT DISTINCT p_type AS pt, lower(p_type) AS en FROM part WHERE p_type <> 'PROMO') ON p_type = pt GROUP BY 1")
def _(spark, sf):
    s = Star(spark, sf)
    names = s.products().select("product_category_name", F.lower("product_category_name").alias("product_category_name_english")).distinct()
    names = names.where(F.col("product_category_name") != "PROMO")
    rows = s.items().join(s.products(), "product_id").join(names, "product_category_name", "left")
    return rows.groupBy(F.coalesce("product_category_name_english", F.lit("untranslated")).alias("category")).agg(n_())


@REG.add("join_different_keys", "SELECT n_name AS state, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, sf):
    s = Star(spark, sf)
    customer, nation = s.raw("customer"), s.raw("nation")
    joined = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"], "left").drop("n_nationkey")
    return joined.groupBy(F.col("n_name").alias("state")).agg(n_(), money("c_acctbal", "balance"))


@REG.add("join_full_outer", PRE + """, a AS (SELECT customer_unique_id, count(*) AS commented FROM ord JOIN rev USING (order_id) WHERE review_comment_message IS NOT NULL GROUP BY 1),
  b AS (SELECT customer_unique_id, count(*) AS open_orders FROM ord WHERE order_status = 'open' GROUP BY 1)
  SELECT coalesce(a.customer_unique_id, b.customer_unique_id) AS customer_unique_id, commented, open_orders FROM a FULL JOIN b ON a.customer_unique_id = b.customer_unique_id""")
def _(spark, sf):
    s = Star(spark, sf)
    commented = s.orders().join(s.reviews().na.drop(subset=["review_comment_message"]), "order_id").groupBy(P).agg(n_("commented"))
    opened = s.orders().where("order_status = 'open'").groupBy(P).agg(n_("open_orders"))
    return commented.join(opened, P, "full_outer")


@REG.add("join_back_group_stat", f"SELECT o_orderkey, {r('o_totalprice / avg(o_totalprice) OVER (PARTITION BY o_orderpriority)', 6, 'relative_value')} FROM orders")
def _(spark, sf):
    o = Star(spark, sf).raw("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    means = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"))
    return o.join(means, "o_orderpriority").select("o_orderkey", rd(c.ratio("o_totalprice", "m"), "relative_value", 6))


@REG.add("join_features_wide", PRE + """, a AS (SELECT customer_unique_id, count(review_score) AS reviews FROM ord JOIN rev USING (order_id) GROUP BY 1), b AS (SELECT customer_unique_id, max(payment_installments) AS max_installments FROM ord GROUP BY 1)
  SELECT customer_unique_id, total_orders, coalesce(reviews, 0) AS reviews, max_installments, unique_products_purchased FROM agg LEFT JOIN a USING (customer_unique_id) LEFT JOIN b USING (customer_unique_id) LEFT JOIN upp USING (customer_unique_id)""")
def _(spark, sf):
    s = Star(spark, sf)
    o = s.orders()
    base = ft.order_facts(o, s.items(), s.payments()).groupBy(P).agg(n_("total_orders"))
    reviews = o.join(s.reviews(), "order_id").groupBy(P).agg(F.count("review_score").alias("reviews"))
    paid = o.join(s.payments(), "order_id").groupBy(P).agg(F.max("payment_installments").alias("max_installments"))
    return ft.combine(base, [reviews, paid, ft.products_per_person(o, s.items())]).fillna({"reviews": 0})


@REG.add("semi_join_topk", PRE + ", top AS (SELECT customer_unique_id FROM ord GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20) SELECT customer_unique_id, count(*) AS n, round(sum(payment_value), 2) AS paid FROM ord SEMI JOIN top USING (customer_unique_id) GROUP BY 1")
def _(spark, sf):
    s = Star(spark, sf)
    return rel.semi_join_topk(s.orders(), P, 20).join(s.payments(), "order_id").groupBy(P).agg(n_(), money("payment_value", "paid"))


@REG.add("cross_scalar", f"SELECT o_custkey, {r('avg(o_totalprice) / (SELECT avg(o_totalprice) FROM orders)', 6, 'relative')}, {days('max(o_orderdate)', '(SELECT max(o_orderdate) FROM orders)')} AS recency FROM orders GROUP BY 1")
def _(spark, sf):
    o = Star(spark, sf).raw("orders")
    stats = c.one_row(o.agg(F.avg("o_totalprice").alias("m"), F.max("o_orderdate").alias("ref")))
    per = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("a"), F.max("o_orderdate").alias("last"))
    return per.select("o_custkey", rd(c.ratio("a", stats.getField("m")), "relative", 6), c.elapsed_days("last", stats.getField("ref")).alias("recency"))


# --- aggregates ----------------------------------------------------------------------------------

@REG.add("agg_basic", f"SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, {r('avg(o_totalprice)', 4, 'mean')}, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1")
def _(spark, sf):
    x = "o_totalprice"
    return Star(spark, sf).raw("orders").groupBy("o_custkey").agg(n_(), money(x, "total"), rd(F.avg(x), "mean"), F.min(x).alias("low"), F.max(x).alias("high"))


@REG.add("agg_count_distinct", PRE + "SELECT customer_unique_id, count(DISTINCT order_id) AS orders, count(DISTINCT product_id) AS products FROM itm JOIN ord USING (order_id) GROUP BY 1")
def _(spark, sf):
    s = Star(spark, sf)
    return s.items().join(s.orders(), "order_id").groupBy(P).agg(F.countDistinct("order_id").alias("orders"), F.countDistinct("product_id").alias("products"))


@REG.add("agg_stddev", f"SELECT o_orderpriority, {r('stddev_samp(o_totalprice)', 2, 'sample_std')}, {r('stddev_pop(o_totalprice)', 2, 'population_std')} FROM orders GROUP BY 1")
def _(spark, sf):
    return Star(spark, sf).raw("orders").groupBy("o_orderpriority").agg(rd(F.stddev_samp("o_totalprice"), "sample_std", 2), rd(F.stddev_pop("o_totalprice"), "population_std", 2))


@REG.add("agg_median", f"SELECT o_custkey, {r('median(o_totalprice)', 4, 'median_value')} FROM orders GROUP BY 1")
def _(spark, sf):
    o = Star(spark, sf).raw("orders")
    return os_.grouped_quantiles(o, ["o_custkey"], "o_totalprice", {"median_value": 0.5}).select("o_custkey", *rnd("median_value"))


@REG.add("agg_first", "SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_priority FROM orders GROUP BY 1")
def _(spark, sf):
    return Star(spark, sf).raw("orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("first_priority"))


@REG.add("agg_mode", "SELECT o_custkey, p AS preferred FROM (SELECT o_custkey, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS k FROM orders GROUP BY 1, 2) WHERE k = 1")
def _(spark, sf):
    return ft.most_frequent(Star(spark, sf).raw("orders"), ["o_custkey"], "o_orderpriority", "preferred")


@REG.add("agg_argmax", PRE + ", x AS (SELECT customer_unique_id, brand, count(*) AS n FROM itm JOIN ord USING (order_id) JOIN prod USING (product_id) GROUP BY 1, 2) SELECT customer_unique_id, brand, n FROM (SELECT *, row_number() OVER (PARTITION BY customer_unique_id ORDER BY n DESC, brand) AS k FROM x) WHERE k = 1")
def _(spark, sf):
    s = Star(spark, sf)
    counts = s.items().join(s.orders(), "order_id").join(s.products(), "product_id").groupBy(P, F.col("product_brand").alias("brand")).agg(n_())
    best = counts.groupBy(P).agg(F.min(F.struct((-F.col("n")).alias("m"), "brand")).alias("b"))
    return best.select(P, "b.brand", (-F.col("b.m")).alias("n"))


@REG.add("agg_conditional_ratio", f"SELECT o_custkey, {r('avg(CAST(o_totalprice > 200000 AS INTEGER))', 6, 'large_share')}, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS delivered FROM orders GROUP BY 1")
def _(spark, sf):
    return Star(spark, sf).raw("orders").groupBy("o_custkey").agg(
        rd(F.avg(c.flag(F.col("o_totalprice") > 200000)), "large_share", 6), F.count_if(F.col("o_orderstatus") == "F").alias("delivered"))


@REG.add("agg_mean_nonzero", f"SELECT l_orderkey, coalesce({r('avg(CASE WHEN l_discount <> 0 THEN l_discount END)', 6)}, 0) AS mean_discount FROM lineitem GROUP BY 1")
def _(spark, sf):
    mean = F.coalesce(F.avg(F.when(F.col("l_discount") != 0, F.col("l_discount"))), F.lit(0.0))
    return Star(spark, sf).raw("lineitem").groupBy("l_orderkey").agg(rd(mean, "mean_discount", 6))


@REG.add("agg_cv", f"SELECT o_custkey, {r('stddev_samp(o_totalprice) / nullif(avg(o_totalprice), 0)', 6, 'cv')} FROM orders GROUP BY 1")
def _(spark, sf):
    return Star(spark, sf).raw("orders").groupBy("o_custkey").agg(rd(c.ratio(F.stddev_samp("o_totalprice"), F.avg("o_totalprice")), "cv", 6))


@REG.add("agg_span_days", f"SELECT user_id, {days('min(ts)', 'max(ts)')} AS span_days FROM events GROUP BY 1")
def _(spark, sf):
    return Star(spark, sf).events().groupBy("user_id").agg(c.elapsed_days(F.min("ts"), F.max("ts")).alias("span_days"))


@REG.add("agg_multi_key", "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def _(spark, sf):
    return Star(spark, sf).raw("orders").groupBy(c.month_label("o_orderdate").alias("month"), "o_orderpriority").agg(n_(), money("o_totalprice", "total"))


@REG.add("agg_pivot_count", "SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS F, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS O, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS P FROM orders GROUP BY 1")
def _(spark, sf):
    return Star(spark, sf).raw("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


@REG.add("agg_pivot_value", "SELECT o_orderpriority, " + ", ".join(f"round(sum(CASE WHEN o_orderstatus = '{x}' THEN o_totalprice END), 2) AS {x}" for x in "FOP") + " FROM orders GROUP BY 1")
def _(spark, sf):
    return Star(spark, sf).raw("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.sum("o_totalprice"), 2))


@REG.add("agg_global", f"SELECT count(*) AS orders, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS revenue, {r('avg(o_totalprice)', 4, 'mean_value')}, {r('stddev_samp(o_totalprice)', 2, 'std_value')} FROM orders")
def _(spark, sf):
    return Star(spark, sf).raw("orders").agg(n_("orders"), F.countDistinct("o_custkey").alias("customers"), money("o_totalprice", "revenue"),
                                             rd(F.avg("o_totalprice"), "mean_value"), rd(F.stddev_samp("o_totalprice"), "std_value", 2))


@REG.add("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def _(spark, sf):
    return Star(spark, sf).events().groupBy("event_type").agg(n_()).orderBy(F.desc("n"), "event_type")


@REG.add("agg_percentiles", "SELECT " + ", ".join(r(f"quantile_cont(o_totalprice, {p})", 4, f"p{int(p * 100)}") for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM orders")
def _(spark, sf):
    names = {f"p{int(p * 100)}": p for p in (0.05, 0.25, 0.5, 0.75, 0.95)}
    return os_.quantiles(Star(spark, sf).raw("orders"), "o_totalprice", names).select(*rnd(*names))


@REG.add("agg_percentile_approx", "SELECT quantile_disc(o_totalprice, 0.2) AS p20, quantile_disc(o_totalprice, 0.4) AS p40, quantile_disc(o_totalprice, 0.6) AS p60, quantile_disc(o_totalprice, 0.8) AS p80 FROM orders")
def _(spark, sf):
    edges = Star(spark, sf).raw("orders").agg(F.percentile_approx("o_totalprice", [0.2, 0.4, 0.6, 0.8], 200000).alias("e"))
    return edges.select(*[F.col("e")[i].alias(f"p{20 * (i + 1)}") for i in range(4)])


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]]


@REG.add("agg_corr_matrix", "SELECT " + ", ".join(r(f"corr({a}, {b})", 6, f"{a}__{b}") for a, b in PAIRS) + " FROM lineitem")
def _(spark, sf):
    return Star(spark, sf).raw("lineitem").agg(*[rd(F.corr(a, b), f"{a}__{b}", 6) for a, b in PAIRS])


@REG.add("agg_linear_trend", f"WITH m AS (SELECT o_orderpriority, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS x, count(*) AS y FROM orders GROUP BY 1, 2) SELECT o_orderpriority, {r('regr_slope(y, x)', 6, 'slope')}, {r('regr_intercept(y, x)', 6, 'intercept')} FROM m GROUP BY 1")
def _(spark, sf):
    o = Star(spark, sf).raw("orders")
    x = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    m = o.groupBy("o_orderpriority", x.alias("x")).agg(n_("y"))
    return m.groupBy("o_orderpriority").agg(rd(F.regr_slope("y", "x"), "slope", 6), rd(F.regr_intercept("y", "x"), "intercept", 6))


@REG.add("agg_transform", f"SELECT o_orderkey, {days('min(o_orderdate) OVER (PARTITION BY o_custkey)', 'o_orderdate')} AS days_since_first FROM orders")
def _(spark, sf):
    o = Star(spark, sf).raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    first = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))   # pre-aggregated, unlike a window
    return o.join(first, "o_custkey").select("o_orderkey", c.elapsed_days("first", "o_orderdate").alias("days_since_first"))


@REG.add("histogram", "WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT CAST(least(49, floor((o_totalprice - lo) * 50 / (hi - lo))) AS INTEGER) AS bin, count(*) AS n FROM orders, s GROUP BY 1")
def _(spark, sf):
    return rel.histogram(Star(spark, sf).raw("orders"), "o_totalprice", 50)


# --- windows, ranks, bins ---------------------------------------------------------------------------

@REG.add("lag_gap_days", f"SELECT o_orderkey AS order_id, {days('lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)', 'o_orderdate')} AS gap FROM orders")
def _(spark, sf):
    return ft.order_gaps(Star(spark, sf).orders()).select("order_id", F.col("days_since_last_order").alias("gap"))


@REG.add("order_patterns", PRE + f", g AS (SELECT customer_unique_id, {days('lag(ts) OVER (PARTITION BY customer_unique_id ORDER BY ts, order_id)', 'ts')} AS gap FROM ord) SELECT customer_unique_id, {r('coalesce(avg(gap), 0)', 4, 'order_frequency_days')}, {r('coalesce(stddev_pop(gap), 0)', 4, 'order_frequency_std')}, coalesce(CAST(stddev_pop(gap) < avg(gap) * 0.5 AS INTEGER), 0) AS has_regular_pattern FROM g GROUP BY 1")
def _(spark, sf):
    return ft.order_patterns(Star(spark, sf).orders()).select(P, *rnd("order_frequency_days", "order_frequency_std"), "has_regular_pattern")


@REG.add("qcut_values", "WITH e AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS e FROM orders) SELECT " + value_bin("o_totalprice", "e", ["Low", "Medium", "High", "VIP"]) + " AS tier, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders, e GROUP BY 1")
def _(spark, sf):
    o = Star(spark, sf).raw("orders").select("o_totalprice")
    return os_.qcut_values(o, "o_totalprice", 4, "tier", ["Low", "Medium", "High", "VIP"]).groupBy("tier").agg(n_(), money("o_totalprice", "total"))


@REG.add("qcut_rank", f"WITH x AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS k, count(*) OVER () AS n FROM (SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS INTEGER) AS o_orderpriority FROM orders)) SELECT o_orderkey, {rank_bin('k', 'n', 10)} AS decile FROM x")
def _(spark, sf):
    o = Star(spark, sf).raw("orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("level"))
    return os_.qcut_rank(o, "level", "o_orderkey", 10, "decile").select("o_orderkey", "decile")


@REG.add("cut_fixed", "SELECT CASE WHEN hour(ts) <= 6 THEN 'Night' WHEN hour(ts) <= 12 THEN 'Morning' WHEN hour(ts) <= 18 THEN 'Afternoon' ELSE 'Evening' END AS part, count(*) AS n, count(CASE WHEN hour(ts) > 0 THEN 1 END) AS strict_n FROM events GROUP BY 1")
def _(spark, sf):
    e = Star(spark, sf).events()
    return e.groupBy(ft.time_of_day("ts").alias("part")).agg(n_(), F.count(ft.time_of_day("ts", strict=True)).alias("strict_n"))


@REG.add("pct_change", f"WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders FROM orders GROUP BY 1) SELECT month, orders, {r('(orders - lag(orders) OVER (ORDER BY month)) / nullif(lag(orders) OVER (ORDER BY month), 0) * 100', 4, 'growth')} FROM m")
def _(spark, sf):
    m = Star(spark, sf).raw("orders").groupBy(c.month_label("o_orderdate").alias("month")).agg(n_("orders"))
    return rel.pct_change(m, "month", "orders", "growth").select("month", "orders", *rnd("growth"))


CURVE = """, curve AS (SELECT customer_unique_id, total_revenue, row_number() OVER (ORDER BY total_revenue DESC, customer_unique_id) AS rank,
  sum(CAST(total_revenue AS DECIMAL(28, 4))) OVER (ORDER BY total_revenue DESC, customer_unique_id ROWS UNBOUNDED PRECEDING) AS running,
  sum(CAST(total_revenue AS DECIMAL(28, 4))) OVER () AS total, count(*) OVER () AS n FROM agg)"""


@REG.add("cumulative_share", PRE + CURVE + f" SELECT customer_unique_id, rank, {r('CAST(running AS DOUBLE) / CAST(total AS DOUBLE)', 6, 'cumulative_pct')}, {r('rank / n', 6, 'customer_pct')} FROM curve")
def _(spark, sf):
    feats = staged_features(spark, sf, [P, "total_revenue"])
    return rel.pareto_curve(feats, "total_revenue", P).select(P, "rank", *rnd("cumulative_pct", "customer_pct", digits=6))


@REG.add("cumulative_ltv", "WITH m AS (SELECT o_orderpriority, year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2) SELECT o_orderpriority, y, round(sum(v) OVER (PARTITION BY o_orderpriority ORDER BY y), 2) AS running FROM m")
def _(spark, sf):
    m = Star(spark, sf).raw("orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(money("o_totalprice", "v"))
    return m.select("o_orderpriority", "y", F.round(F.sum("v").over(W.partitionBy("o_orderpriority").orderBy("y")), 2).alias("running"))


@REG.add("topk_per_group", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def _(spark, sf):
    return rel.topk_per_group(Star(spark, sf).raw("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@REG.add("avg_rank", f"WITH d AS (SELECT event_type, rank() OVER (ORDER BY round(value, 0)) + (count(*) OVER (PARTITION BY round(value, 0)) - 1) / 2 AS ar FROM events) SELECT event_type, {r('avg(ar)', 4, 'mean_rank')} FROM d GROUP BY 1")
def _(spark, sf):
    e = Star(spark, sf).events().select("event_type", F.round("value", 0).alias("v"))
    ranks = os_.average_ranks(e, "v")
    counts = e.groupBy("event_type", "v").agg(n_("m")).join(ranks, "v")
    return counts.groupBy("event_type").agg(rd(c.ratio(F.sum(F.col("avg_rank") * F.col("m")), F.sum("m")), "mean_rank"))


@REG.add("last_n_groups", "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders FROM orders GROUP BY 1) SELECT * FROM m WHERE month IN (SELECT month FROM m ORDER BY 1 DESC LIMIT 6)")
def _(spark, sf):
    m = Star(spark, sf).raw("orders").groupBy(c.month_label("o_orderdate").alias("month")).agg(n_("orders"))
    return rel.last_n_groups(m, "month", 6)


# --- sort, limit, sampling, sets -----------------------------------------------------------------------

@REG.add("sort_multi", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY 1 ASC, 3 DESC")
def _(spark, sf):
    return Star(spark, sf).raw("orders").groupBy("o_orderpriority", "o_orderstatus").agg(n_()).orderBy(F.asc("o_orderpriority"), F.desc("n"))


@REG.add("topk_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(spark, sf):
    return Star(spark, sf).raw("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@REG.add("top_share", PRE + CURVE + f" SELECT count(*) AS customers, {r('avg(total_revenue)', 3, 'mean_value')}, round(sum(total_revenue), 2) AS sum_value, {r('sum(total_revenue) / CAST(any_value(total) AS DOUBLE)', 6, 'share_of_total')} FROM curve WHERE rank <= floor(n * 0.2)")
def _(spark, sf):
    feats = staged_features(spark, sf, [P, "total_revenue"])
    return rel.top_share(feats, "total_revenue", P).select("customers", *rnd("mean_value", digits=3), F.round("sum_value", 2).alias("sum_value"), *rnd("share_of_total", digits=6))


@REG.add("sample_rows", "SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|42'), 1, 8) AS BIGINT) / 4294967296.0 < 0.1")
def _(spark, sf):
    return sample_rows(Star(spark, sf).raw("orders"), "o_orderkey", 0.1).select("o_orderkey")


@REG.add("idxmax_row", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def _(spark, sf):
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey")))
    return Star(spark, sf).raw("orders").groupBy("o_orderpriority").agg(best.alias("b")).select("o_orderpriority", "b.o_orderkey", "b.o_totalprice")


@REG.add("every_nth_point", PRE + CURVE + f", pts AS (SELECT DISTINCT CAST(floor(i * (n - 1) / 99) + 1 AS BIGINT) AS rank FROM range(100) t(i), (SELECT count(*) AS n FROM agg)) SELECT rank, {r('CAST(running AS DOUBLE) / CAST(total AS DOUBLE)', 6, 'cumulative_pct')} FROM curve JOIN pts USING (rank)")
def _(spark, sf):
    feats = staged_features(spark, sf, [P, "total_revenue"])
    return rel.every_nth_point(rel.pareto_curve(feats, "total_revenue", P)).select("rank", *rnd("cumulative_pct", digits=6))


@REG.add("union_long", "SELECT 'priority' AS kind, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY 2")
def _(spark, sf):
    o = Star(spark, sf).raw("orders")
    part = lambda kind, col: o.groupBy(F.col(col).alias("label")).agg(n_()).select(F.lit(kind).alias("kind"), "label", "n")
    return part("priority", "o_orderpriority").unionByName(part("status", "o_orderstatus"))


@REG.add("hconcat_positional", PRE + "SELECT customer_unique_id, total_orders, unique_products_purchased FROM agg JOIN upp USING (customer_unique_id)")
def _(spark, sf):
    s = Star(spark, sf)
    orders = ft.order_facts(s.orders(), s.items(), s.payments()).groupBy(P).agg(n_("total_orders"))
    return orders.join(ft.products_per_person(s.orders(), s.items()), P)   # by key: positions mean nothing in Spark


@REG.add("distinct_values", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def _(spark, sf):
    return Star(spark, sf).raw("orders").select("o_custkey", "o_orderpriority").distinct()


# --- scalar functions ----------------------------------------------------------------------------------

@REG.add("scalar_math", f"SELECT o_orderkey, {r('ln(1 + o_totalprice)', 6, 'log1p')}, CAST(ceil(o_totalprice / 90) AS BIGINT) AS ceiling, {r('abs(o_totalprice - 200000)', 2, 'distance')}, {r('exp(-o_totalprice / 100000)', 6, 'decay')}, {r('sqrt(o_totalprice)', 4, 'root')}, {r('pow(1 + 0.1 / 12, o_totalprice / 100000)', 6, 'growth')} FROM orders")
def _(spark, sf):
    x = F.col("o_totalprice")
    return Star(spark, sf).raw("orders").select(
        "o_orderkey", rd(F.log1p(x), "log1p", 6), F.ceil(x / 90).alias("ceiling"), rd(F.abs(x - 200000), "distance", 2),
        rd(F.exp(-x / 100000), "decay", 6), rd(F.sqrt(x), "root"), rd(F.pow(F.lit(1 + 0.1 / 12), x / 100000), "growth", 6))


@REG.add("scalar_date_parts", "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(quarter(ts) AS INTEGER) AS q, CAST(hour(ts) AS INTEGER) AS h, CAST(isodow(ts) - 1 AS INTEGER) AS monday0, CAST(dayofweek(ts) + 1 AS INTEGER) AS sunday1 FROM events")
def _(spark, sf):
    return Star(spark, sf).events().select("event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofmonth("ts").alias("d"),
                                           F.quarter("ts").alias("q"), F.hour("ts").alias("h"), F.weekday("ts").alias("monday0"), F.dayofweek("ts").alias("sunday1"))


@REG.add("scalar_date_diff", PRE + f"SELECT order_id, {days('ts', 'delivered')} AS elapsed, date_diff('day', ts, delivered) AS calendar_days, (year(delivered) - year(ts)) * 12 + month(delivered) - month(ts) AS months FROM ord JOIN dlv USING (order_id)")
def _(spark, sf):
    s = Star(spark, sf)
    done = "order_delivered_customer_date"
    return s.orders().join(s.deliveries(), "order_id").select(
        "order_id", c.elapsed_days(TS, done).alias("elapsed"), c.calendar_days(TS, done).alias("calendar_days"), c.month_index(TS, done).alias("months"))


def _holiday_sql():
    from .customer_features import holiday_sql
    return holiday_sql()


@REG.add("scalar_calendar", f"WITH t AS (SELECT o_orderdate AS ts FROM orders), {_holiday_sql()} SELECT o_orderkey, CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS is_weekend, is_holiday, days_to_holiday, CAST(month(o_orderdate) = 11 AND day(o_orderdate) >= 20 AS INTEGER) AS is_black_friday_period, CAST(month(o_orderdate) = 12 AND day(o_orderdate) <= 25 AS INTEGER) AS is_christmas_period FROM orders JOIN cal ON CAST(o_orderdate AS DATE) = d")
def _(spark, sf):
    o = Star(spark, sf).raw("orders").select("o_orderkey", "o_orderdate")
    return ft.with_calendar(o, "o_orderdate").select("o_orderkey", "is_weekend", "is_holiday", "days_to_holiday", "is_black_friday_period", "is_christmas_period")


@REG.add("scalar_string", "SELECT p_partkey, lower(p_type) AS low, regexp_replace(p_name, '[aeiou]', '', 'g') AS bare, len(string_split(p_name, ' ')) AS words, length(p_name) AS chars, p_brand || '/' || p_type AS joined, substr(p_name, 1, 4) AS head FROM part")
def _(spark, sf):
    return Star(spark, sf).raw("part").select(
        "p_partkey", F.lower("p_type").alias("low"), F.regexp_replace("p_name", "[aeiou]", "").alias("bare"), F.size(F.split("p_name", " ")).cast("long").alias("words"),
        F.length("p_name").cast("long").alias("chars"), F.concat_ws("/", "p_brand", "p_type").alias("joined"), F.substring("p_name", 1, 4).alias("head"))


@REG.add("scalar_array", f"SELECT label, {r('avg(list_sum(list_filter(embedding, lambda x: x > 0)))', 3, 'positive_mass')}, CAST(sum(len(list_filter(embedding, lambda x: x > 0))) AS BIGINT) AS positives FROM embeddings GROUP BY 1")
def _(spark, sf):
    pos = F.filter("embedding", lambda x: x > 0)
    mass = F.aggregate(pos, F.lit(0.0), lambda a, x: a + x)
    return Star(spark, sf).vectors().groupBy("label").agg(rd(F.avg(mass), "positive_mass", 3), F.sum(F.size(pos)).alias("positives"))


@REG.add("scalar_json", "SELECT o_orderkey, '{\"status\":\"' || o_orderstatus || '\",\"key\":{\"order\":' || o_orderkey || ',\"customer\":' || o_custkey || '}}' AS doc FROM orders")
def _(spark, sf):
    doc = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("customer")).alias("key")))
    return Star(spark, sf).raw("orders").select("o_orderkey", doc.alias("doc"))


@REG.add("scalar_conditional", f"SELECT l_orderkey, l_linenumber, l_partkey, {r('coalesce(l_extendedprice / nullif(l_discount, 0), -1)', 3, 'x')}, CASE WHEN l_discount = 0 THEN 'full' ELSE 'reduced' END AS price_kind FROM lineitem")
def _(spark, sf):
    return Star(spark, sf).raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", rd(F.coalesce(c.ratio("l_extendedprice", F.nullif(F.col("l_discount"), F.lit(0.0))), F.lit(-1.0)), "x", 3),
        F.when(F.col("l_discount") == 0, "full").otherwise("reduced").alias("price_kind"))


@REG.add("scalar_normal_cdf", f"WITH z AS (SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER () AS z FROM orders) SELECT o_orderkey, {r(ncdf('z'), 6, 'p')} FROM z")
def _(spark, sf):
    o = Star(spark, sf).raw("orders").select("o_orderkey", "o_totalprice")
    st = c.one_row(o.agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s")))
    return o.select("o_orderkey", rd(normal_cdf((F.col("o_totalprice") - st.getField("m")) / st.getField("s")), "p", 6))
