"""Queries on customer features, RFM segments and churn labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft
from ..sources.star import Star
from .prelude import PRE, base_features, days, r, rank_bin, rd, rnd, segmented, staged_features
from .registry import REG

P = ft.PERSON
stamp = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)




@REG.add("customer_features", PRE + f"""SELECT customer_unique_id, total_orders, total_revenue, {r('avg_order_value', 4, 'avg_order_value')},
  order_value_std, {r('median_order_value', 4, 'median_order_value')}, unique_products_purchased, customer_state, customer_city,
  strftime(first_purchase_date, '%Y-%m-%d') AS first_purchase_date, strftime(last_purchase_date, '%Y-%m-%d') AS last_purchase_date,
  {r('avg_freight_value', 4, 'avg_freight_value')}, {r('product_diversity_score', 4, 'product_diversity_score')} FROM feat""")
def _(spark, sf):
    return base_features(spark, sf).select(
        P, "total_orders", "total_revenue", *rnd("avg_order_value"), "order_value_std",
        *rnd("median_order_value"), "unique_products_purchased", "customer_state", "customer_city",
        stamp("first_purchase_date"), stamp("last_purchase_date"), *rnd("avg_freight_value", "product_diversity_score"))


@REG.add("rfm_metrics", PRE + """SELECT customer_unique_id, recency_days, frequency, monetary_value, customer_lifetime_days FROM feat""")
def _(spark, sf):
    return base_features(spark, sf, [P, "recency_days", "frequency", "monetary_value", "customer_lifetime_days"])


@REG.add("avg_days_between", PRE + f"""SELECT customer_unique_id, {r('customer_lifetime_days / total_orders', 4, 'per_order')},
  CASE WHEN total_orders > 1 THEN {r('customer_lifetime_days / (total_orders - 1)')} ELSE 0.0 END AS per_gap FROM feat""")
def _(spark, sf):
    return base_features(spark, sf, [P, "customer_lifetime_days", "total_orders"]).select(P, rd(ft.avg_days_between("per_order"), "per_order"),
                                           rd(ft.avg_days_between("per_gap"), "per_gap"))


@REG.add("rfm_scores_exact", PRE + """SELECT customer_unique_id, CAST(r_ AS INTEGER) AS R_score, f_ AS F_score, CAST(m_ AS INTEGER) AS M_score,
  CAST(r_ AS VARCHAR) || CAST(f_ AS VARCHAR) || CAST(m_ AS VARCHAR) AS RFM_score FROM rfm""")
def _(spark, sf):
    return segmented(spark, sf).select(P, "R_score", "F_score", "M_score", "RFM_score")


@REG.add("rfm_scores_approx", PRE + """, e AS (SELECT quantile_disc(recency_days, [0.2, 0.4, 0.6, 0.8]) AS re, quantile_disc(frequency, [0.2, 0.4, 0.6, 0.8]) AS fe,
  quantile_disc(monetary_value, [0.2, 0.4, 0.6, 0.8]) AS me FROM feat)
  SELECT customer_unique_id,
  CASE WHEN recency_days <= re[1] THEN 5 WHEN recency_days <= re[2] THEN 4 WHEN recency_days <= re[3] THEN 3 WHEN recency_days <= re[4] THEN 2 ELSE 1 END AS R_score,
  CASE WHEN frequency >= fe[4] THEN 5 WHEN frequency >= fe[3] THEN 4 WHEN frequency >= fe[2] THEN 3 WHEN frequency >= fe[1] THEN 2 ELSE 1 END AS F_score,
  CASE WHEN monetary_value >= me[4] THEN 5 WHEN monetary_value >= me[3] THEN 4 WHEN monetary_value >= me[2] THEN 3 WHEN monetary_value >= me[1] THEN 2 ELSE 1 END AS M_score FROM feat, e""")
def _(spark, sf):
    feats = staged_features(spark, sf, [P, "recency_days", "frequency", "monetary_value"])
    return ft.rfm_scores_approx(feats).select(P, "R_score", "F_score", "M_score")


@REG.add("rfm_segments_8", PRE + """SELECT customer_segment, count(*) AS customers, round(sum(monetary_value), 2) AS revenue FROM rfm GROUP BY 1""")
def rfm_segments_8(spark, sf):
    return segmented(spark, sf).groupBy("customer_segment").agg(
        F.count("*").alias("customers"), F.round(F.sum("monetary_value"), 2).alias("revenue"))


def codes_sql() -> str:
    arms = " ".join("WHEN code IN (" + ", ".join(f"'{c}'" for c in codes) + f") THEN '{name}'"
                    for name, codes in ft.SEGMENT_CODES.items())
    return f"CASE {arms} ELSE 'Lost' END"


@REG.add("rfm_segments_10", PRE + f""", k AS (SELECT customer_unique_id,
  CAST(6 - {rank_bin('row_number() OVER (ORDER BY recency_days, customer_unique_id)', 'n', 5)} AS VARCHAR)
  || CAST({rank_bin('row_number() OVER (ORDER BY frequency, customer_unique_id)', 'n', 5)} AS VARCHAR)
  || CAST({rank_bin('row_number() OVER (ORDER BY monetary_value, customer_unique_id)', 'n', 5)} AS VARCHAR) AS code FROM feat, edges)
  SELECT customer_unique_id, code AS RFM_score, {codes_sql()} AS RFM_segment FROM k""")
def _(spark, sf):
    feats = staged_features(spark, sf, [P, "recency_days", "frequency", "monetary_value"])
    return ft.rfm_scores_ranked(feats).select(P, "RFM_score", ft.segment_10().alias("RFM_segment"))


@REG.add("churn_fixed90", PRE + "SELECT customer_unique_id, CASE WHEN recency_days > 90 THEN 1 ELSE 0 END AS churned FROM feat")
def _(spark, sf):
    return base_features(spark, sf, [P, "recency_days"]).select(P, ft.churn_fixed(90).alias("churned"))


@REG.add("churn_lifecycle", PRE + "SELECT customer_unique_id, churned FROM feat")
def _(spark, sf):
    return base_features(spark, sf, [P, "churned"])


@REG.add("churn_velocity", PRE + "SELECT customer_unique_id, churned_velocity AS churned FROM feat")
def _(spark, sf):
    return base_features(spark, sf, [P, "orders_per_month", "recency_days"]).select(P, ft.churn_velocity().alias("churned"))


RATIOS = ["orders_per_month", "products_per_order", "value_consistency", "customer_value_score", "lifetime_quarters",
          "product_diversity_score"]


@REG.add("behaviour_ratios", PRE + "SELECT customer_unique_id, " + ", ".join(r(c, 4, c) for c in RATIOS)
         + f", {r('avg_revenue_per_quarter', 3, 'avg_revenue_per_quarter')} FROM feat")
def _(spark, sf):
    return base_features(spark, sf, [P, *RATIOS, "avg_revenue_per_quarter"]).select(P, *rnd(*RATIOS), *rnd("avg_revenue_per_quarter", digits=3))


def decile(order: str) -> str:
    return rank_bin(f"row_number() OVER (ORDER BY {order}, customer_unique_id)", "n", 10)


ENGAGEMENT = f""", eng AS (SELECT feat.*, {decile('total_orders')} AS frequency_score, {decile('total_revenue')} AS value_score,
  {decile('value_consistency DESC')} AS consistency_score FROM feat, edges),
engaged AS (SELECT *, round(frequency_score * 0.4 + value_score * 0.4 + consistency_score * 0.2, 4) AS engagement_score FROM eng)"""


@REG.add("engagement_score", PRE + ENGAGEMENT + """ SELECT customer_unique_id, frequency_score, value_score, consistency_score,
  CAST(engagement_score AS DOUBLE) AS engagement_score FROM engaged""")
def _(spark, sf):
    feats = staged_features(spark, sf, [P, "total_orders", "total_revenue", "value_consistency"])
    return ft.engagement_score(feats).select(P, "frequency_score", "value_score", "consistency_score", "engagement_score")


@REG.add("quartile_flags", PRE + """, q AS (SELECT quantile_cont(total_revenue, 0.75) AS a, quantile_cont(total_orders, 0.75) AS b, quantile_cont(products_per_order, 0.75) AS c FROM feat),
  top AS (SELECT customer_state FROM feat GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)
  SELECT customer_unique_id, CAST(customer_state IN (SELECT customer_state FROM top) AS INTEGER) AS is_top_state,
  CAST(total_revenue > a AS INTEGER) AS is_high_value, CAST(total_orders > b AS INTEGER) AS is_frequent_buyer,
  CAST(products_per_order > c AS INTEGER) AS is_diverse_buyer FROM feat, q""")
def _(spark, sf):
    feats = staged_features(spark, sf, [P, "customer_state", "total_revenue", "total_orders", "products_per_order"])
    return ft.quartile_flags(feats).select(P, "is_top_state", "is_high_value", "is_frequent_buyer", "is_diverse_buyer")


@REG.add("purchase_time_patterns", f"""WITH g AS (SELECT user_id, hour(ts) AS h, dayofweek(ts) + 1 AS d,
  date_diff('day', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM events),
  a AS (SELECT user_id, {r('avg(gap)', 4, 'avg_days_between_orders_pattern')}, {r('stddev_samp(gap)', 4, 'std_days_between_orders')},
    {r('avg(CASE WHEN d IN (1, 7) THEN 1 ELSE 0 END)', 4, 'weekend_order_ratio')} FROM g GROUP BY 1),
  ph AS (SELECT user_id, h, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, h) AS k FROM g GROUP BY 1, 2),
  pd AS (SELECT user_id, d, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, d) AS k FROM g GROUP BY 1, 2)
  SELECT a.*, CAST(h AS INTEGER) AS preferred_order_hour, CAST(d AS INTEGER) AS preferred_order_day
  FROM a JOIN ph ON a.user_id = ph.user_id AND ph.k = 1 JOIN pd ON a.user_id = pd.user_id AND pd.k = 1""")
def _(spark, sf):
    out = ft.purchase_time_patterns(Star(spark, sf).events(), "user_id", "ts", "event_id")
    return out.select("user_id", *rnd("avg_days_between_orders_pattern", "std_days_between_orders", "weekend_order_ratio"),
                      "preferred_order_hour", "preferred_order_day")


@REG.add("category_features", PRE + f""", c AS (SELECT customer_unique_id, category, count(*) AS n FROM itm JOIN ord USING (order_id) JOIN prod USING (product_id) GROUP BY 1, 2),
  b AS (SELECT customer_unique_id, category, row_number() OVER (PARTITION BY customer_unique_id ORDER BY n DESC, category) AS k FROM c),
  g AS (SELECT customer_unique_id, count(*) AS num_categories_purchased, {r('stddev_samp(n) / avg(n)', 4, 'category_concentration')} FROM c GROUP BY 1)
  SELECT g.*, category AS favorite_category, CAST(category IN ('PROMO', 'ECONOMY') AS INTEGER) AS prefers_high_value_items
  FROM g JOIN b ON g.customer_unique_id = b.customer_unique_id AND k = 1""")
def _(spark, sf):
    s = Star(spark, sf)
    return ft.category_features(s.orders(), s.items(), s.products(), ["PROMO", "ECONOMY"]).select(
        P, "num_categories_purchased", *rnd("category_concentration"), "favorite_category", "prefers_high_value_items")


def holiday_sql() -> str:
    fixed = " UNION ALL ".join(f"SELECT y, make_date(y, {m}, {d}) AS holiday FROM yrs" for m, d in ft.FIXED_HOLIDAYS)
    return f"""yrs AS (SELECT DISTINCT CAST(year(ts) AS INTEGER) AS y FROM t),
  e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM yrs),
  e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1),
  e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
  e4 AS (SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n FROM e3),
  hol AS ({fixed} UNION ALL SELECT y, make_date(y, n // 31, n % 31 + 1) - 2 AS holiday FROM e4),
  cal AS (SELECT d, min(abs(date_diff('day', holiday, d))) AS days_to_holiday, max(CAST(holiday = d AS INTEGER)) AS is_holiday
    FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM t) JOIN hol ON year(d) = y GROUP BY 1)"""


DAYPART = """CASE WHEN hour(ts) <= 6 THEN 'Night' WHEN hour(ts) <= 12 THEN 'Morning' WHEN hour(ts) <= 18 THEN 'Afternoon' ELSE 'Evening' END"""
TEMPORAL_SQL = f"""x AS (SELECT t.*, {DAYPART} AS tod, isodow(ts) - 1 AS dow, is_holiday, {days('lag(ts) OVER (PARTITION BY k ORDER BY ts, i)', 'ts')} AS gap
    FROM t JOIN cal ON CAST(ts AS DATE) = d),
  a AS (SELECT k, {r('avg(CASE WHEN dow >= 5 THEN 1 ELSE 0 END)', 4, 'weekend_order_ratio')}, {r('avg(hour(ts))', 4, 'avg_order_hour')},
    {r('stddev_samp(hour(ts))', 4, 'order_hour_consistency')}, {r('avg(is_holiday)', 4, 'holiday_order_ratio')},
    {r('coalesce(avg(gap), 0)', 4, 'order_frequency_days')}, {r('coalesce(stddev_pop(gap), 0)', 4, 'order_frequency_std')},
    coalesce(CAST(stddev_pop(gap) < avg(gap) * 0.5 AS INTEGER), 0) AS has_regular_pattern FROM x GROUP BY 1),
  pt AS (SELECT k, tod, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, tod) AS z FROM x GROUP BY 1, 2),
  pw AS (SELECT k, dow, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, dow) AS z FROM x GROUP BY 1, 2),
  temporal AS (SELECT a.*, tod AS preferred_time_of_day, CAST(dow AS INTEGER) AS preferred_day_of_week
    FROM a JOIN pt ON a.k = pt.k AND pt.z = 1 JOIN pw ON a.k = pw.k AND pw.z = 1)"""
TEMPORAL = ["weekend_order_ratio", "avg_order_hour", "order_hour_consistency", "holiday_order_ratio",
            "order_frequency_days", "order_frequency_std"]


@REG.add("temporal_features", f"WITH t AS (SELECT user_id AS k, event_id AS i, ts FROM events), {holiday_sql()}, {TEMPORAL_SQL} SELECT * RENAME (k AS user_id) FROM temporal")
def _(spark, sf):
    out = ft.temporal_features(Star(spark, sf).events(), "user_id", "ts", "event_id")
    return out.select("user_id", *rnd(*TEMPORAL), "has_regular_pattern", "preferred_time_of_day", "preferred_day_of_week")


DELIVERY_SQL = f""", dl AS (SELECT customer_unique_id, order_id, {days('ts', 'delivered')} AS act, {days('ts', 'est')} AS estd, {days('est', 'delivered')} AS delay,
    {days('ts', 'carrier')} AS car, review_score FROM ord JOIN dlv USING (order_id) LEFT JOIN rev USING (order_id)),
  dfeat AS (SELECT customer_unique_id, {r('avg(act)', 4, 'avg_delivery_time')}, {r('stddev_samp(act)', 4, 'delivery_time_variance')}, {r('avg(delay)', 4, 'avg_delivery_delay')},
    max(delay) AS worst_delay, min(delay) AS best_early_delivery, {r('avg(CAST(delay <= 0 AS INTEGER))', 4, 'on_time_rate')},
    {r('avg(CAST(delay < -2 AS INTEGER))', 4, 'early_delivery_rate')}, {r('avg(CAST(delay > 2 AS INTEGER))', 4, 'late_delivery_rate')}, {r('avg(review_score)', 4, 'avg_review_score')},
    CASE WHEN avg(delay) > 3 AND avg(review_score) < 3 THEN -1 WHEN avg(CAST(delay <= 0 AS INTEGER)) > 0.8 AND avg(review_score) > 4 THEN 1 ELSE 0 END AS delivery_satisfaction_correlation
    FROM dl GROUP BY 1)"""
DELIVERY = ["avg_delivery_time", "delivery_time_variance", "avg_delivery_delay", "on_time_rate", "early_delivery_rate",
            "late_delivery_rate", "avg_review_score"]


@REG.add("delivery_features", PRE + DELIVERY_SQL + " SELECT * FROM dfeat")
def _(spark, sf):
    s = Star(spark, sf)
    out = ft.delivery_features(s.orders().join(s.deliveries(), "order_id"), s.reviews())
    return out.select(P, *rnd(*DELIVERY), "worst_delay", "best_early_delivery", "delivery_satisfaction_correlation")


ENGAGE_SQL = f""", rv AS (SELECT customer_unique_id, count(review_score) AS total_reviews, avg(review_score) AS ars, stddev_samp(review_score) AS rsv,
    count(review_comment_message) AS reviews_with_comments, coalesce({days('min(review_creation_date)', 'max(review_creation_date)')}, 0) AS review_span_days,
    count(review_answer_timestamp) AS reviews_with_seller_response, count(DISTINCT ord.order_id) AS no_ FROM ord LEFT JOIN rev USING (order_id) GROUP BY 1),
  pm AS (SELECT customer_unique_id, avg(payment_installments) AS ai, max(payment_installments) AS max_installments, max(payment_sequential) AS max_payment_attempts FROM ord GROUP BY 1),
  pt0 AS (SELECT customer_unique_id, payment_type, row_number() OVER (PARTITION BY customer_unique_id ORDER BY count(*) DESC, payment_type) AS z FROM ord GROUP BY 1, 2),
  efeat AS (SELECT customer_unique_id, total_reviews, {r('ars', 4, 'avg_review_score')}, {r('rsv', 4, 'review_score_variance')}, reviews_with_comments, review_span_days, reviews_with_seller_response,
    {r('total_reviews / no_', 4, 'review_rate')}, {r('reviews_with_comments / greatest(total_reviews, 1)', 4, 'comment_rate')},
    CAST(reviews_with_comments / greatest(total_reviews, 1) > 0.5 AS INTEGER) AS is_vocal_customer, payment_type AS preferred_payment_type,
    {r('ai', 4, 'avg_installments')}, max_installments, max_payment_attempts, CAST(ai > 1 AS INTEGER) AS uses_installments
    FROM rv JOIN pm USING (customer_unique_id) JOIN (SELECT * FROM pt0 WHERE z = 1) USING (customer_unique_id))"""


@REG.add("engagement_features", PRE + ENGAGE_SQL + " SELECT * FROM efeat")
def _(spark, sf):
    s = Star(spark, sf)
    out = ft.engagement_features(s.orders(), s.reviews(), s.payments())
    return out.select(P, "total_reviews", *rnd("avg_review_score", "review_score_variance"), "reviews_with_comments",
                      "review_span_days", "reviews_with_seller_response", *rnd("review_rate", "comment_rate"), "is_vocal_customer",
                      "preferred_payment_type", *rnd("avg_installments"), "max_installments", "max_payment_attempts", "uses_installments")


# Stand-in regions and cities for the star schema's nations and market segments.
STAR_REGIONS = {"South": ["NATION_0", "NATION_1", "NATION_2", "NATION_3"], "North": ["NATION_4", "NATION_5", "NATION_6", "NATION_7"]}
STAR_CITIES = ["machinery", "building"]
GEO_SQL = f""", gl AS (SELECT customer_unique_id, customer_state, customer_city, price, order_id FROM itm JOIN ord USING (order_id) JOIN cust USING (customer_unique_id)),
  gs AS (SELECT customer_state, {r('avg(price)', 3, 'state_avg_order_value')}, {r('stddev_samp(price)', 2, 'state_order_value_std')}, count(DISTINCT customer_unique_id) AS state_customer_count FROM gl GROUP BY 1),
  gr AS (SELECT customer_state, {r('avg(review_score)', 4, 'state_avg_satisfaction')} FROM (SELECT DISTINCT customer_state, order_id FROM gl) JOIN rev USING (order_id) GROUP BY 1),
  gc AS (SELECT customer_city, count(DISTINCT customer_unique_id) AS city_customer_count, {r('avg(price)', 3, 'city_avg_order_value')} FROM gl GROUP BY 1),
  gfeat AS (SELECT DISTINCT customer_unique_id, customer_state, customer_city, state_avg_order_value, state_order_value_std, state_customer_count, state_avg_satisfaction,
    city_customer_count, city_avg_order_value, CAST(lower(customer_city) IN ('machinery', 'building') AS INTEGER) AS is_major_city,
    CASE WHEN customer_state IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3') THEN 'South' WHEN customer_state IN ('NATION_4', 'NATION_5', 'NATION_6', 'NATION_7') THEN 'North' ELSE 'Unknown' END AS region
    FROM gl JOIN gs USING (customer_state) JOIN gr USING (customer_state) JOIN gc USING (customer_city))"""


@REG.add("geo_features", PRE + GEO_SQL + " SELECT * FROM gfeat")
def _(spark, sf):
    s = Star(spark, sf)
    out = ft.geo_features(s.orders(), s.items(), s.customers(), s.reviews(), STAR_REGIONS, STAR_CITIES)
    return out.select(P, "customer_state", "customer_city", *rnd("state_avg_order_value", "city_avg_order_value", digits=3),
                      *rnd("state_order_value_std", digits=2), *rnd("state_avg_satisfaction"),
                      "state_customer_count", "city_customer_count", "is_major_city", "region")


PRICE_SQL = f""", pl AS (SELECT customer_unique_id, price, freight_value FROM itm JOIN ord USING (order_id)),
  pmed AS (SELECT median(price) AS m FROM pl),
  p0 AS (SELECT customer_unique_id, avg(price) AS a, stddev_samp(price) AS s, min(price) AS min_price, max(price) AS max_price, median(price) AS med,
    avg(freight_value) AS fa, sum(freight_value) AS fs, avg(CAST(price < m AS INTEGER)) AS d FROM pl, pmed GROUP BY 1),
  pfeat AS (SELECT customer_unique_id, {r('a', 4, 'avg_item_price')}, {r('s', 3, 'price_variance')}, min_price, max_price, {r('med', 4, 'median_price')}, {r('fa', 4, 'avg_freight_cost')},
    {r('fs', 4, 'total_freight_paid')}, {r('max_price - min_price', 2, 'price_range')}, {r('s / greatest(a, 1)', 4, 'relative_price_variance')}, {r('fa / greatest(a, 1)', 4, 'freight_ratio')},
    CASE WHEN s / greatest(a, 1) <= 0.2 THEN 'Very Low' WHEN s / greatest(a, 1) <= 0.5 THEN 'Low' WHEN s / greatest(a, 1) <= 1 THEN 'Medium' WHEN s IS NOT NULL THEN 'High' END AS price_sensitivity,
    {r('d', 4, 'discount_purchase_ratio')}, CAST(d > 0.7 AS INTEGER) AS is_bargain_hunter FROM p0)"""
PRICE = ["avg_item_price", "median_price", "avg_freight_cost", "total_freight_paid", "relative_price_variance",
         "freight_ratio", "discount_purchase_ratio"]


@REG.add("price_sensitivity", PRE + PRICE_SQL + " SELECT * FROM pfeat")
def _(spark, sf):
    s = Star(spark, sf)
    return ft.price_sensitivity(s.orders(), s.items()).select(
        P, *rnd(*PRICE), *rnd("price_variance", digits=3), "min_price", "max_price", *rnd("price_range", digits=2),
        "price_sensitivity", "is_bargain_hunter")


TABLE_SQL = (f"SELECT feat.customer_unique_id, total_orders, total_revenue, recency_days, churned, favorite_category, has_regular_pattern, preferred_day_of_week, "
             "late_delivery_rate, total_reviews, preferred_payment_type, region, state_customer_count, price_sensitivity, median_price FROM feat "
             "LEFT JOIN (SELECT DISTINCT ON (customer_unique_id) customer_unique_id, category AS favorite_category FROM (SELECT customer_unique_id, category, count(*) AS n FROM itm JOIN ord USING (order_id) JOIN prod USING (product_id) GROUP BY 1, 2) ORDER BY customer_unique_id, n DESC, category) USING (customer_unique_id) "
             "LEFT JOIN (SELECT * RENAME (k AS customer_unique_id) FROM temporal) USING (customer_unique_id) LEFT JOIN (SELECT customer_unique_id, late_delivery_rate FROM dfeat) USING (customer_unique_id) "
             "LEFT JOIN (SELECT customer_unique_id, total_reviews, preferred_payment_type FROM efeat) USING (customer_unique_id) LEFT JOIN (SELECT customer_unique_id, 'Unknown' AS region, state_customer_count FROM gfeat) USING (customer_unique_id) "
             "LEFT JOIN (SELECT customer_unique_id, price_sensitivity, median_price FROM pfeat) USING (customer_unique_id)")


@REG.add("feature_table", PRE + DELIVERY_SQL + ENGAGE_SQL + GEO_SQL + PRICE_SQL
         + f", t AS (SELECT customer_unique_id AS k, order_id AS i, ts FROM ord), {holiday_sql()}, {TEMPORAL_SQL} " + TABLE_SQL)
def _(spark, sf):
    s = Star(spark, sf)
    out = ft.feature_table(s.orders(), s.deliveries(), s.items(), s.payments(), s.customers(), s.reviews(), s.products())
    return out.select(P, "total_orders", "total_revenue", "recency_days", "churned", "favorite_category", "has_regular_pattern",
                      "preferred_day_of_week", *rnd("late_delivery_rate"), "total_reviews", "preferred_payment_type", "region",
                      "state_customer_count", "price_sensitivity", *rnd("median_price"))


@REG.add("feature_summary", PRE + f"SELECT count(*) AS total_customers, {r('avg(churned)', 6, 'churn_rate')} FROM feat")
def _(spark, sf):
    out = ft.feature_summary(base_features(spark, sf))
    return out.select("total_customers", *rnd("churn_rate", digits=6))


SCREENED = ["total_orders", "total_revenue", "avg_order_value", "order_value_std", "customer_lifetime_days",
            "orders_per_month", "recency_days", "products_per_order"]


@REG.add("leakage_screen", PRE + ", c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, churned_velocity) AS v FROM feat" for c in SCREENED)
         + ") SELECT feature, round(v, 6) AS correlation, CAST(abs(v) > 0.5 AS INTEGER) AS flagged FROM c")
def _(spark, sf):
    feats = base_features(spark, sf, SCREENED).withColumn("churned", ft.churn_velocity())
    return ft.label_correlations(feats, SCREENED).select("feature", *rnd("correlation", digits=6), "flagged")


@REG.add("churn_by_score", PRE + ENGAGEMENT + f""" SELECT CAST(floor(engagement_score + 0.5) AS BIGINT) AS score, {r('avg(churned)', 6, 'churn_rate')}, count(*) AS customers
  FROM engaged WHERE floor(engagement_score + 0.5) BETWEEN 1 AND 10 GROUP BY 1""")
def _(spark, sf):
    feats = staged_features(spark, sf, [P, "total_orders", "total_revenue", "value_consistency", "churned"])
    return ft.churn_by_score(ft.engagement_score(feats)).select("score", *rnd("churn_rate", digits=6), "customers")
