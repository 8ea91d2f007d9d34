"""Customer feature tables: one row per person.

Grain: payments, items and reviews are aggregated per order before they meet, so an order with
several lines counts its payment once. Money sums and spreads are rounded to cents;
ranks built on them therefore do not depend on summation order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import at_least, cut, elapsed_days, first_match, flag, month_start, one_row, ratio
from ..functions.order_stats import grouped_quantiles, column_quantiles, lag_within, qcut_many, qcut_rank, quantiles

PERSON = "customer_unique_id"
TS = "order_purchase_timestamp"


# --- base table -------------------------------------------------------------------------------

def attach_person(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders carry a per-order customer id; the person behind it comes from the customer table."""
    return orders.join(customers.select("customer_id", PERSON), "customer_id")


def filter_delivered(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("order_status") == "delivered")


def order_facts(orders: DataFrame, items: DataFrame, payments: DataFrame, fanout: bool = False) -> DataFrame:
    """One row per order which has items and payments.

    ``fanout=True`` reproduces the naive item x payment join, which repeats each payment per line.
    """
    lines = items.groupBy("order_id").agg(
        F.count("*").alias("n_items"), F.round(F.sum("price"), 2).alias("items_value"),
        F.round(F.sum("freight_value"), 4).alias("freight_total"))
    paid = payments.groupBy("order_id").agg(F.round(F.sum("payment_value"), 2).alias("payment_value"))
    facts = orders.join(lines, "order_id").join(paid, "order_id")
    if fanout:
        facts = facts.withColumn("payment_value", F.col("payment_value") * F.col("n_items"))
    return facts


def reference_date(orders: DataFrame) -> Column:
    """Last purchase over all orders, delivered or not."""
    return one_row(orders.agg(F.max(TS).alias("ref"))).getField("ref")


def products_per_person(orders: DataFrame, items: DataFrame) -> DataFrame:
    pairs = (items.select("order_id", "product_id").join(orders.select("order_id", PERSON), "order_id")
                  .select(PERSON, "product_id").distinct())
    return pairs.groupBy(PERSON).agg(F.count("*").alias("unique_products_purchased"))


def customer_features(orders: DataFrame, items: DataFrame, payments: DataFrame, customers: DataFrame,
                      ref: Column | None = None, delivered_only: bool = False, fanout: bool = False,
                      parts: tuple[str, ...] = ("median", "products", "home")) -> DataFrame:
    """Orders, revenue, order values and dates per person; ``parts`` adds the median order value, the
    product diversity and the home state and city, each of which costs a shuffle of its own."""
    ref = reference_date(orders) if ref is None else ref
    used = filter_delivered(orders) if delivered_only else orders
    facts = order_facts(used, items, payments, fanout)
    out = facts.groupBy(PERSON).agg(
        F.count("*").alias("total_orders"),
        F.round(F.sum("payment_value"), 2).alias("total_revenue"),
        F.coalesce(F.round(F.stddev_samp("payment_value"), 2), F.lit(0.0)).alias("order_value_std"),
        F.min(TS).alias("first_purchase_date"), F.max(TS).alias("last_purchase_date"),
        F.sum("n_items").alias("total_items"), F.round(F.sum("freight_total"), 4).alias("freight_paid"))
    if "median" in parts:
        out = out.join(grouped_quantiles(facts, [PERSON], "payment_value", {"median_order_value": 0.5}), PERSON)
    if "products" in parts:
        out = out.join(products_per_person(used, items), PERSON)
    if "home" in parts:
        homes = customers.groupBy(PERSON).agg(
            F.min("customer_state").alias("customer_state"), F.min("customer_city").alias("customer_city"))
        out = out.join(homes, PERSON)
    out = rfm_metrics(out, ref).withColumns({
        "avg_order_value": ratio("total_revenue", "total_orders"),
        "avg_freight_value": ratio("freight_paid", "total_items")})
    return out.withColumn("avg_days_between_orders", avg_days_between("per_order"))


def rfm_metrics(features: DataFrame, ref: Column) -> DataFrame:
    return features.withColumns({
        "recency_days": elapsed_days(F.col("last_purchase_date"), ref),
        "frequency": F.col("total_orders"),
        "monetary_value": F.col("total_revenue"),
        "customer_lifetime_days": elapsed_days("first_purchase_date", "last_purchase_date")})


def avg_days_between(policy: str = "per_order") -> Column:
    """``per_order`` divides the lifetime by the orders, ``per_gap`` by the gaps (0 for one order)."""
    if policy == "per_order":
        return ratio("customer_lifetime_days", at_least("total_orders", 1))
    return F.when(F.col("total_orders") > 1,
                  ratio("customer_lifetime_days", F.col("total_orders") - 1)).otherwise(F.lit(0.0))


# --- RFM --------------------------------------------------------------------------------------

def rfm_scores_exact(features: DataFrame) -> DataFrame:
    """Quintile scores 1..5. ``features`` is read several times: pass a staged table."""
    scored = qcut_many(features, {"recency_days": ("R_score", [5, 4, 3, 2, 1]), "monetary_value": ("M_score", [1, 2, 3, 4, 5])})
    by_rank = qcut_rank(features.select(PERSON, "frequency"), "frequency", PERSON, 5, "F_score").drop("frequency")
    return with_rfm_code(scored.join(by_rank, PERSON))


def rfm_scores_ranked(features: DataFrame) -> DataFrame:
    """All three scores from first-come ranks."""
    parts = [qcut_rank(features.select(PERSON, c), c, PERSON, 5, out).drop(c)
             for c, out in (("recency_days", "_r"), ("frequency", "F_score"), ("monetary_value", "M_score"))]
    joined = reduce(lambda a, b: a.join(b, PERSON), parts, features)
    return with_rfm_code(joined.withColumn("R_score", 6 - F.col("_r")).drop("_r"))


def rfm_scores_approx(features: DataFrame, accuracy: int = 10000) -> DataFrame:
    """Scores from ``percentile_approx`` edges, all three edge sets in one aggregate."""
    grid = [0.2, 0.4, 0.6, 0.8]
    edges = features.agg(*[F.percentile_approx(c, grid, accuracy).alias(n) for c, n in
                           (("recency_days", "r"), ("frequency", "f"), ("monetary_value", "m"))])
    e = features.withColumn("_e", one_row(edges))
    r = first_match([(F.col("recency_days") <= F.col("_e.r")[i], 5 - i) for i in range(4)], 1)
    up = lambda c, n: first_match([(F.col(c) >= F.col(f"_e.{n}")[i], i + 2) for i in (3, 2, 1, 0)], 1)
    return with_rfm_code(e.withColumns({"R_score": r, "F_score": up("frequency", "f"),
                                        "M_score": up("monetary_value", "m")}).drop("_e"))


def with_rfm_code(df: DataFrame) -> DataFrame:
    return df.withColumn("RFM_score", F.concat(*[F.col(c).cast("string") for c in ("R_score", "F_score", "M_score")]))


def segment_8() -> Column:
    """Eight named segments; the order of the rules is part of the definition."""
    r, f, m = F.col("R_score"), F.col("F_score"), F.col("M_score")
    return first_match([
        ((r >= 4) & (f >= 4) & (m >= 4), "Champions"),
        ((r >= 3) & (f >= 3) & (m >= 4), "Loyal Customers"),
        ((r >= 3) & (f <= 2) & (m >= 3), "Potential Loyalists"),
        ((r >= 4) & (f <= 2), "New Customers"),
        ((r <= 2) & (f >= 3) & (m >= 3), "At Risk"),
        ((r <= 2) & (f >= 4) & (m >= 4), "Cant Lose Them"),
        ((r <= 2) & (f <= 2) & (m <= 2), "Lost")], "Others")


# Score codes of the ten-segment scheme; the first list which holds a code wins.
SEGMENT_CODES = {
    "Champions": ["555", "554", "544", "545", "454", "455", "445"],
    "Loyal Customers": ["543", "444", "435", "355", "354", "345", "344", "335"],
    "Potential Loyalists": ["553", "551", "552", "541", "542", "533", "532", "531", "452", "451"],
    "New Customers": ["512", "511", "422", "421", "412", "411", "311"],
    "Promising": ["525", "524", "523", "522", "521", "515", "514", "513", "425", "424", "413", "414", "415", "315", "314", "313"],
    "Need Attention": ["535", "534", "443", "434", "343", "334", "325", "324"],
    "Cannot Lose Them": ["155", "154", "144", "214", "215", "115", "114"],
    "Hibernating": ["332", "322", "231", "241", "251", "233", "232", "223", "222", "132", "123", "122", "212", "211"],
    "At Risk": ["155", "154", "144", "214", "215", "115", "114", "113"],
}


def segment_10() -> Column:
    return first_match([(F.col("RFM_score").isin(codes), name) for name, codes in SEGMENT_CODES.items()], "Lost")


# --- churn labels -----------------------------------------------------------------------------

def churn_fixed(days: int = 90) -> Column:
    return flag(F.col("recency_days") > days)


def churn_lifecycle() -> Column:
    gap = F.coalesce("avg_days_between_orders", F.lit(365.0))
    recency, orders = F.col("recency_days"), F.col("total_orders")
    return flag(((gap < 90) & (recency > 180)) | ((gap >= 90) & (orders > 1) & (recency > 365))
                | ((orders == 1) & (recency > 540)))


def churn_velocity() -> Column:
    pace, recency = F.col("orders_per_month"), F.col("recency_days")
    return flag(((pace > 1) & (recency > 90)) | ((pace > 0.5) & (pace <= 1) & (recency > 180))
                | ((pace <= 0.5) & (recency > 365)))


# --- behaviour --------------------------------------------------------------------------------

def behaviour_ratios(features: DataFrame) -> DataFrame:
    quarters = at_least(F.ceil(F.col("customer_lifetime_days") / 90).cast("double"), 1.0)
    diversity = {"products_per_order": ratio("unique_products_purchased", "total_orders"),
                 "product_diversity_score": ratio("unique_products_purchased", at_least("total_orders", 1))}
    return features.withColumns({
        **(diversity if "unique_products_purchased" in features.columns else {}),
        "orders_per_month": ratio("total_orders", at_least(F.col("customer_lifetime_days") / 30.0, 1.0)),
        "value_consistency": ratio("order_value_std", at_least("avg_order_value", 1.0)),
        "customer_value_score": F.log1p("total_revenue") * F.log1p("total_orders"),
        "lifetime_quarters": quarters,
        "avg_revenue_per_quarter": ratio("total_revenue", quarters)})


def engagement_score(features: DataFrame) -> DataFrame:
    """Decile scores blended 0.4 / 0.4 / 0.2. Pass a staged table."""
    parts = [("total_orders", "frequency_score", False), ("total_revenue", "value_score", False),
             ("value_consistency", "consistency_score", True)]
    scores = [qcut_rank(features.select(PERSON, c), c, PERSON, 10, out, desc).drop(c) for c, out, desc in parts]
    joined = reduce(lambda a, b: a.join(b, PERSON), scores, features)
    return joined.withColumn("engagement_score", F.round(
        F.col("frequency_score") * 0.4 + F.col("value_score") * 0.4 + F.col("consistency_score") * 0.2, 4))


def quartile_flags(features: DataFrame, n_states: int = 10) -> DataFrame:
    """Flags against the upper quartile and membership in the most common states."""
    top = (features.groupBy("customer_state").agg(F.count("*").alias("_c"))
                   .orderBy(F.desc("_c"), "customer_state").limit(n_states)
                   .select("customer_state", F.lit(1).alias("is_top_state")))
    out = features.join(top, "customer_state", "left").withColumn("is_top_state", F.coalesce("is_top_state", F.lit(0)))
    names = {"total_revenue": "is_high_value", "total_orders": "is_frequent_buyer", "products_per_order": "is_diverse_buyer"}
    out = out.withColumn("_q", one_row(column_quantiles(features, list(names), {"q3": 0.75})))
    return out.withColumns({name: flag(F.col(c) > F.col(f"_q.{c}_q3")) for c, name in names.items()}).drop("_q")


# --- time patterns ----------------------------------------------------------------------------

def most_frequent(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Most frequent value per group, the smallest on ties; NULLs are ignored."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_best"))
    return best.select(*keys, F.col("_best.v").alias(out))


def order_gaps(orders: DataFrame, key: str = PERSON, ts: str = TS, tie: str = "order_id") -> DataFrame:
    """Days since the key's previous order; the key is the person, not the per-order customer id."""
    lagged = lag_within(orders, key, ts, tie, "previous_order")
    return lagged.withColumn("days_since_last_order", elapsed_days("previous_order", ts))


def order_patterns(orders: DataFrame, key: str = PERSON, ts: str = TS, tie: str = "order_id") -> DataFrame:
    gaps = order_gaps(orders, key, ts, tie).groupBy(key).agg(
        F.avg("days_since_last_order").alias("_mean"), F.stddev_pop("days_since_last_order").alias("_std"))
    zero = F.lit(0.0)
    return gaps.select(key, F.coalesce("_mean", zero).alias("order_frequency_days"),
                       F.coalesce("_std", zero).alias("order_frequency_std"),
                       flag(F.col("_std") < F.col("_mean") * 0.5).alias("has_regular_pattern"))


def purchase_time_patterns(rows: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Gap mean and spread, weekend share, preferred hour and weekday (Sunday = 1)."""
    timed = rows.withColumns({"_hour": F.hour(ts), "_dow": F.dayofweek(ts)})
    gaps = (lag_within(rows.select(key, ts, tie), key, ts, tie, "_p")
            .withColumn("_gap", F.datediff(F.col(ts), F.col("_p"))).groupBy(key).agg(
                F.avg("_gap").alias("avg_days_between_orders_pattern"),
                F.stddev_samp("_gap").alias("std_days_between_orders")))
    share = timed.groupBy(key).agg(F.avg(flag(F.col("_dow").isin(1, 7))).alias("weekend_order_ratio"))
    return (gaps.join(share, key).join(most_frequent(timed, [key], "_hour", "preferred_order_hour"), key)
                .join(most_frequent(timed, [key], "_dow", "preferred_order_day"), key))


def time_of_day(ts, strict: bool = False) -> Column:
    """Right-closed day parts; midnight counts as Night unless ``strict``."""
    return cut(F.hour(ts), [0, 6, 12, 18, 24], ["Night", "Morning", "Afternoon", "Evening"], include_lowest=not strict)


# National holidays of Brazil on fixed dates (month, day).
FIXED_HOLIDAYS = [(1, 1), (4, 21), (5, 1), (9, 7), (10, 12), (11, 2), (11, 15), (12, 25)]


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by the published anonymous rule."""
    div = lambda a, b: F.floor(a / b)
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    rest = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    m = div(a + 11 * h + 22 * rest, 451)
    n = h + rest - 7 * m + 114
    return F.make_date(year, div(n, 31).cast("int"), (n % 31 + 1).cast("int"))


def holidays_of(years: DataFrame) -> DataFrame:
    """Holiday table ``(year, holiday)`` for a table of years: fixed days and Good Friday."""
    y = F.col("year")
    days = [F.make_date(y, F.lit(m), F.lit(d)) for m, d in FIXED_HOLIDAYS] + [F.date_sub(easter_sunday(y), 2)]
    return years.select("year", F.explode(F.array(*days)).alias("holiday"))


def calendar(rows: DataFrame, ts: str) -> DataFrame:
    """One row per calendar day that occurs: holiday flag and distance to the year's nearest holiday."""
    days = rows.select(F.to_date(ts).alias("day")).distinct().withColumn("year", F.year("day"))
    near = days.join(holidays_of(days.select("year").distinct()), "year")
    gap = F.abs(F.datediff("day", "holiday"))
    return near.groupBy("day").agg(F.min(gap).alias("days_to_holiday"),
                                   F.max(flag(gap == 0)).alias("is_holiday"))


def with_calendar(rows: DataFrame, ts: str) -> DataFrame:
    """Calendar columns per row (weekday Monday = 0)."""
    base = rows.withColumns({
        "day": F.to_date(ts), "order_hour": F.hour(ts), "order_day_of_week": F.weekday(ts),
        "order_day": F.dayofmonth(ts), "order_month": F.month(ts), "order_quarter": F.quarter(ts),
        "order_year": F.year(ts), "time_of_day": time_of_day(ts)})
    base = base.withColumns({
        "is_weekend": flag(F.col("order_day_of_week").isin(5, 6)),
        "is_black_friday_period": flag((F.col("order_month") == 11) & (F.col("order_day") >= 20)),
        "is_christmas_period": flag((F.col("order_month") == 12) & (F.col("order_day") <= 25))})
    return base.join(calendar(rows, ts), "day")


def temporal_features(rows: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    timed = with_calendar(rows.select(key, ts, tie), ts)
    stats = timed.groupBy(key).agg(
        F.avg("is_weekend").alias("weekend_order_ratio"), F.avg("order_hour").alias("avg_order_hour"),
        F.stddev_samp("order_hour").alias("order_hour_consistency"), F.avg("is_holiday").alias("holiday_order_ratio"))
    return (stats.join(most_frequent(timed, [key], "time_of_day", "preferred_time_of_day"), key)
                 .join(most_frequent(timed, [key], "order_day_of_week", "preferred_day_of_week"), key)
                 .join(order_patterns(rows, key, ts, tie), key))


# --- categories, delivery, engagement, geography, price -----------------------------------------

# Categories which count as high-value.
HIGH_VALUE_CATEGORIES = ["computers", "electronics", "watches_gifts", "computers_accessories"]


def category_features(orders: DataFrame, items: DataFrame, products: DataFrame,
                      high_value: list[str] = HIGH_VALUE_CATEGORIES,
                      category: str = "product_category_name") -> DataFrame:
    """Favourite category (ties: first name), number of categories and their concentration."""
    lines = (items.select("order_id", "product_id").join(orders.select("order_id", PERSON), "order_id")
                  .join(products.select("product_id", F.col(category).alias("category")), "product_id", "left"))
    counts = lines.where(F.col("category").isNotNull()).groupBy(PERSON, "category").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("category").alias("c")))
    return counts.groupBy(PERSON).agg(
        best.getField("c").alias("favorite_category"), F.count("*").alias("num_categories_purchased"),
        ratio(F.stddev_samp("n"), F.avg("n")).alias("category_concentration"),
    ).withColumn("prefers_high_value_items", flag(F.col("favorite_category").isin(high_value)))


def delivery_columns(orders: DataFrame) -> DataFrame:
    """Per order; a missing date leaves the day counts NULL and the flags 0."""
    delay = elapsed_days("order_estimated_delivery_date", "order_delivered_customer_date")
    return orders.withColumns({
        "actual_delivery_time": elapsed_days(TS, "order_delivered_customer_date"),
        "estimated_delivery_time": elapsed_days(TS, "order_estimated_delivery_date"),
        "delivery_delay": delay, "carrier_delay": elapsed_days(TS, "order_delivered_carrier_date"),
        "on_time_delivery": flag(delay <= 0), "early_delivery": flag(delay < -2), "late_delivery": flag(delay > 2)})


def delivery_features(orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """Orders with delivery dates, one row each, against the order's mean review score."""
    score = reviews.groupBy("order_id").agg(F.avg("review_score").alias("review_score"))
    rows = delivery_columns(orders).join(score, "order_id", "left")
    out = rows.groupBy(PERSON).agg(
        F.avg("actual_delivery_time").alias("avg_delivery_time"),
        F.stddev_samp("actual_delivery_time").alias("delivery_time_variance"),
        F.avg("delivery_delay").alias("avg_delivery_delay"), F.max("delivery_delay").alias("worst_delay"),
        F.min("delivery_delay").alias("best_early_delivery"), F.avg("on_time_delivery").alias("on_time_rate"),
        F.avg("early_delivery").alias("early_delivery_rate"), F.avg("late_delivery").alias("late_delivery_rate"),
        F.avg("review_score").alias("avg_review_score"))
    return out.withColumn("delivery_satisfaction_correlation", first_match([
        ((F.col("avg_delivery_delay") > 3) & (F.col("avg_review_score") < 3), -1),
        ((F.col("on_time_rate") > 0.8) & (F.col("avg_review_score") > 4), 1)], 0))


def review_engagement(orders: DataFrame, reviews: DataFrame) -> DataFrame:
    rows = orders.select("order_id", PERSON).join(reviews, "order_id", "left")
    out = rows.groupBy(PERSON).agg(
        F.count("review_score").alias("total_reviews"), F.avg("review_score").alias("avg_review_score"),
        F.stddev_samp("review_score").alias("review_score_variance"),
        F.count("review_comment_message").alias("reviews_with_comments"),
        F.coalesce(elapsed_days(F.min("review_creation_date"), F.max("review_creation_date")), F.lit(0)).alias("review_span_days"),
        F.count("review_answer_timestamp").alias("reviews_with_seller_response"))
    counts = orders.groupBy(PERSON).agg(F.count("*").alias("_orders"))
    comment = ratio("reviews_with_comments", at_least("total_reviews", 1))
    return out.join(counts, PERSON).withColumns({
        "review_rate": ratio("total_reviews", "_orders"), "comment_rate": comment,
        "is_vocal_customer": flag(comment > 0.5)}).drop("_orders")


def payment_behaviour(orders: DataFrame, payments: DataFrame) -> DataFrame:
    rows = orders.select("order_id", PERSON).join(payments, "order_id")
    stats = rows.groupBy(PERSON).agg(
        F.avg("payment_installments").alias("avg_installments"), F.max("payment_installments").alias("max_installments"),
        F.max("payment_sequential").alias("max_payment_attempts"))
    favourite = most_frequent(rows, [PERSON], "payment_type", "preferred_payment_type")
    return (stats.join(favourite, PERSON, "left")
                 .withColumns({"preferred_payment_type": F.coalesce("preferred_payment_type", F.lit("unknown")),
                               "uses_installments": flag(F.col("avg_installments") > 1)}))


def engagement_features(orders: DataFrame, reviews: DataFrame, payments: DataFrame) -> DataFrame:
    return review_engagement(orders, reviews).join(payment_behaviour(orders, payments), PERSON, "full_outer")


# Brazilian states by region, and the cities which count as major.
REGIONS = {
    "South": ["RS", "SC", "PR"],
    "Southeast": ["SP", "RJ", "MG", "ES"],
    "Northeast": ["BA", "PE", "CE", "MA", "PB", "RN", "AL", "PI", "SE"],
    "North": ["AM", "PA", "AC", "RO", "RR", "AP", "TO"],
    "Center-West": ["MT", "MS", "GO", "DF"],
}
MAJOR_CITIES = ["sao paulo", "rio de janeiro", "brasilia", "salvador", "fortaleza", "belo horizonte",
                "curitiba", "recife", "porto alegre"]


def region_of(state, regions: dict[str, list[str]] = REGIONS) -> Column:
    return first_match([(F.col(state).isin(codes), name) for name, codes in regions.items()], "Unknown")


def geo_features(orders: DataFrame, items: DataFrame, customers: DataFrame, reviews: DataFrame,
                 regions: dict[str, list[str]] = REGIONS, major: list[str] = MAJOR_CITIES) -> DataFrame:
    """Home state and city of each buyer with the statistics of that state and city."""
    score = reviews.groupBy("order_id").agg(F.avg("review_score").alias("_score"), F.lit(1).alias("_has"))
    lines = items.groupBy("order_id").agg(F.sum("price").alias("_sum"), F.sum(F.col("price") * F.col("price")).alias("_sq"),
                                          F.count("*").alias("_n"))
    homes = customers.groupBy(PERSON).agg(F.min("customer_state").alias("customer_state"),
                                          F.min("customer_city").alias("customer_city"))
    facts = orders.select("order_id", PERSON).join(lines, "order_id").join(score, "order_id", "left")
    people = facts.groupBy(PERSON).agg(*[F.sum(c).alias(c) for c in ("_sum", "_sq", "_n", "_score", "_has")]).join(homes, PERSON)
    total = lambda c: F.sum(c)
    mean = ratio(total("_sum"), total("_n"))
    spread = F.sqrt(F.try_divide(total("_sq") - total("_sum") * mean, total("_n") - 1))
    states = people.groupBy("customer_state").agg(
        mean.alias("state_avg_order_value"), spread.alias("state_order_value_std"),
        F.count("*").alias("state_customer_count"), ratio(total("_score"), total("_has")).alias("state_avg_satisfaction"))
    cities = people.groupBy("customer_city").agg(
        F.count("*").alias("city_customer_count"), mean.alias("city_avg_order_value"))
    return (people.select(PERSON, "customer_state", "customer_city")
            .join(states, "customer_state", "left").join(cities, "customer_city", "left")
            .withColumns({"is_major_city": flag(F.lower("customer_city").isin(major)),
                          "region": region_of("customer_state", regions)}))


def price_sensitivity(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Item prices per person; cheap means below the median of all items bought."""
    rows = (items.select("order_id", "price", "freight_value")
                 .join(orders.select("order_id", PERSON), "order_id"))
    cheap = one_row(quantiles(rows, "price", {"m": 0.5})).getField("m")
    out = rows.withColumn("_cheap", flag(F.col("price") < cheap)).groupBy(PERSON).agg(
        F.avg("price").alias("avg_item_price"), F.stddev_samp("price").alias("price_variance"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        F.avg("freight_value").alias("avg_freight_cost"), F.sum("freight_value").alias("total_freight_paid"),
        F.avg("_cheap").alias("discount_purchase_ratio"))
    out = out.join(grouped_quantiles(rows, [PERSON], "price", {"median_price": 0.5}), PERSON)
    relative = ratio("price_variance", at_least("avg_item_price", 1.0))
    return out.withColumns({
        "price_range": F.col("max_price") - F.col("min_price"), "relative_price_variance": relative,
        "freight_ratio": ratio("avg_freight_cost", at_least("avg_item_price", 1.0)),
        "price_sensitivity": cut(relative, [0, 0.2, 0.5, 1.0, float("inf")], ["Very Low", "Low", "Medium", "High"], True),
        "is_bargain_hunter": flag(F.col("discount_purchase_ratio") > 0.7)})


# --- combined -----------------------------------------------------------------------------------

def combine(base: DataFrame, families: list[DataFrame], key: str = PERSON) -> DataFrame:
    """Left-join feature families onto the base table; later duplicates of a column are dropped.

    All sides are grouped by the same key, so Spark reuses that partitioning along the chain.
    """
    out = base
    for fam in families:
        fresh = [c for c in fam.columns if c == key or c not in out.columns]
        out = out.join(fam.select(*fresh), key, "left")
    return out


def feature_table(orders, deliveries, items, payments, customers, reviews, products) -> DataFrame:
    dated = orders.join(deliveries, "order_id")
    return combine(
        behaviour_ratios(customer_features(orders, items, payments, customers)).withColumn("churned", churn_lifecycle()),
        [category_features(orders, items, products), temporal_features(orders, PERSON, TS, "order_id"),
         delivery_features(dated, reviews), engagement_features(orders, reviews, payments),
         geo_features(orders, items, customers, reviews), price_sensitivity(orders, items)])


def feature_summary(features: DataFrame, label: str = "churned") -> DataFrame:
    """Row count, column count and label rate of a feature table."""
    return features.agg(F.count("*").alias("total_customers"), F.avg(label).alias("churn_rate")) \
                   .withColumn("n_features", F.lit(len(features.columns)))


def label_correlations(features: DataFrame, columns: list[str], label: str = "churned", limit: float = 0.5) -> DataFrame:
    """Correlation of each feature with the label, all in one aggregate, and the leakage flag."""
    one = features.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in columns])
    long = one.unpivot([], columns, "feature", "correlation")
    return long.withColumn("flagged", flag(F.abs("correlation") > limit))


def churn_by_score(features: DataFrame, score: str = "engagement_score", label: str = "churned") -> DataFrame:
    """Label rate per score rounded to the nearest integer (x.5 goes up)."""
    return (features.groupBy(F.floor(F.col(score) + 0.5).cast("long").alias("score"))
                    .agg(F.avg(label).alias("churn_rate"), F.count("*").alias("customers"))
                    .where(F.col("score").between(1, 10)))


def customer_month(ts: str = "first_purchase_date") -> Column:
    return F.date_format(month_start(ts), "yyyy-MM")
