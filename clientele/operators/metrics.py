"""Business metrics over a customer table (see ``features``): value, profit, retention, marketing, KPIs.

All operators take and return DataFrames. Scalar parameters of a population (means, medians) enter as
scalar subqueries, so nothing is collected on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import (at_least, at_most, cut, elapsed_days, first_match, flag, lookup, month_label, one_row,
                              ratio)
from ..functions.order_stats import qcut_values, quantiles
from .features import PERSON, TS
from .relational import pct_change, running_share

# Expected return rate by review score; anything else counts as 0.05.
RETURN_RATES = {1: 0.15, 2: 0.10, 3: 0.05, 4: 0.02, 5: 0.01}
CLV_TIERS = ["Very Low", "Low", "Medium", "High", "Very High"]
# Acquisition cost per channel.
CHANNEL_COST = {"Organic": 10, "Paid Search": 75, "Social Media": 35, "Direct": 25}
# Expected response rate and order uplift per campaign.
CAMPAIGNS = {"Email": (0.15, 20), "Discount": (0.25, 15), "Loyalty Program": (0.35, 50)}
MONEY = "monetary_value"


def median_of(df: DataFrame, value: str) -> Column:
    return one_row(quantiles(df, value, {"m": 0.5})).getField("m")


# --- lifetime value -----------------------------------------------------------------------------

def historical_and_simple_clv(customers: DataFrame, months: int = 12) -> DataFrame:
    life = one_row(customers.agg((F.avg("customer_lifetime_days") / 30).alias("m"))).getField("m")
    return customers.withColumns({
        "historical_clv": F.col(MONEY),
        "simple_clv": F.col("avg_order_value") * ratio("frequency", life) * months})


def predictive_clv(months: int = 12, discount: float = 0.1) -> Column:
    """Discounted monthly value under a constant survival chance: a geometric series in closed form."""
    monthly = F.col("avg_order_value") * ratio("frequency", at_least(F.col("customer_lifetime_days") / 30, 1.0))
    survival = 1 - at_most(F.col("recency_days") / 365, 1.0)
    q = survival / F.lit(1 + discount / 12)
    return monthly * F.when(q == 1, F.lit(float(months))).otherwise(ratio(1 - F.pow(q, F.lit(months)), 1 - q))


def segment_clv(customers: DataFrame, months: int = 12) -> DataFrame:
    """Each segment's mean value projected and joined back to its members."""
    means = customers.groupBy("customer_segment").agg(
        F.avg(MONEY).alias("_v"), F.avg("frequency").alias("_f"), F.avg("customer_lifetime_days").alias("_d"))
    worth = means.select("customer_segment", (F.col("_v") * ratio("_f", F.col("_d") / 30) * months).alias("segment_clv"))
    return customers.join(worth, "customer_segment", "left")


def clv_tiers(customers: DataFrame, value: str = "predictive_clv", labels: list[str] = CLV_TIERS,
              out: str = "clv_tier") -> DataFrame:
    return qcut_values(customers, value, len(labels), out, labels)


def clv_summary(customers: DataFrame) -> DataFrame:
    one = customers.agg(
        F.sum("historical_clv").alias("Total Historical CLV"), F.avg("historical_clv").alias("Average Historical CLV"),
        F.sum("predictive_clv").alias("Total Predictive CLV"), F.avg("predictive_clv").alias("Average Predictive CLV"),
        F.stddev_samp("predictive_clv").alias("CLV Standard Deviation"))
    return one.unpivot([], one.columns, "metric", "value")


# --- profit -----------------------------------------------------------------------------------

def profitability(customers: DataFrame, acquisition_cost: float = 50.0, service_cost: float = 5.0) -> DataFrame:
    rate = lookup("avg_review_score", RETURN_RATES, 0.05) if "avg_review_score" in customers.columns else F.lit(0.05)
    cost = F.lit(acquisition_cost) + F.col("frequency") * service_cost + F.col("estimated_return_cost")
    out = customers.withColumns({"gross_revenue": F.col(MONEY), "estimated_return_rate": rate})
    out = out.withColumn("estimated_return_cost", F.col("gross_revenue") * F.col("estimated_return_rate") * 0.2)
    out = out.withColumn("total_cost", cost).withColumn("gross_profit", F.col("gross_revenue") - F.col("total_cost"))
    out = out.withColumns({"profit_margin": ratio("gross_profit", "gross_revenue"),
                           "roi": ratio("gross_profit", "total_cost") * 100})
    inf = float("inf")
    return out.withColumn("profitability_segment", cut(
        "profit_margin", [-inf, 0, 0.1, 0.2, 0.3, inf],
        ["Loss Making", "Low Profit", "Medium Profit", "High Profit", "Very High Profit"]))


def profit_by_segment(customers: DataFrame) -> DataFrame:
    return customers.groupBy("customer_segment").agg(
        F.sum("gross_revenue").alias("gross_revenue"), F.sum("gross_profit").alias("gross_profit"),
        F.avg("profit_margin").alias("profit_margin"), F.avg("roi").alias("roi"), F.count("*").alias("customers"))


# --- retention and churn ----------------------------------------------------------------------------

def retention_by_cohort(customers: DataFrame) -> DataFrame:
    """Share still active by first-purchase month and age in 30-day months."""
    ref = one_row(customers.agg(F.max("last_purchase_date").alias("m"))).getField("m")
    age = F.floor(elapsed_days("first_purchase_date", ref) / 30).cast("long")
    return customers.groupBy(month_label("first_purchase_date").alias("cohort_month"), age.alias("months_since_first_purchase")).agg(
        F.count("*").alias("customers"), F.avg(1 - F.col("churned")).alias("retention_rate"))


def churn_factors(customers: DataFrame, keys: list[str]) -> DataFrame:
    return customers.groupBy(*keys).agg(F.avg("churned").alias("churn_rate"), F.count("*").alias("customer_count"),
                                        F.sum(MONEY).alias("revenue_at_risk"))


def churn_drivers(customers: DataFrame) -> DataFrame:
    """Among churned customers: share below the median frequency, below the median value, single buyers."""
    gone = customers.where("churned = 1")
    share = lambda cond: F.avg(flag(cond)) * 100
    return gone.agg(share(F.col("frequency") < median_of(customers, "frequency")).alias("low_frequency"),
                    share(F.col(MONEY) < median_of(customers, MONEY)).alias("low_value"),
                    share(F.col("frequency") == 1).alias("single_purchase"))


def value_trend(orders: DataFrame, items: DataFrame, ts: str = TS) -> DataFrame:
    """Mean order value in the earlier and in the later half of the time between a customer's first and last order."""
    values = items.groupBy("order_id").agg(F.round(F.sum("price"), 2).alias("_value")).join(orders.select("order_id", PERSON, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at")), "order_id")
    middle = values.groupBy(PERSON).agg(((F.min("_at") + F.max("_at")) / 2).alias("_mid"))
    late = F.col("_at") > F.col("_mid")
    return values.join(middle, PERSON).groupBy(PERSON).agg(F.avg(F.when(~late, F.col("_value"))).alias("early_value"), F.avg(F.when(late, F.col("_value"))).alias("late_value"))


def churn_risk_score(customers: DataFrame) -> DataFrame:
    """Weighted flags; ``customers`` may carry ``avg_review_score`` and the columns of ``value_trend``, a flag without them is 0."""
    has = lambda *names: set(names) <= set(customers.columns)
    falling_value = flag(F.round("late_value", 4) < F.round("early_value", 4)) if has("early_value", "late_value") else F.lit(0)
    poor = flag(F.col("avg_review_score") < 3) if has("avg_review_score") else F.lit(0)
    return customers.withColumns({
        "survival_days": F.col("customer_lifetime_days"), "event_observed": F.col("churned"),
        "declining_frequency": flag(F.col("avg_days_between_orders") > 60), "declining_value": falling_value,
        "poor_experience": poor}).withColumn("churn_risk_score", F.round(
            F.col("declining_frequency") * 0.4 + F.col("declining_value") * 0.3 + F.col("poor_experience") * 0.3, 4))


# --- marketing ------------------------------------------------------------------------------------

def with_channel(customers: DataFrame) -> DataFrame:
    channel = first_match([(F.col("frequency") > 3, "Organic"), (F.col("avg_order_value") > 100, "Paid Search"),
                           (F.col("customer_lifetime_days") < 30, "Social Media")], "Direct")
    monthly = ratio(MONEY, at_least(F.col("customer_lifetime_days") / 30, 1.0))
    out = customers.withColumn("acquisition_channel", channel)
    return out.withColumns({"channel_cac": lookup("acquisition_channel", CHANNEL_COST)}).withColumn(
        "cac_payback_months", ratio("channel_cac", at_least(monthly, 1.0)))


def channel_performance(customers: DataFrame) -> DataFrame:
    out = with_channel(customers).groupBy("acquisition_channel").agg(
        F.count("*").alias("customers"), F.sum(MONEY).alias("total_revenue"), F.avg(MONEY).alias("avg_revenue"),
        F.avg("channel_cac").alias("avg_cac"), F.avg("cac_payback_months").alias("payback_months"),
        F.avg("churned").alias("churn_rate"))
    spent = F.col("customers") * F.col("avg_cac")
    return out.withColumn("roi", ratio(F.col("total_revenue") - spent, spent) * 100)


def campaign_sizing(customers: DataFrame) -> DataFrame:
    bargain = flag(F.col("is_bargain_hunter") == 1) if "is_bargain_hunter" in customers.columns else F.lit(0)
    sizes = customers.agg(
        F.sum(flag((F.col("frequency") > 2) & (F.col("avg_order_value") > 50))).alias("Email"),
        F.sum(bargain).alias("Discount"),
        F.sum(flag(F.col("customer_segment").isin("Champions", "Loyal Customers") | (F.col("frequency") > 5))).alias("Loyalty Program"))
    long = sizes.unpivot([], list(CAMPAIGNS), "campaign_type", "target_audience_size")
    out = long.withColumns({
        "expected_response_rate": lookup("campaign_type", {k: v[0] for k, v in CAMPAIGNS.items()}),
        "avg_order_increase": lookup("campaign_type", {k: v[1] for k, v in CAMPAIGNS.items()})})
    return out.withColumn("expected_revenue_impact", F.col("target_audience_size") * F.col("expected_response_rate") * F.col("avg_order_increase"))


# --- dashboards ------------------------------------------------------------------------------------

def kpi_summary(customers: DataFrame) -> DataFrame:
    return customers.agg(
        F.count("*").alias("total_customers"), F.count_if(F.col("churned") == 0).alias("active_customers"),
        (F.avg("churned") * 100).alias("churn_rate"), F.sum(MONEY).alias("total_revenue"),
        F.avg(MONEY).alias("avg_customer_value"), F.sum("predictive_clv").alias("total_clv"),
        F.avg("predictive_clv").alias("avg_clv"), F.sum("gross_profit").alias("total_profit"),
        (F.avg("profit_margin") * 100).alias("avg_profit_margin"), ((1 - F.avg("churned")) * 100).alias("retention_rate"))


def revenue_by_cohort(customers: DataFrame) -> DataFrame:
    return customers.groupBy(month_label("first_purchase_date").alias("cohort")).agg(
        F.sum(MONEY).alias("revenue"), F.count("*").alias("customers"), F.avg("churned").alias("churn_rate"))


def monthly_growth(customers: DataFrame) -> DataFrame:
    months = customers.groupBy(month_label("first_purchase_date").alias("month")).agg(
        F.count("*").alias("new_customers"), F.sum(MONEY).alias("revenue"))
    grown = pct_change(months, "month", "new_customers", "customer_growth_rate")
    return pct_change(grown, "month", "revenue", "revenue_growth_rate")


def distributions(customers: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per value of several label columns, read in one pass."""
    long = customers.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "dimension", "label")
    return long.groupBy("dimension", "label").agg(F.count("*").alias("customers"))


def insight_facts(customers: DataFrame) -> DataFrame:
    """Numbers behind the written insights, as ``(fact, name, value)`` rows."""
    typical = median_of(customers, MONEY)
    vip, risky = F.col("clv_tier") == "Very High", (F.col("churn_risk_score") > 0.7) & (F.col(MONEY) > typical)
    totals = customers.agg(
        F.count_if(vip).cast("double").alias("vip_customers"), (F.avg(flag(vip)) * 100).alias("vip_customer_share"),
        (ratio(F.sum(F.when(vip, F.col(MONEY))), F.sum(MONEY)) * 100).alias("vip_revenue_share"),
        F.sum(F.when(vip, F.col("predictive_clv"))).alias("vip_projected_clv"),
        F.count_if(risky).cast("double").alias("risky_customers"),
        F.coalesce(F.sum(F.when(risky, F.col(MONEY))), F.lit(0.0)).alias("risky_revenue"))
    facts = totals.unpivot([], totals.columns, "fact", "value").select("fact", F.lit("all").alias("name"), "value")
    segments = customers.groupBy("customer_segment").agg(
        F.count("*").alias("n"), F.avg(MONEY).alias("v"), F.avg("churned").alias("c"))
    growth = segments.where((F.col("c") < 0.2) & (F.col("v") > median_of(segments, "v"))).select(
        F.lit("growth_segment").alias("fact"), F.col("customer_segment").alias("name"), F.col("v").alias("value"))
    best = (with_channel(customers).groupBy("acquisition_channel").agg(F.avg("roi").alias("value"))
            .orderBy(F.desc("value"), "acquisition_channel").limit(1)
            .select(F.lit("best_channel").alias("fact"), F.col("acquisition_channel").alias("name"), "value"))
    return facts.unionByName(growth).unionByName(best)


def geo_summary(customers: DataFrame, n: int = 20) -> DataFrame:
    return (customers.groupBy("customer_state").agg(
        F.count("*").alias("customer_count"), F.round(F.sum(MONEY), 2).alias("total_revenue"), F.avg(MONEY).alias("avg_revenue"),
        F.avg("churned").alias("churn_rate")).orderBy(F.desc("total_revenue"), "customer_state").limit(n))


def segment_summary(customers: DataFrame) -> DataFrame:
    whole = one_row(customers.agg(F.sum(MONEY).alias("s"), F.avg(MONEY).alias("m")))
    return customers.groupBy("customer_segment").agg(
        F.count("*").alias("customer_count"), F.sum(MONEY).alias("total_revenue"), F.avg(MONEY).alias("avg_revenue"),
        F.avg("frequency").alias("avg_frequency"), F.avg("recency_days").alias("avg_recency"),
    ).withColumns({"revenue_share": ratio("total_revenue", whole.getField("s")),
                   "value_vs_average": ratio("avg_revenue", whole.getField("m"))})


def rf_heatmap(customers: DataFrame) -> DataFrame:
    """Mean revenue by recency score (rows) and frequency score (columns ``f1``..``f5``)."""
    cells = [F.avg(F.when(F.col("F_score") == i, F.col(MONEY))).alias(f"f{i}") for i in range(1, 6)]
    return customers.groupBy("R_score").agg(*cells)


def upsell_potential(customers: DataFrame) -> DataFrame:
    q = one_row(quantiles(customers, MONEY, {"q1": 0.25, "q2": 0.5, "q3": 0.75}))
    v = F.col(MONEY)
    band = first_match([(v <= q.getField("q1"), "Bottom 25%"), (v <= q.getField("q3"), "Middle 50%")], "Top 25%")
    out = customers.groupBy(band.alias("band")).agg(F.avg(MONEY).alias("current_avg"))
    target = (F.when(F.col("band") == "Bottom 25%", q.getField("q2")).when(F.col("band") == "Middle 50%", q.getField("q3"))
               .otherwise(F.col("current_avg") * 1.2))
    return out.withColumn("target", target).withColumn("upsell_potential", F.col("target") - F.col("current_avg"))


def winback_targets(customers: DataFrame, recent_after: str) -> DataFrame:
    gone = customers.where("churned = 1")
    typical = median_of(gone, MONEY)
    return customers.agg(
        F.count_if(F.col("churned") == 1).alias("churned_customers"), (F.avg("churned") * 100).alias("churn_rate"),
        F.sum(F.when(F.col("churned") == 1, F.col(MONEY))).alias("lost_revenue"),
        F.avg(F.when(F.col("churned") == 1, F.col(MONEY))).alias("avg_lost_revenue"),
        F.count_if((F.col("churned") == 1) & (F.col(MONEY) > typical)).alias("high_value_lost"),
        F.count_if((F.col("churned") == 1) & (F.col("last_purchase_date") > F.lit(recent_after).cast("timestamp"))).alias("recent_churners"),
        F.count_if((F.col("churned") == 1) & (F.col("frequency") == 1)).alias("single_purchase_churners"))


TIERS = ["Low", "Medium", "High", "VIP"]


def purchase_tiers(customers: DataFrame) -> DataFrame:
    """Frequency quartiles; fixed cuts at 1, 2 and 3 orders when the quartile edges coincide."""
    q = one_row(quantiles(customers, "frequency", {"e0": 0.0, "e1": 0.25, "e2": 0.5, "e3": 0.75, "e4": 1.0}))
    e = [q.getField(f"e{i}") for i in range(5)]
    strict = (e[0] < e[1]) & (e[1] < e[2]) & (e[2] < e[3]) & (e[3] < e[4])
    f = F.col("frequency")
    by_quartile = first_match([(f <= e[i + 1], TIERS[i]) for i in range(3)], TIERS[3])
    by_count = first_match([(f <= i + 1, TIERS[i]) for i in range(3)], TIERS[3])
    return customers.groupBy(F.when(strict, by_quartile).otherwise(by_count).alias("purchase_segment")).agg(
        F.count("*").alias("customer_count"), F.avg(MONEY).alias("avg_revenue"), F.avg("frequency").alias("avg_orders"))


def segment_ltv(customers: DataFrame) -> DataFrame:
    """Mean value times mean lifetime in years per segment, with the whole base as segment ``All``."""
    per = customers.groupBy("customer_segment").agg(
        F.avg(MONEY).alias("monetary_value"), F.avg("customer_lifetime_days").alias("lifetime_days"), F.avg("frequency").alias("frequency"))
    per = per.withColumn("predicted_ltv", F.col("monetary_value") * F.col("lifetime_days") / 365)
    whole = customers.agg(
        F.lit("All").alias("customer_segment"), F.avg("avg_order_value").alias("monetary_value"),
        F.avg("customer_lifetime_days").alias("lifetime_days"), F.avg("frequency").alias("frequency"))
    whole = whole.withColumn("predicted_ltv", F.col("monetary_value") * F.col("frequency") * F.col("lifetime_days") / 365)
    return per.unionByName(whole)


def intervention_roi(customers: DataFrame, risk: str, budget: float = 10000.0, cost: float = 30.0, success: float = 0.4) -> DataFrame:
    """Spend a budget on the customers with the highest risk: who is reached, saved, and at what return."""
    reach = int(budget / cost)
    reached = running_share(customers.select(PERSON, risk, MONEY), risk, PERSON).where(F.col("rank") <= reach)
    mean_value = one_row(customers.agg(F.avg(MONEY).alias("m"))).getField("m")
    out = reached.agg(F.count("*").alias("targeted"), F.min(risk).alias("lowest_risk"), F.sum(MONEY).alias("revenue_targeted"))
    out = out.withColumn("saved", F.floor(F.col("targeted") * F.lit(success) + 1e-9).cast("long"))
    out = out.withColumns({"revenue_saved": F.col("saved") * mean_value, "spent": F.col("targeted") * F.lit(cost)})
    return out.withColumn("roi", ratio(F.col("revenue_saved") - F.col("spent"), "spent"))


def model_cost_view(scores: DataFrame, customers: DataFrame, value: float = 200.0, cost: float = 30.0, kept: float = 0.4) -> DataFrame:
    """Net benefit of acting on a model with the given ``precision`` and ``recall`` columns."""
    base = one_row(customers.agg(F.count("*").alias("n"), F.sum("churned").alias("gone")))
    n, gone = base.getField("n"), base.getField("gone")
    whole = lambda x: F.floor(x + 1e-9)   # 99.999... stands for 100
    tp = whole(gone * F.col("recall"))
    fp = whole((n - gone) * (1 - F.col("precision")))
    fn = gone - tp
    return scores.withColumns({
        "true_positives": tp, "false_positives": fp, "false_negatives": fn,
        "net_benefit": tp * kept * value - (tp + fp) * cost - fn * value})


def revenue_retention(customers: DataFrame) -> DataFrame:
    active = F.sum(F.when(F.col("churned") == 0, F.col(MONEY)))
    return customers.agg(active.alias("active_revenue"), ratio(active, F.sum(MONEY)).alias("revenue_retention"),
                         (1 - F.avg("churned")).alias("customer_retention"))
