"""Queries on customer value, profit, retention and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.staging import stage
from ..operators import features as ft
from ..operators import metrics as mt
from ..operators import relational as rel
from ..sources.star import Star
from .prelude import PRE, base_features, days, r, rd, rnd, segmented, staged_features, value_bin
from .registry import REG
from .relational import CURVE

P = ft.PERSON


def valued(spark, sf):
    """Segmented customers with lifetime values, written once because tiers are cut from them."""
    return stage(segmented(spark, sf).withColumn("predictive_clv", F.round(mt.predictive_clv(), 4)), "valued")


def with_reviews(spark, sf, customers):
    s = Star(spark, sf)
    score = (s.orders().join(s.reviews(), "order_id").groupBy(P).agg(F.avg("review_score").alias("avg_review_score")))
    return customers.join(score, P, "left")


def with_trend(spark, sf, customers):
    s = Star(spark, sf)
    return customers.join(mt.value_trend(s.orders(), s.items()), P, "left")


MET = PRE + f""", v0 AS (SELECT rfm.*, round(list_sum(list_transform(range(12), lambda m: avg_order_value * frequency / greatest(customer_lifetime_days / 30, 1)
  * pow(1 - least(recency_days / 365, 1), m) / pow(1 + 0.1 / 12, m))), 4) AS predictive_clv FROM rfm),
te AS (SELECT quantile_cont(predictive_clv, [0.2, 0.4, 0.6, 0.8]) AS te FROM v0),
val AS (SELECT v0.*, {value_bin('predictive_clv', 'te', mt.CLV_TIERS)} AS clv_tier FROM v0, te),
ars AS (SELECT customer_unique_id, avg(review_score) AS avg_review_score FROM ord JOIN rev USING (order_id) GROUP BY 1),
pr0 AS (SELECT val.*, avg_review_score, monetary_value * (CASE avg_review_score WHEN 1 THEN 0.15 WHEN 2 THEN 0.10 WHEN 3 THEN 0.05 WHEN 4 THEN 0.02 WHEN 5 THEN 0.01 ELSE 0.05 END)::DOUBLE * 0.2 AS ret
  FROM val LEFT JOIN ars USING (customer_unique_id)),
pr AS (SELECT *, 50 + frequency * 5 + ret AS total_cost, monetary_value - (50 + frequency * 5 + ret) AS gross_profit FROM pr0),
prof AS (SELECT *, gross_profit / nullif(monetary_value, 0) AS profit_margin, gross_profit / nullif(total_cost, 0) * 100 AS roi FROM pr),
seg AS (SELECT *, CASE WHEN profit_margin <= 0 THEN 'Loss Making' WHEN profit_margin <= 0.1 THEN 'Low Profit' WHEN profit_margin <= 0.2 THEN 'Medium Profit' WHEN profit_margin <= 0.3 THEN 'High Profit' WHEN profit_margin IS NOT NULL THEN 'Very High Profit' END AS profitability_segment FROM prof),
chan AS (SELECT *, CASE WHEN frequency > 3 THEN 'Organic' WHEN avg_order_value > 100 THEN 'Paid Search' WHEN customer_lifetime_days < 30 THEN 'Social Media' ELSE 'Direct' END AS acquisition_channel FROM prof),
vls AS (SELECT customer_unique_id, order_id, epoch_us(ts) AS tm, round(sum(price), 2) AS v FROM ord JOIN itm USING (order_id) GROUP BY ALL),
mid AS (SELECT customer_unique_id, (min(tm) + max(tm)) / 2 AS m FROM vls GROUP BY 1),
tre AS (SELECT customer_unique_id, avg(CASE WHEN tm <= m THEN v END) AS early_value, avg(CASE WHEN tm > m THEN v END) AS late_value FROM vls JOIN mid USING (customer_unique_id) GROUP BY 1),
risk AS (SELECT *, CAST(avg_days_between_orders > 60 AS INTEGER) AS declining_frequency, coalesce(CAST(round(late_value, 4) < round(early_value, 4) AS INTEGER), 0) AS declining_value, coalesce(CAST(avg_review_score < 3 AS INTEGER), 0) AS poor_experience FROM prof LEFT JOIN tre USING (customer_unique_id)),
risked AS (SELECT *, round(declining_frequency * 0.4 + declining_value * 0.3 + poor_experience * 0.3, 4) AS churn_risk_score FROM risk)
"""


@REG.add("clv_historical_simple", PRE + f", m AS (SELECT avg(customer_lifetime_days) / 30 AS m FROM feat) SELECT customer_unique_id, monetary_value AS historical_clv, {r('avg_order_value * (frequency / m * 12)', 3, 'simple_clv')} FROM feat, m")
def _(spark, sf):
    feats = base_features(spark, sf, [P, "monetary_value", "frequency", "avg_order_value", "customer_lifetime_days"])
    return mt.historical_and_simple_clv(feats).select(P, "historical_clv", *rnd("simple_clv", digits=3))


@REG.add("clv_predictive", MET + f"SELECT customer_unique_id, {r('predictive_clv', 3, 'predictive_clv')} FROM v0")
def _(spark, sf):
    feats = base_features(spark, sf, [P, "frequency", "avg_order_value", "customer_lifetime_days", "recency_days"])
    return feats.select(P, rd(F.round(mt.predictive_clv(), 4), "predictive_clv", 3))


@REG.add("clv_segment", MET + f", m AS (SELECT customer_segment, avg(monetary_value) * (avg(frequency) / (avg(customer_lifetime_days) / 30) * 12) AS w FROM rfm GROUP BY 1) SELECT customer_unique_id, customer_segment, {r('w', 2, 'segment_clv')} FROM rfm JOIN m USING (customer_segment)")
def _(spark, sf):
    return mt.segment_clv(segmented(spark, sf)).select(P, "customer_segment", *rnd("segment_clv", digits=2))


@REG.add("clv_tiers", MET + f"SELECT clv_tier, count(*) AS customers, round(sum(predictive_clv), 2) AS total_clv FROM val GROUP BY 1")
def _(spark, sf):
    return mt.clv_tiers(valued(spark, sf)).groupBy("clv_tier").agg(F.count("*").alias("customers"), F.round(F.sum("predictive_clv"), 2).alias("total_clv"))


@REG.add("clv_quartiles", PRE + ", q AS (SELECT quantile_cont(monetary_value, [0.25, 0.5, 0.75]) AS q FROM feat) SELECT customer_unique_id, " + value_bin("monetary_value", "q", ["Low", "Medium", "High", "VIP"]) + " AS clv_tier FROM feat, q")
def _(spark, sf):
    return mt.clv_tiers(staged_features(spark, sf, [P, "monetary_value"]), "monetary_value", mt.TIERS).select(P, "clv_tier")


@REG.add("clv_summary", MET + f"""SELECT 'Total Historical CLV' AS metric, round(sum(monetary_value), 2) AS value FROM val UNION ALL SELECT 'Average Historical CLV', round(avg(monetary_value), 2) FROM val
  UNION ALL SELECT 'Total Predictive CLV', round(sum(predictive_clv), 2) FROM val UNION ALL SELECT 'Average Predictive CLV', round(avg(predictive_clv), 2) FROM val UNION ALL SELECT 'CLV Standard Deviation', round(stddev_samp(predictive_clv), 2) FROM val""")
def _(spark, sf):
    feats = base_features(spark, sf, [P, "monetary_value", "frequency", "avg_order_value", "customer_lifetime_days", "recency_days"])
    out = mt.historical_and_simple_clv(feats).withColumn("predictive_clv", F.round(mt.predictive_clv(), 4))
    return mt.clv_summary(out).select("metric", F.round("value", 2).alias("value"))


@REG.add("profitability", MET + f"SELECT customer_unique_id, {r('total_cost', 3, 'total_cost')}, {r('gross_profit', 3, 'gross_profit')}, {r('profit_margin', 6, 'profit_margin')}, {r('roi', 3, 'roi')}, profitability_segment FROM seg")
def _(spark, sf):
    feats = with_reviews(spark, sf, base_features(spark, sf, [P, "monetary_value", "frequency"]))
    return mt.profitability(feats).select(P, *rnd("total_cost", "gross_profit", "roi", digits=3), *rnd("profit_margin", digits=6), "profitability_segment")


@REG.add("profit_by_segment", MET + f"SELECT customer_segment, round(sum(monetary_value), 2) AS gross_revenue, round(sum(gross_profit), 2) AS gross_profit, {r('avg(profit_margin)', 6, 'profit_margin')}, {r('avg(roi)', 2, 'roi')}, count(*) AS customers FROM prof GROUP BY 1")
def _(spark, sf):
    out = mt.profit_by_segment(mt.profitability(with_reviews(spark, sf, segmented(spark, sf))))
    return out.select("customer_segment", F.round("gross_revenue", 2).alias("gross_revenue"), F.round("gross_profit", 2).alias("gross_profit"),
                      *rnd("profit_margin", digits=6), *rnd("roi", digits=2), "customers")


@REG.add("retention_by_cohort", PRE + f", m AS (SELECT max(last_purchase_date) AS m FROM feat) SELECT strftime(first_purchase_date, '%Y-%m') AS cohort_month, CAST(floor({days('first_purchase_date', 'm')} / 30) AS BIGINT) AS months_since_first_purchase, count(*) AS customers, {r('avg(1 - churned)', 6, 'retention_rate')} FROM feat, m GROUP BY 1, 2")
def _(spark, sf):
    feats = base_features(spark, sf, [P, "first_purchase_date", "last_purchase_date", "churned"])
    return mt.retention_by_cohort(feats).select("cohort_month", "months_since_first_purchase", "customers", *rnd("retention_rate", digits=6))


@REG.add("churn_factors", MET + f"SELECT customer_segment, clv_tier, {r('avg(churned)', 6, 'churn_rate')}, count(*) AS customer_count, round(sum(monetary_value), 2) AS revenue_at_risk FROM val GROUP BY 1, 2")
def _(spark, sf):
    out = mt.churn_factors(mt.clv_tiers(valued(spark, sf)), ["customer_segment", "clv_tier"])
    return out.select("customer_segment", "clv_tier", *rnd("churn_rate", digits=6), "customer_count", F.round("revenue_at_risk", 2).alias("revenue_at_risk"))


@REG.add("churn_drivers", PRE + f", m AS (SELECT median(frequency) AS f, median(monetary_value) AS v FROM feat) SELECT {r('avg(CAST(frequency < f AS INTEGER)) * 100', 4, 'low_frequency')}, {r('avg(CAST(monetary_value < v AS INTEGER)) * 100', 4, 'low_value')}, {r('avg(CAST(frequency = 1 AS INTEGER)) * 100', 4, 'single_purchase')} FROM feat, m WHERE churned = 1")
def _(spark, sf):
    return mt.churn_drivers(staged_features(spark, sf, [P, "frequency", "monetary_value", "churned"])).select(*rnd("low_frequency", "low_value", "single_purchase"))


@REG.add("churn_risk_score", MET + "SELECT customer_unique_id, customer_lifetime_days AS survival_days, churned AS event_observed, declining_frequency, declining_value, poor_experience, CAST(churn_risk_score AS DOUBLE) AS churn_risk_score FROM risked")
def _(spark, sf):
    feats = base_features(spark, sf, [P, "customer_lifetime_days", "churned", "avg_days_between_orders", "avg_order_value", "monetary_value", "frequency"])
    return mt.churn_risk_score(with_trend(spark, sf, with_reviews(spark, sf, feats))).select(
        P, "survival_days", "event_observed", "declining_frequency", "declining_value", "poor_experience", "churn_risk_score")


CAC = "CASE acquisition_channel WHEN 'Organic' THEN 10 WHEN 'Paid Search' THEN 75 WHEN 'Social Media' THEN 35 ELSE 25 END"


@REG.add("channel_performance", MET + f"SELECT acquisition_channel, count(*) AS customers, round(sum(monetary_value), 2) AS total_revenue, {r('avg(monetary_value)', 3, 'avg_revenue')}, {r(f'avg({CAC})', 4, 'avg_cac')}, {r(f'avg({CAC} / greatest(monetary_value / greatest(customer_lifetime_days / 30, 1), 1))', 6, 'payback_months')}, {r('avg(churned)', 6, 'churn_rate')}, {r(f'(sum(monetary_value) - sum({CAC})) / sum({CAC}) * 100', 2, 'roi')} FROM chan GROUP BY 1")
def _(spark, sf):
    feats = base_features(spark, sf, [P, "monetary_value", "frequency", "avg_order_value", "customer_lifetime_days", "churned"])
    return mt.channel_performance(feats).select("acquisition_channel", "customers", F.round("total_revenue", 2).alias("total_revenue"), *rnd("avg_revenue", digits=3),
                                                *rnd("avg_cac"), *rnd("payback_months", "churn_rate", digits=6), *rnd("roi", digits=2))


CAMPAIGN = """SELECT campaign_type, CAST(size AS BIGINT) AS target_audience_size, CAST(rate AS DOUBLE) AS expected_response_rate, uplift AS avg_order_increase, round(size * rate * uplift, 4)::DOUBLE AS expected_revenue_impact FROM (
  SELECT 'Email' AS campaign_type, count(CASE WHEN frequency > 2 AND avg_order_value > 50 THEN 1 END) AS size, 0.15 AS rate, 20 AS uplift FROM rfm
  UNION ALL SELECT 'Discount', (SELECT count(*) FROM pfeat WHERE is_bargain_hunter = 1), 0.25, 15
  UNION ALL SELECT 'Loyalty Program', count(CASE WHEN customer_segment IN ('Champions', 'Loyal Customers') OR frequency > 5 THEN 1 END), 0.35, 50 FROM rfm)"""


def _price_sql():
    from .customer_features import PRICE_SQL
    return PRICE_SQL


@REG.add("campaign_sizing", PRE + _price_sql() + " " + CAMPAIGN)
def _(spark, sf):
    s = Star(spark, sf)
    bargain = ft.price_sensitivity(s.orders(), s.items()).select(P, "is_bargain_hunter")
    out = mt.campaign_sizing(segmented(spark, sf).join(bargain, P, "left"))
    return out.select("campaign_type", "target_audience_size", "expected_response_rate", "avg_order_increase", F.round("expected_revenue_impact", 4).alias("expected_revenue_impact"))


@REG.add("kpi_summary", MET + f"""SELECT count(*) AS total_customers, count(CASE WHEN churned = 0 THEN 1 END) AS active_customers, {r('avg(churned) * 100', 6, 'churn_rate')}, round(sum(monetary_value), 2) AS total_revenue, {r('avg(monetary_value)', 3, 'avg_customer_value')},
  round(sum(predictive_clv), 2) AS total_clv, {r('avg(predictive_clv)', 3, 'avg_clv')}, round(sum(gross_profit), 2) AS total_profit, {r('avg(profit_margin) * 100', 6, 'avg_profit_margin')}, {r('(1 - avg(churned)) * 100', 6, 'retention_rate')} FROM prof""")
def _(spark, sf):
    feats = base_features(spark, sf, [P, "monetary_value", "frequency", "avg_order_value", "customer_lifetime_days", "recency_days", "churned"])
    out = mt.profitability(with_reviews(spark, sf, feats).withColumn("predictive_clv", F.round(mt.predictive_clv(), 4)))
    k = mt.kpi_summary(out)
    return k.select("total_customers", "active_customers", *rnd("churn_rate", "avg_profit_margin", "retention_rate", digits=6),
                    *[F.round(x, 2).alias(x) for x in ("total_revenue", "total_clv", "total_profit")], *rnd("avg_customer_value", "avg_clv", digits=3))


@REG.add("revenue_by_cohort", PRE + f"SELECT strftime(first_purchase_date, '%Y-%m') AS cohort, round(sum(monetary_value), 2) AS revenue, count(*) AS customers, {r('avg(churned)', 6, 'churn_rate')} FROM feat GROUP BY 1")
def _(spark, sf):
    out = mt.revenue_by_cohort(base_features(spark, sf, [P, "first_purchase_date", "monetary_value", "churned"]))
    return out.select("cohort", F.round("revenue", 2).alias("revenue"), "customers", *rnd("churn_rate", digits=6))


@REG.add("monthly_growth", PRE + f""", m AS (SELECT strftime(first_purchase_date, '%Y-%m') AS month, count(*) AS new_customers, round(sum(monetary_value), 2) AS revenue FROM feat GROUP BY 1)
  SELECT *, {r('(new_customers - lag(new_customers) OVER (ORDER BY month)) / lag(new_customers) OVER (ORDER BY month) * 100', 4, 'customer_growth_rate')}, {r('(revenue - lag(revenue) OVER (ORDER BY month)) / lag(revenue) OVER (ORDER BY month) * 100', 4, 'revenue_growth_rate')} FROM m""")
def _(spark, sf):
    out = mt.monthly_growth(base_features(spark, sf, [P, "first_purchase_date", "monetary_value"]))
    return out.select("month", "new_customers", F.round("revenue", 2).alias("revenue"), *rnd("customer_growth_rate", "revenue_growth_rate"))


@REG.add("distributions", MET + """SELECT 'customer_segment' AS dimension, customer_segment AS label, count(*) AS customers FROM seg GROUP BY 2 UNION ALL SELECT 'clv_tier', clv_tier, count(*) FROM seg GROUP BY 2
  UNION ALL SELECT 'profitability_segment', profitability_segment, count(*) FROM seg GROUP BY 2 UNION ALL SELECT 'customer_state', customer_state, count(*) FROM seg GROUP BY 2""")
def _(spark, sf):
    out = mt.profitability(with_reviews(spark, sf, mt.clv_tiers(valued(spark, sf))))
    return mt.distributions(out, ["customer_segment", "clv_tier", "profitability_segment", "customer_state"])


@REG.add("insight_facts", MET + f""", med AS (SELECT median(monetary_value) AS m FROM risked), sg AS (SELECT customer_segment, avg(monetary_value) AS v, avg(churned) AS c FROM risked GROUP BY 1),
  ch AS (SELECT acquisition_channel, avg(roi) AS v FROM chan GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
  SELECT 'vip_customers' AS fact, 'all' AS name, count(*)::DOUBLE AS value FROM risked WHERE clv_tier = 'Very High' UNION ALL SELECT 'vip_customer_share', 'all', {r("avg(CAST(clv_tier = 'Very High' AS INTEGER)) * 100", 3)} FROM risked
  UNION ALL SELECT 'vip_revenue_share', 'all', {r("sum(CASE WHEN clv_tier = 'Very High' THEN monetary_value END) / sum(monetary_value) * 100", 3)} FROM risked UNION ALL SELECT 'vip_projected_clv', 'all', {r("sum(predictive_clv)", 3)} FROM risked WHERE clv_tier = 'Very High'
  UNION ALL SELECT 'risky_customers', 'all', count(*)::DOUBLE FROM risked, med WHERE churn_risk_score > 0.7 AND monetary_value > m UNION ALL SELECT 'risky_revenue', 'all', {r('coalesce(sum(monetary_value), 0)', 3)} FROM risked, med WHERE churn_risk_score > 0.7 AND monetary_value > m
  UNION ALL SELECT 'growth_segment', customer_segment, {r('v', 3)} FROM sg WHERE c < 0.2 AND v > (SELECT median(v) FROM sg) UNION ALL SELECT 'best_channel', acquisition_channel, {r('v', 3)} FROM ch""")
def _(spark, sf):
    table = mt.churn_risk_score(with_trend(spark, sf, mt.profitability(with_reviews(spark, sf, mt.clv_tiers(valued(spark, sf))))))
    return mt.insight_facts(stage(table, "insights")).select("fact", "name", *rnd("value", digits=3))


@REG.add("geo_summary", PRE + f"SELECT customer_state, count(*) AS customer_count, round(sum(monetary_value), 2) AS total_revenue, {r('avg(monetary_value)', 3, 'avg_revenue')}, {r('avg(churned)', 6, 'churn_rate')} FROM feat GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20")
def _(spark, sf):
    out = mt.geo_summary(base_features(spark, sf, [P, "customer_state", "monetary_value", "churned"]))
    return out.select("customer_state", "customer_count", "total_revenue", *rnd("avg_revenue", digits=3), *rnd("churn_rate", digits=6))


@REG.add("segment_summary", PRE + f"SELECT customer_segment, count(*) AS customer_count, round(sum(monetary_value), 2) AS total_revenue, {r('avg(monetary_value)', 3, 'avg_revenue')}, {r('avg(frequency)', 4, 'avg_frequency')}, {r('avg(recency_days)', 4, 'avg_recency')}, {r('sum(monetary_value) / (SELECT sum(monetary_value) FROM rfm)', 6, 'revenue_share')}, {r('avg(monetary_value) / (SELECT avg(monetary_value) FROM rfm)', 6, 'value_vs_average')} FROM rfm GROUP BY 1")
def _(spark, sf):
    out = mt.segment_summary(segmented(spark, sf))
    return out.select("customer_segment", "customer_count", F.round("total_revenue", 2).alias("total_revenue"), *rnd("avg_revenue", digits=3),
                      *rnd("avg_frequency", "avg_recency"), *rnd("revenue_share", "value_vs_average", digits=6))


@REG.add("rf_heatmap", PRE + "SELECT CAST(r_ AS INTEGER) AS R_score, " + ", ".join(r(f"avg(CASE WHEN f_ = {i} THEN monetary_value END)", 3, f"f{i}") for i in range(1, 6)) + " FROM rfm GROUP BY 1")
def _(spark, sf):
    return mt.rf_heatmap(segmented(spark, sf)).select("R_score", *rnd(*[f"f{i}" for i in range(1, 6)], digits=3))


@REG.add("pareto_curve", PRE + CURVE + f", pts AS (SELECT DISTINCT CAST(floor(i * (n - 1) / 99) + 1 AS BIGINT) AS rank FROM range(100) t(i), (SELECT count(*) AS n FROM agg)) SELECT {r('rank / n * 100', 4, 'customer_pct')}, {r('CAST(running AS DOUBLE) / CAST(total AS DOUBLE) * 100', 4, 'cumulative_pct')} FROM curve JOIN pts USING (rank)")
def _(spark, sf):
    curve = rel.pareto_curve(staged_features(spark, sf, [P, "total_revenue"]), "total_revenue", P)
    return rel.every_nth_point(curve).select(rd(F.col("customer_pct") * 100, "customer_pct"), rd(F.col("cumulative_pct") * 100, "cumulative_pct"))


@REG.add("upsell_potential", PRE + f""", q AS (SELECT quantile_cont(monetary_value, 0.25) AS q1, quantile_cont(monetary_value, 0.5) AS q2, quantile_cont(monetary_value, 0.75) AS q3 FROM feat),
  b AS (SELECT CASE WHEN monetary_value <= q1 THEN 'Bottom 25%' WHEN monetary_value <= q3 THEN 'Middle 50%' ELSE 'Top 25%' END AS band, avg(monetary_value) AS a FROM feat, q GROUP BY 1),
  t AS (SELECT band, a, CASE band WHEN 'Bottom 25%' THEN q2 WHEN 'Middle 50%' THEN q3 ELSE a * 1.2 END AS target FROM b, q) SELECT band, {r('a', 3, 'current_avg')}, {r('target', 3, 'target')}, {r('target - a', 3, 'upsell_potential')} FROM t""")
def _(spark, sf):
    return mt.upsell_potential(staged_features(spark, sf, [P, "monetary_value"])).select("band", *rnd("current_avg", "target", "upsell_potential", digits=3))


@REG.add("winback_targets", PRE + f""", m AS (SELECT median(monetary_value) AS m FROM feat WHERE churned = 1) SELECT count(CASE WHEN churned = 1 THEN 1 END) AS churned_customers, {r('avg(churned) * 100', 4, 'churn_rate')}, round(sum(CASE WHEN churned = 1 THEN monetary_value END), 2) AS lost_revenue,
  {r('avg(CASE WHEN churned = 1 THEN monetary_value END)', 3, 'avg_lost_revenue')}, count(CASE WHEN churned = 1 AND monetary_value > m THEN 1 END) AS high_value_lost, count(CASE WHEN churned = 1 AND last_purchase_date > TIMESTAMP '2000-09-01' THEN 1 END) AS recent_churners, count(CASE WHEN churned = 1 AND frequency = 1 THEN 1 END) AS single_purchase_churners FROM feat, m""")
def _(spark, sf):
    out = mt.winback_targets(staged_features(spark, sf, [P, "frequency", "monetary_value", "churned", "last_purchase_date"]), "2000-09-01")
    return out.select("churned_customers", *rnd("churn_rate"), F.round("lost_revenue", 2).alias("lost_revenue"), *rnd("avg_lost_revenue", digits=3), "high_value_lost", "recent_churners", "single_purchase_churners")


@REG.add("purchase_tiers", PRE + f", q AS (SELECT quantile_cont(frequency, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM feat), b AS (SELECT CASE WHEN q[1] < q[2] AND q[2] < q[3] AND q[3] < q[4] AND q[4] < q[5] THEN {value_bin('frequency', 'q[2:4]', mt.TIERS)} ELSE {value_bin('frequency', '[1, 2, 3]', mt.TIERS)} END AS purchase_segment, monetary_value, frequency FROM feat, q) SELECT purchase_segment, count(*) AS customer_count, {r('avg(monetary_value)', 3, 'avg_revenue')}, {r('avg(frequency)', 4, 'avg_orders')} FROM b GROUP BY 1")
def _(spark, sf):
    return mt.purchase_tiers(staged_features(spark, sf, [P, "frequency", "monetary_value"])).select("purchase_segment", "customer_count", *rnd("avg_revenue", digits=3), *rnd("avg_orders"))


@REG.add("segment_ltv", PRE + f"""SELECT customer_segment, {r('avg(monetary_value)', 3, 'monetary_value')}, {r('avg(customer_lifetime_days)', 4, 'lifetime_days')}, {r('avg(frequency)', 4, 'frequency')}, {r('avg(monetary_value) * avg(customer_lifetime_days) / 365', 2, 'predicted_ltv')} FROM rfm GROUP BY 1
  UNION ALL SELECT 'All', {r('avg(avg_order_value)', 3)}, {r('avg(customer_lifetime_days)', 4)}, {r('avg(frequency)', 4)}, {r('avg(avg_order_value) * avg(frequency) * avg(customer_lifetime_days) / 365', 2)} FROM rfm""")
def _(spark, sf):
    return mt.segment_ltv(stage(segmented(spark, sf), "segments")).select("customer_segment", *rnd("monetary_value", digits=3), *rnd("lifetime_days", "frequency"), *rnd("predicted_ltv", digits=2))


@REG.add("intervention_roi", PRE + f""", k AS (SELECT recency_days, monetary_value, row_number() OVER (ORDER BY recency_days DESC, customer_unique_id) AS k FROM feat), t AS (SELECT count(*) AS targeted, min(recency_days) AS lowest_risk, round(sum(monetary_value), 2) AS revenue_targeted FROM k WHERE k <= 333)
  , s AS (SELECT *, CAST(floor(targeted * 0.4 + 1e-9) AS BIGINT) AS saved, (SELECT avg(monetary_value) FROM feat) AS v FROM t)
  SELECT targeted, lowest_risk, revenue_targeted, saved, {r('saved * v', 2, 'revenue_saved')}, {r('(saved * v - targeted * 30.0) / (targeted * 30.0)', 4, 'roi')} FROM s""")
def _(spark, sf):
    out = mt.intervention_roi(staged_features(spark, sf, [P, "recency_days", "monetary_value"]), "recency_days")
    return out.select("targeted", "lowest_risk", F.round("revenue_targeted", 2).alias("revenue_targeted"), "saved", *rnd("revenue_saved", digits=2), *rnd("roi"))


@REG.add("revenue_retention", PRE + f"SELECT round(sum(CASE WHEN churned = 0 THEN monetary_value END), 2) AS active_revenue, {r('sum(CASE WHEN churned = 0 THEN monetary_value END) / sum(monetary_value)', 6, 'revenue_retention')}, {r('1 - avg(churned)', 6, 'customer_retention')} FROM feat")
def _(spark, sf):
    out = mt.revenue_retention(base_features(spark, sf, [P, "monetary_value", "churned"]))
    return out.select(F.round("active_revenue", 2).alias("active_revenue"), *rnd("revenue_retention", "customer_retention", digits=6))
