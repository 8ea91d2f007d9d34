"""Queries on cohorts and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.staging import stage
from ..operators import cohorts as co
from ..operators import experiments as ex
from ..operators import features as ft
from ..operators import relational as rel
from ..sources.star import Star
from .prelude import PRE, base_features, ncdf, r, rnd
from .registry import REG

P = ft.PERSON


def base(spark, sf):
    """Orders with their item value."""
    s = Star(spark, sf)
    lines = s.items().groupBy("order_id").agg(F.round(F.sum("price"), 2).alias("items_value"))
    orders = s.orders().select("order_id", P, ft.TS).join(lines, "order_id").join(s.customers().select(P, "customer_state"), P)
    return co.cohort_base(orders)


COH = PRE + """, fp AS (SELECT customer_unique_id, min(ts) AS fpd FROM fact GROUP BY 1),
cb AS (SELECT fact.*, customer_state, strftime(fpd, '%Y-%m') AS cohort_month, strftime(ts, '%Y-%m') AS order_month,
  (year(ts) - year(fpd)) * 12 + month(ts) - month(fpd) AS cohort_index FROM fact JOIN fp USING (customer_unique_id) JOIN cust USING (customer_unique_id)),
cell AS (SELECT cohort_month, cohort_index, count(DISTINCT customer_unique_id) AS customers, count(*) AS orders, round(sum(items_value), 2) AS revenue FROM cb GROUP BY 1, 2),
mat AS (SELECT *, max(CASE WHEN cohort_index = 0 THEN customers END) OVER w AS c0, max(CASE WHEN cohort_index = 0 THEN orders END) OVER w AS o0,
  max(CASE WHEN cohort_index = 0 THEN revenue END) OVER w AS r0 FROM cell WINDOW w AS (PARTITION BY cohort_month)),
ret AS (SELECT cohort_month, cohort_index, customers / c0 * 100 AS retention FROM mat),
qual0 AS (SELECT cohort_month, count(DISTINCT customer_unique_id) AS cohort_size, count(*) AS total_orders, round(sum(items_value), 2) AS total_revenue, max(cohort_index) AS cohort_age,
  count(DISTINCT CASE WHEN cohort_index = 3 THEN customer_unique_id END) AS k3 FROM cb GROUP BY 1),
qual1 AS (SELECT *, nullif(k3, 0) / cohort_size * 100 AS retention_3m, total_orders / cohort_size AS opc, total_revenue / cohort_size AS rpc FROM qual0),
qual AS (SELECT *, rpc / avg(rpc) OVER () * 0.4 + opc / avg(opc) OVER () * 0.3 + coalesce(retention_3m, 0) / avg(retention_3m) OVER () * 0.3 AS quality_score FROM qual1)
"""


def ltv_sql(months: int) -> str:
    return f""", lc AS (SELECT cohort_month, cohort_index, customers / c0 AS kept, revenue / c0 AS money, (revenue / r0) / (customers / c0) AS ratio FROM mat),
  obs AS (SELECT max(cohort_index) AS last FROM lc), dec AS (SELECT -ln(avg(kept)) / (any_value(last) + 1) AS decay FROM lc, obs WHERE cohort_index = last),
  mm AS (SELECT cohort_month, avg(money) AS mean_money, avg(ratio) AS mean_ratio FROM lc GROUP BY 1),
  gr AS (SELECT mm.*, m AS month FROM mm, range({months}) t(m)),
  st AS (SELECT gr.cohort_month, month, CASE WHEN month <= last THEN coalesce(money, 0) ELSE mean_money * exp(-decay * month) END AS v,
    CASE WHEN month <= last THEN coalesce(ratio, 0) ELSE mean_ratio * exp(-decay * month) END AS q
    FROM gr LEFT JOIN lc ON gr.cohort_month = lc.cohort_month AND gr.month = lc.cohort_index, obs, dec),
  cv AS (SELECT cohort_month, month, sum(v) OVER w AS ltv, sum(q) OVER w AS ltv_ratio FROM st WINDOW w AS (PARTITION BY cohort_month ORDER BY month)),
  ltv AS (SELECT cohort_month, max(CASE WHEN month = 5 THEN ltv END) AS ltv_6m, max(CASE WHEN month = 11 THEN ltv END) AS ltv_12m, max(CASE WHEN month = {months - 1} THEN ltv END) AS ltv_end,
    max(CASE WHEN month = {months - 1} THEN ltv_ratio END) AS ltv_ratio_end, min(CASE WHEN ltv > 200000 THEN month END) AS months_to_payback FROM cv GROUP BY 1)"""


@REG.add("cohort_base", COH + "SELECT order_id, cohort_month, order_month, cohort_index FROM cb")
def _(spark, sf):
    return base(spark, sf).select("order_id", "cohort_month", "order_month", "cohort_index")


def _matrix(metric: str, first: str) -> None:
    @REG.add(f"cohort_retention_{metric}", COH + f"SELECT cohort_month, cohort_index, {metric} AS value, {r(f'{metric} / {first} * 100', 4, 'retention')} FROM mat")
    def _(spark, sf):
        return co.cohort_matrix(base(spark, sf), metric).select("cohort_month", "cohort_index", "value", *rnd("retention"))


for _m, _f in (("customers", "c0"), ("revenue", "r0"), ("orders", "o0")):
    _matrix(_m, _f)


@REG.add("cohort_retention_last_seen", PRE + f""", c AS (SELECT strftime(first_purchase_date, '%Y-%m') AS cohort_month, (year(last_purchase_date) - year(first_purchase_date)) * 12 + month(last_purchase_date) - month(first_purchase_date) AS cohort_index, count(*) AS value FROM feat GROUP BY 1, 2)
  SELECT *, {r('value / max(CASE WHEN cohort_index = 0 THEN value END) OVER (PARTITION BY cohort_month) * 100', 4, 'retention')} FROM c""")
def _(spark, sf):
    feats = base_features(spark, sf, [P, "first_purchase_date", "last_purchase_date"])
    return co.cohort_matrix_from_features(feats).select("cohort_month", "cohort_index", "value", *rnd("retention"))


CALENDAR = range(80)             # months that the test tables' orders span, from 1995-01 to 2001-08


@REG.add("cohort_retention_wide", COH + "SELECT cohort_month, " + ", ".join(r(f"max(CASE WHEN cohort_index = {i} THEN retention END)", 4, f"m{i}") for i in CALENDAR) + " FROM ret GROUP BY 1")
def _(spark, sf):
    return co.wide(co.cohort_matrix(base(spark, sf)), list(CALENDAR)).select("cohort_month", *rnd(*[f"m{i}" for i in CALENDAR]))


@REG.add("cohort_quality", COH + f"""SELECT cohort_month, cohort_size, total_orders, total_revenue, cohort_age, {r('total_revenue / total_orders', 3, 'avg_order_value')}, {r('opc', 4, 'orders_per_customer')}, {r('rpc', 3, 'revenue_per_customer')}, {r('retention_3m', 4, 'retention_3m')}, {r('quality_score', 6, 'quality_score')},
  CASE WHEN quality_score <= 0.8 THEN 'Below Average' WHEN quality_score <= 1.2 THEN 'Average' ELSE 'Above Average' END AS cohort_quality FROM qual""")
def _(spark, sf):
    q = co.cohort_quality(stage(base(spark, sf), "cohort"))
    return q.select("cohort_month", "cohort_size", "total_orders", "total_revenue", "cohort_age", *rnd("avg_order_value", "revenue_per_customer", digits=3),
                    *rnd("orders_per_customer", "retention_3m"), *rnd("quality_score", digits=6), "cohort_quality")


def _ltv(name: str, months: int) -> None:
    @REG.add(name, COH + ltv_sql(months) + f" SELECT cohort_month, {r('ltv_6m', 2, 'ltv_6m')}, {r('ltv_12m', 2, 'ltv_12m')}, {r('ltv_end', 2, 'ltv_end')}, {r('ltv_ratio_end', 5, 'ltv_ratio_end')}, months_to_payback FROM ltv")
    def _(spark, sf):
        return co.cohort_ltv(stage(base(spark, sf), "cohort"), months, cac=200000.0).select(
            "cohort_month", *rnd("ltv_6m", "ltv_12m", "ltv_end", digits=2), *rnd("ltv_ratio_end", digits=5), "months_to_payback")


_ltv("cohort_ltv", 24)
_ltv("cohort_ltv_projected", 96)


@REG.add("cohort_by_segment", COH + f""", sc AS (SELECT customer_state, cohort_month, cohort_index, count(DISTINCT customer_unique_id) AS v FROM cb GROUP BY 1, 2, 3),
  sr AS (SELECT *, v / max(CASE WHEN cohort_index = 0 THEN v END) OVER (PARTITION BY customer_state, cohort_month) * 100 AS ret FROM sc)
  SELECT customer_state AS segment, cohort_index AS period, {r('avg(ret)', 4, 'avg_retention')} FROM sr WHERE cohort_index IN (0, 1, 3, 6, 12) GROUP BY 1, 2""")
def _(spark, sf):
    return co.cohort_by_segment(base(spark, sf), "customer_state").select("segment", "period", *rnd("avg_retention"))


@REG.add("cohort_forecast", COH + f""", rc AS (SELECT DISTINCT cohort_month FROM ret ORDER BY 1 DESC LIMIT 12), cu AS (SELECT cohort_index, avg(retention) AS m, stddev_samp(retention) AS sd FROM ret SEMI JOIN rc USING (cohort_month) WHERE cohort_index < 12 GROUP BY 1),
  xx AS (SELECT cohort_index, retention, row_number() OVER (PARTITION BY cohort_index ORDER BY cohort_month) - 1 AS x FROM ret WHERE cohort_index < 6), tr AS (SELECT cohort_index, CASE WHEN count(*) > 3 THEN regr_slope(retention, x) END AS s FROM xx GROUP BY 1)
  SELECT CAST(f AS INTEGER) AS future_month, cohort_index AS period, {r('CASE WHEN s IS NULL THEN m ELSE greatest(0, least(100, m + s * f)) END', 4, 'predicted_retention')}, {r('sd', 4, 'confidence_band')} FROM cu LEFT JOIN tr USING (cohort_index), range(1, 4) t(f)""")
def _(spark, sf):
    matrix = stage(co.cohort_matrix(base(spark, sf)), "matrix")
    return co.cohort_forecast(matrix).select("future_month", "period", *rnd("predicted_retention", "confidence_band"))


@REG.add("cohort_summary", COH + ltv_sql(24) + f""" SELECT count(DISTINCT cohort_month) AS total_cohorts, {", ".join(r(f"avg(CASE WHEN cohort_index = {i} THEN retention END)", 4, f"avg_retention_month_{i}") for i in (1, 3, 6))},
  (SELECT cohort_month FROM qual ORDER BY quality_score DESC, cohort_month DESC LIMIT 1) AS best_cohort, (SELECT {r('avg(ltv_12m)', 2)} FROM ltv) AS avg_ltv_12m FROM ret""")
def _(spark, sf):
    out = co.cohort_summary(stage(base(spark, sf), "cohort"))
    return out.select("total_cohorts", *rnd(*[f"avg_retention_month_{i}" for i in (1, 3, 6)]), "best_cohort", *rnd("avg_ltv_12m", digits=2))


@REG.add("retention_curve_stats", COH + f""", s AS (SELECT cohort_index AS period, avg(retention) AS m, stddev_samp(retention) AS sd FROM ret GROUP BY 1) SELECT period, {r('m', 4, 'mean_retention')}, {r('sd', 4, 'std_retention')}, {r('coalesce(m - lag(m) OVER (ORDER BY period), 100)', 4, 'change')} FROM s""")
def _(spark, sf):
    return co.retention_curve_stats(co.cohort_matrix(base(spark, sf))).select("period", *rnd("mean_retention", "std_retention", "change"))


# --- experiments ------------------------------------------------------------------------------------

def ab_users(spark, sf):
    """One row per user of the event log, with a stand-in assignment."""
    e = Star(spark, sf).events()
    buy = F.col("event_type") == "purchase"
    return e.groupBy("user_id").agg(
        F.max(F.when(buy & (F.col("value") > 50), 1).otherwise(0)).alias("converted"),
        F.coalesce(F.round(F.sum(F.when(buy, F.col("value"))), 2), F.lit(0.0)).alias("revenue"),
        F.count_if(F.col("event_type") == "click").cast("double").alias("clicks"), F.to_date(F.min("ts")).alias("enrolled"),
    ).withColumn("variant", F.when(F.pmod("user_id", F.lit(2)) == 0, ex.CONTROL).otherwise(ex.TREATMENT))


AB = """WITH u AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant, max(CASE WHEN event_type = 'purchase' AND value > 50 THEN 1 ELSE 0 END) AS converted,
  coalesce(round(sum(CASE WHEN event_type = 'purchase' THEN value END), 2), 0) AS revenue, count(CASE WHEN event_type = 'click' THEN 1 END)::DOUBLE AS clicks, CAST(min(ts) AS DATE) AS enrolled FROM events GROUP BY 1),
k AS (SELECT count(CASE WHEN variant = 'control' THEN 1 END) AS n_c, CAST(sum(CASE WHEN variant = 'control' THEN converted END) AS BIGINT) AS x_c, count(CASE WHEN variant = 'treatment' THEN 1 END) AS n_t, CAST(sum(CASE WHEN variant = 'treatment' THEN converted END) AS BIGINT) AS x_t FROM u)"""
Z_SQL = "(x_t / n_t - x_c / n_c) / sqrt((x_c + x_t) / (n_c + n_t) * (1 - (x_c + x_t) / (n_c + n_t)) * (1 / n_c + 1 / n_t))"
P_SQL = lambda z: f"(2.0 * (1.0 - {ncdf(f'abs({z})')}))"
CI = lambda x, n, sign: f"{x} / {n} {sign} 1.96 * sqrt({x} / {n} * (1 - {x} / {n}) / {n})"


@REG.add("ab_conversion", AB + f""", z AS (SELECT *, {Z_SQL} AS z FROM k) SELECT n_c, x_c, n_t, x_t, {r('x_c / n_c', 6, 'control_rate')}, {r('x_t / n_t', 6, 'treatment_rate')}, {r('x_t / n_t - x_c / n_c', 6, 'absolute_lift')}, {r('(x_t / n_t - x_c / n_c) / (x_c / n_c)', 6, 'relative_lift')}, {r('z', 6, 'z_statistic')}, {r(P_SQL('z'), 6, 'p_value')},
  {r(CI('x_c', 'n_c', '-'), 6, 'control_ci_low')}, {r(CI('x_c', 'n_c', '+'), 6, 'control_ci_high')}, {r(CI('x_t', 'n_t', '-'), 6, 'treatment_ci_low')}, {r(CI('x_t', 'n_t', '+'), 6, 'treatment_ci_high')}, CAST({P_SQL('z')} < 0.05 AS INTEGER) AS is_significant FROM z""")
def _(spark, sf):
    out = ex.conversion_test(ex.conversion_counts(ab_users(spark, sf)))
    return out.select("n_c", "x_c", "n_t", "x_t", *rnd("control_rate", "treatment_rate", "absolute_lift", "relative_lift", "z_statistic", "p_value", "control_ci_low",
                                                      "control_ci_high", "treatment_ci_low", "treatment_ci_high", digits=6), "is_significant")


@REG.add("ab_chi2", AB + f""", o AS (SELECT x_c::DOUBLE AS a, (n_c - x_c)::DOUBLE AS b, x_t::DOUBLE AS c, (n_t - x_t)::DOUBLE AS d, (n_c + n_t)::DOUBLE AS n FROM k),
  e AS (SELECT *, (a + b) * (a + c) / n AS ea, (a + b) * (b + d) / n AS eb, (c + d) * (a + c) / n AS ec, (c + d) * (b + d) / n AS ed FROM o),
  x AS (SELECT pow(abs(a - ea) - least(0.5, abs(a - ea)), 2) / ea + pow(abs(b - eb) - least(0.5, abs(b - eb)), 2) / eb + pow(abs(c - ec) - least(0.5, abs(c - ec)), 2) / ec + pow(abs(d - ed) - least(0.5, abs(d - ed)), 2) / ed AS chi2 FROM e)
  SELECT {r('chi2', 6, 'chi2')}, {r(P_SQL('sqrt(chi2)'), 6, 'p_value')} FROM x""")
def _(spark, sf):
    return ex.chi_square(ex.conversion_counts(ab_users(spark, sf))).select(*rnd("chi2", "p_value", digits=6))


@REG.add("ab_bayes", AB + f""", b AS (SELECT x_c + 1 AS ac, n_c - x_c + 1 AS bc, x_t + 1 AS at_, n_t - x_t + 1 AS bt FROM k), m AS (SELECT ac / (ac + bc) AS mc, ac * bc / (pow(ac + bc, 2) * (ac + bc + 1)) AS vc, at_ / (at_ + bt) AS mt, at_ * bt / (pow(at_ + bt, 2) * (at_ + bt + 1)) AS vt FROM b)
  SELECT {r(ncdf('((mt - mc) / sqrt(vc + vt))'), 6, 'prob_treatment_better')} FROM m""")
def _(spark, sf):
    return ex.prob_treatment_better(ex.conversion_counts(ab_users(spark, sf))).select(*rnd("prob_treatment_better", digits=6))


def mean_sql(value: str, tag: str) -> str:
    return f""", {tag}q AS (SELECT variant, quantile_cont({value}, 0.01) AS lo, quantile_cont({value}, 0.99) AS hi, median({value}) AS med FROM u GROUP BY 1),
  {tag}w AS (SELECT u.variant, {value} AS v FROM u JOIN {tag}q ON u.variant = {tag}q.variant WHERE {value} > lo AND {value} < hi),
  {tag}s AS (SELECT count(CASE WHEN variant = 'control' THEN 1 END) AS n_c, avg(CASE WHEN variant = 'control' THEN v END) AS mean_c, var_samp(CASE WHEN variant = 'control' THEN v END) AS var_c,
    count(CASE WHEN variant = 'treatment' THEN 1 END) AS n_t, avg(CASE WHEN variant = 'treatment' THEN v END) AS mean_t, var_samp(CASE WHEN variant = 'treatment' THEN v END) AS var_t FROM {tag}w),
  {tag}p AS (SELECT *, sqrt(((n_c - 1) * var_c + (n_t - 1) * var_t) / (n_c + n_t - 2)) AS sp FROM {tag}s),
  {tag}t AS (SELECT *, (mean_t - mean_c) / (sp * sqrt(1 / n_c + 1 / n_t)) AS t FROM {tag}p)"""


@REG.add("winsor_filter", AB + mean_sql("revenue", "rv") + " SELECT variant, count(*) AS n, round(sum(v), 2) AS total FROM rvw GROUP BY 1")
def _(spark, sf):
    return rel.winsor_filter(ab_users(spark, sf), "variant", "revenue").groupBy("variant").agg(F.count("*").alias("n"), F.round(F.sum("revenue"), 2).alias("total"))


MEANS = ["mean_c", "mean_t", "absolute_lift", "relative_lift", "cohens_d", "t_statistic", "p_value"]


@REG.add("ab_revenue_ttest", AB + mean_sql("revenue", "rv") + f""" SELECT n_c, n_t, {r('mean_c', 5, 'mean_c')}, {r('mean_t', 5, 'mean_t')}, {r('mean_t - mean_c', 5, 'absolute_lift')}, {r('(mean_t - mean_c) / mean_c', 5, 'relative_lift')}, {r('(mean_t - mean_c) / sp', 5, 'cohens_d')}, {r('t', 5, 't_statistic')}, {r(P_SQL('t'), 5, 'p_value')},
  (SELECT med FROM rvq WHERE variant = 'control') AS control_median, (SELECT med FROM rvq WHERE variant = 'treatment') AS treatment_median FROM rvt""")
def _(spark, sf):
    return ex.mean_test(ab_users(spark, sf)).select("n_c", "n_t", *rnd(*MEANS, digits=5), "control_median", "treatment_median")


@REG.add("ab_mann_whitney", AB + f""", rk AS (SELECT variant, revenue, rank() OVER (ORDER BY revenue) + (count(*) OVER (PARTITION BY revenue) - 1) / 2 AS ar FROM u), tie AS (SELECT sum(pow(n, 3) - n) AS t FROM (SELECT count(*) AS n FROM u GROUP BY revenue)),
  s AS (SELECT count(CASE WHEN variant = 'treatment' THEN 1 END)::DOUBLE AS n1, count(CASE WHEN variant = 'control' THEN 1 END)::DOUBLE AS n2, sum(CASE WHEN variant = 'treatment' THEN ar END) AS r1 FROM rk), u1 AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM s),
  z AS (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u1, tie) SELECT CAST(n1 AS BIGINT) AS n_treatment, CAST(n2 AS BIGINT) AS n_control, u AS u_statistic, {r('least(1.0, ' + P_SQL('greatest(z, 0)') + ')', 6, 'p_value')} FROM z""")
def _(spark, sf):
    return ex.mann_whitney(ab_users(spark, sf)).select("n_treatment", "n_control", "u_statistic", *rnd("p_value", digits=6))


U52 = "(CAST('0x' || substr(md5(user_id || '|' || rep), 1, 13) AS BIGINT) / 4503599627370496.0)"
DIFF = " - ".join(f"sum(CASE WHEN variant = '{a}' THEN w * revenue END) / nullif(sum(CASE WHEN variant = '{a}' THEN w END), 0)" for a in ("treatment", "control"))


@REG.add("ab_bootstrap_ci", AB + f""", q AS (SELECT variant, quantile_cont(revenue, 0.01) AS lo, quantile_cont(revenue, 0.99) AS hi FROM u GROUP BY 1),
  dr AS (SELECT variant, revenue, CAST(rep AS INTEGER) AS rep, user_id FROM u JOIN q USING (variant), range(1, 1001) t(rep) WHERE revenue > lo AND revenue < hi),
  dw AS (SELECT variant, revenue, rep, len(list_filter({ex.poisson_steps()}, lambda s: s <= {U52})) AS w FROM dr),
  df AS (SELECT rep, {DIFF} AS diff FROM dw GROUP BY 1)
  SELECT {r('quantile_cont(diff, 0.025)', 6, 'ci_low')}, {r('quantile_cont(diff, 0.975)', 6, 'ci_high')}, {r('avg(diff)', 6, 'mean_difference')}, count(diff) AS replicates FROM df""")
def _(spark, sf):
    return ex.bootstrap_ci(stage(ab_users(spark, sf), "users"), "user_id").select(*rnd("ci_low", "ci_high", "mean_difference", digits=6), "replicates")


def _sequential(spending: str, spent: str) -> None:
    @REG.add("ab_sequential" if spending == "obrien_fleming" else f"ab_sequential_{spending}", AB + f""", d AS (SELECT enrolled, count(CASE WHEN variant = 'control' THEN 1 END) AS nc, coalesce(sum(CASE WHEN variant = 'control' THEN converted END), 0) AS xc, count(CASE WHEN variant = 'treatment' THEN 1 END) AS nt, coalesce(sum(CASE WHEN variant = 'treatment' THEN converted END), 0) AS xt FROM u GROUP BY 1),
  c AS (SELECT enrolled, CAST(sum(nc) OVER w AS BIGINT) AS n_c, CAST(sum(xc) OVER w AS BIGINT) AS x_c, CAST(sum(nt) OVER w AS BIGINT) AS n_t, CAST(sum(xt) OVER w AS BIGINT) AS x_t FROM d WINDOW w AS (ORDER BY enrolled)),
  z AS (SELECT *, CASE WHEN n_c > 0 AND n_t > 0 AND x_c + x_t > 0 AND x_c + x_t < n_c + n_t THEN {Z_SQL} END AS z, (n_c + n_t) / 200 AS f FROM c)
  SELECT strftime(enrolled, '%Y-%m-%d') AS enrolled, n_c, n_t, {r('f', 6, 'information_fraction')}, {r(P_SQL('z'), 6, 'p_value')}, {r(spent, 6, 'adjusted_alpha')}, coalesce(CAST({P_SQL('z')} < {spent} AS INTEGER), 0) AS can_stop_early FROM z""")
    def _(spark, sf):
        out = ex.sequential(ab_users(spark, sf), "enrolled", 200, spending)
        return out.select(F.date_format("enrolled", "yyyy-MM-dd").alias("enrolled"), "n_c", "n_t", *rnd("information_fraction", "p_value", "adjusted_alpha", digits=6), "can_stop_early")


_sequential("obrien_fleming", f"(2 * (1 - {ncdf('(1.959963984540054 / sqrt(f))')}))")
_sequential("pocock", "(0.05 * ln(1 + (exp(1) - 1) * f))")


@REG.add("ab_multi_metric", AB + mean_sql("revenue", "rv") + mean_sql("clicks", "ck") + f""", z AS (SELECT *, {Z_SQL} AS z FROM k),
  m AS (SELECT 'converted' AS metric, {P_SQL('z')} AS p FROM z UNION ALL SELECT 'revenue', {P_SQL('t')} FROM rvt UNION ALL SELECT 'clicks', {P_SQL('t')} FROM ckt),
  rk AS (SELECT *, row_number() OVER (ORDER BY p, metric) AS k, count(*) OVER () AS n FROM m), l AS (SELECT max(CASE WHEN p <= 0.05 * k / n THEN k END) AS last FROM rk)
  SELECT metric, {r('p', 6, 'p_value')}, n AS num_metrics, CAST(p < 0.05 AS INTEGER) AS is_significant, CAST(p < 0.05 / n AS INTEGER) AS bonferroni_significant, coalesce(CAST(k <= last AS INTEGER), 0) AS fdr_significant FROM rk, l""")
def _(spark, sf):
    out = ex.multi_metric(stage(ab_users(spark, sf), "users"), ["converted"], ["revenue", "clicks"])
    return out.select("metric", *rnd("p_value", digits=6), "num_metrics", "is_significant", "bonferroni_significant", "fdr_significant")


Z0 = "1.959963984540054"
POWER = lambda e: f"({ncdf(f'({e} * sqrt(n_c) - {Z0})')} + {ncdf(f'(-{e} * sqrt(n_c) - {Z0})')})"


@REG.add("ab_observed_power", AB + mean_sql("revenue", "rv") + f""", z AS (SELECT *, {Z_SQL} AS z, abs((x_t / n_t - x_c / n_c) / (x_c / n_c)) AS e FROM k), t AS (SELECT *, abs((mean_t - mean_c) / sp) AS e FROM rvt)
  SELECT 'converted' AS metric, {r(POWER('e'), 6, 'power_at_effect')}, CASE WHEN {P_SQL('z')} < 0.05 THEN {r(POWER('e'), 6)} END AS observed_power FROM z UNION ALL SELECT 'revenue', {r(POWER('e'), 6)}, CASE WHEN {P_SQL('t')} < 0.05 THEN {r(POWER('e'), 6)} END FROM t""")
def _(spark, sf):
    users = stage(ab_users(spark, sf), "users")
    a = ex.with_power(ex.conversion_test(ex.conversion_counts(users)), "relative_lift").withColumn("metric", F.lit("converted"))
    b = ex.with_power(ex.mean_test(users), "cohens_d").withColumn("metric", F.lit("revenue"))
    cols = ["metric", *rnd("power_at_effect", "observed_power", digits=6)]
    return a.select(*cols).unionByName(b.select(*cols))
