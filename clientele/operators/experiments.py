"""Experiment readouts on a user table ``(user, variant, converted, <metrics>)``.

Each test reduces the users to a handful of sums in one aggregate; the statistics are expressions on that
one row. p-values use the normal limit (large samples).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.core import first_match, flag, one_row, ratio
from ..functions.order_stats import average_ranks, grouped_quantiles
from ..functions.sampling import unit_hash_52
from ..functions.probability import normal_cdf, normal_quantile, two_sided_p
from .relational import winsor_filter

Z95 = 1.96
ALPHA = 0.05
CONTROL, TREATMENT = "control", "treatment"


def _arm(agg, value, arm: str) -> Column:
    return agg(F.when(F.col("variant") == arm, value))


def conversion_counts(users: DataFrame) -> DataFrame:
    one = F.lit(1)
    return users.agg(*[e for arm, s in ((CONTROL, "c"), (TREATMENT, "t")) for e in (
        _arm(F.count, one, arm).alias(f"n_{s}"), F.coalesce(_arm(F.sum, F.col("converted"), arm), F.lit(0)).alias(f"x_{s}"))])


def pooled_z() -> Column:
    pool = ratio(F.col("x_c") + F.col("x_t"), F.col("n_c") + F.col("n_t"))
    se = F.sqrt(pool * (1 - pool) * (ratio(F.lit(1), "n_c") + ratio(F.lit(1), "n_t")))
    return ratio(ratio("x_t", "n_t") - ratio("x_c", "n_c"), se)


def conversion_test(counts: DataFrame) -> DataFrame:
    """Rates, lift, pooled z-test and per-arm intervals from one row of counts (works on many rows too)."""
    pc, pt = ratio("x_c", "n_c"), ratio("x_t", "n_t")
    out = counts.withColumns({"control_rate": pc, "treatment_rate": pt, "absolute_lift": pt - pc,
                              "relative_lift": ratio(pt - pc, pc), "z_statistic": pooled_z()})
    half = lambda p, n: F.sqrt(F.col(p) * (1 - F.col(p)) / F.nullif(F.col(n), F.lit(0))) * Z95
    return out.withColumns({
        "p_value": two_sided_p(F.col("z_statistic")),
        "control_ci_low": F.col("control_rate") - half("control_rate", "n_c"), "control_ci_high": F.col("control_rate") + half("control_rate", "n_c"),
        "treatment_ci_low": F.col("treatment_rate") - half("treatment_rate", "n_t"), "treatment_ci_high": F.col("treatment_rate") + half("treatment_rate", "n_t"),
    }).withColumn("is_significant", flag(F.col("p_value") < ALPHA))


def chi_square(counts: DataFrame) -> DataFrame:
    """2 x 2 test with continuity correction; one degree of freedom, so p comes from the normal."""
    a, b = F.col("x_c").cast("double"), (F.col("n_c") - F.col("x_c")).cast("double")
    c, d = F.col("x_t").cast("double"), (F.col("n_t") - F.col("x_t")).cast("double")
    n = a + b + c + d
    # the correction never exceeds the deviation itself
    gap = F.abs(a * d - b * c) / n
    corrected = F.greatest(F.lit(0.0), gap - F.least(F.lit(0.5), gap))
    chi2 = F.try_divide(corrected * corrected * n * n * n, (a + b) * (c + d) * (a + c) * (b + d))
    return counts.withColumn("chi2", chi2).withColumn("p_value", two_sided_p(F.sqrt("chi2")))


def prob_treatment_better(counts: DataFrame) -> DataFrame:
    """Beta(1,1) prior; normal approximation of the difference of the two posteriors."""
    def post(x, n):
        a, b = F.col(x) + 1, F.col(n) - F.col(x) + 1
        return a / (a + b), a * b / ((a + b) * (a + b) * (a + b + 1))
    (mc, vc), (mt, vt) = post("x_c", "n_c"), post("x_t", "n_t")
    return counts.withColumn("prob_treatment_better", normal_cdf((mt - mc) / F.sqrt(vc + vt)))


def mean_test(users: DataFrame, value: str = "revenue") -> DataFrame:
    """Outlier-trimmed pooled t-test with Cohen's d; medians are taken before trimming."""
    clean = winsor_filter(users.select("variant", value), "variant", value)
    x = F.col(value)
    stats = clean.agg(*[e for arm, s in ((CONTROL, "c"), (TREATMENT, "t")) for e in (
        _arm(F.count, x, arm).alias(f"n_{s}"), _arm(F.avg, x, arm).alias(f"mean_{s}"), _arm(F.var_samp, x, arm).alias(f"var_{s}"))])
    med = grouped_quantiles(users, ["variant"], value, {"m": 0.5})
    stats = stats.withColumn("_m", one_row(med.agg(_arm(F.max, F.col("m"), CONTROL).alias("c"), _arm(F.max, F.col("m"), TREATMENT).alias("t"))))
    pooled = F.sqrt(((F.col("n_c") - 1) * F.col("var_c") + (F.col("n_t") - 1) * F.col("var_t")) / (F.col("n_c") + F.col("n_t") - 2))
    diff = F.col("mean_t") - F.col("mean_c")
    out = stats.withColumns({"pooled_std": pooled, "control_median": F.col("_m.c"), "treatment_median": F.col("_m.t"),
                             "absolute_lift": diff, "relative_lift": ratio(diff, "mean_c")}).drop("_m")
    return out.withColumns({
        "cohens_d": ratio("absolute_lift", "pooled_std"),
        "t_statistic": ratio("absolute_lift", F.col("pooled_std") * F.sqrt(1 / F.col("n_c") + 1 / F.col("n_t")))}).withColumn(
        "p_value", two_sided_p(F.col("t_statistic"))).withColumn("is_significant", flag(F.col("p_value") < ALPHA))


def mann_whitney(users: DataFrame, value: str = "revenue") -> DataFrame:
    """Two-sided U test with tie and continuity correction."""
    ranks = average_ranks(users, value)
    arms = users.groupBy(value, "variant").agg(F.count("*").alias("m")).join(ranks, value)
    sums = arms.agg(*[e for arm, s in ((CONTROL, "c"), (TREATMENT, "t")) for e in (
        _arm(F.sum, F.col("m"), arm).alias(f"n_{s}"), _arm(F.sum, F.col("m") * F.col("avg_rank"), arm).alias(f"r_{s}"))])
    ties = one_row(ranks.agg(F.sum(F.pow(F.col("n"), 3) - F.col("n")).alias("t"))).getField("t")
    n1, n2 = F.col("n_t"), F.col("n_c")
    n = n1 + n2
    u = F.col("r_t") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd
    return sums.select(n1.alias("n_treatment"), n2.alias("n_control"), u.alias("u_statistic"),
                       F.least(F.lit(1.0), two_sided_p(F.greatest(z, F.lit(0.0)))).alias("p_value"))


def poisson_steps() -> list[float]:
    """Distribution function of Poisson(1) at 0, 1, ... as far as doubles below 1 reach."""
    steps, total = [], 0.0
    while True:
        now = total + math.exp(-1) / math.factorial(len(steps))
        if now == total or now >= 1.0:
            return steps
        steps.append(now)
        total = now


def poisson_weight(unit: Column) -> Column:
    """Poisson(1) draw from a uniform number by its distribution function."""
    return first_match([(unit < step, n) for n, step in enumerate(poisson_steps())], len(poisson_steps()))


def poisson_draws(rows: DataFrame, key: str, replicates: int) -> DataFrame:
    """Every row with every ``rep`` and a weight ``w``.

    A table of some thousand rows may be one part, so rows are dealt out with chunks of replicates before the draws are made.
    """
    chunk = max(1, -(-replicates // 64))
    starts = rows.withColumn("_from", F.explode(F.sequence(F.lit(1), F.lit(replicates), F.lit(chunk))))
    spread = starts.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, F.xxhash64(key, "_from"))
    draws = spread.withColumn("rep", F.explode(F.sequence("_from", F.least(F.col("_from") + (chunk - 1), F.lit(replicates))))).drop("_from")
    drawn = draws.withColumn("_u", unit_hash_52(F.col(key), F.col("rep")))         # a column, so that it is made once
    return drawn.withColumn("w", poisson_weight(F.col("_u"))).drop("_u")


def bootstrap_ci(users: DataFrame, key: str, value: str = "revenue", replicates: int = 1000) -> DataFrame:
    """Interval of the mean difference from Poisson resampling: every user draws a weight per replicate
    from a hash of both, so replicates are reproducible and only sums per replicate are shuffled."""
    clean = winsor_filter(users.select(key, "variant", value), "variant", value)
    weighted = poisson_draws(clean, key, replicates)
    mean = lambda arm: ratio(_arm(F.sum, F.col("w") * F.col(value), arm), _arm(F.sum, F.col("w"), arm))
    diffs = weighted.groupBy("rep").agg((mean(TREATMENT) - mean(CONTROL)).alias("diff"))
    # one row per replicate: small by construction
    return diffs.agg(F.percentile("diff", 0.025).alias("ci_low"), F.percentile("diff", 0.975).alias("ci_high"),
                     F.avg("diff").alias("mean_difference"), F.count("diff").alias("replicates"))


def sequential(users: DataFrame, day: str, planned: int, spending: str = "obrien_fleming") -> DataFrame:
    """Readout after every enrolment day with the significance level spent so far."""
    daily = users.groupBy(day).agg(*[e for arm, s in ((CONTROL, "c"), (TREATMENT, "t")) for e in (
        _arm(F.count, F.lit(1), arm).alias(f"d_n_{s}"), F.coalesce(_arm(F.sum, F.col("converted"), arm), F.lit(0)).alias(f"d_x_{s}"))])
    upto = W.orderBy(day).rowsBetween(W.unboundedPreceding, 0)   # one row per day
    cum = daily.select(day, *[F.sum(f"d_{c}").over(upto).alias(c) for c in ("n_c", "x_c", "n_t", "x_t")])
    t = (F.col("n_c") + F.col("n_t")) / F.lit(planned)
    if spending == "obrien_fleming":
        spent = 2 * (1 - normal_cdf(F.lit(normal_quantile(1 - ALPHA / 2)) / F.sqrt(F.col("information_fraction"))))
    else:
        spent = ALPHA * F.log1p(F.lit(math.e - 1) * F.col("information_fraction"))
    out = conversion_test(cum.withColumn("information_fraction", t)).withColumn("adjusted_alpha", spent)
    return out.withColumn("can_stop_early", flag(F.col("p_value") < F.col("adjusted_alpha")))


def adjust_p_values(tests: DataFrame) -> DataFrame:
    """Bonferroni and step-up false-discovery control over one row per metric."""
    everything = W.partitionBy()
    m = F.count("*").over(everything)
    ranked = tests.withColumns({"num_metrics": m, "p_rank": F.row_number().over(W.orderBy("p_value", "metric"))})
    line = ALPHA * F.col("p_rank") / F.col("num_metrics")
    ranked = ranked.withColumn("_last", F.max(F.when(F.col("p_value") <= line, F.col("p_rank"))).over(everything))
    return ranked.withColumns({
        "is_significant": flag(F.col("p_value") < ALPHA),
        "bonferroni_significant": flag(F.col("p_value") < ALPHA / F.col("num_metrics")),
        "fdr_significant": flag(F.col("p_rank") <= F.col("_last")),
        "fdr_single_rank": flag(F.col("p_value") <= line)}).drop("_last")


def multi_metric(users: DataFrame, binary: list[str], continuous: list[str]) -> DataFrame:
    """One ``p_value`` per metric, whatever its type, with corrections."""
    rows = [conversion_test(conversion_counts(users.withColumn("converted", F.col(b)))).select(F.lit(b).alias("metric"), "relative_lift", "p_value") for b in binary]
    rows += [mean_test(users, c).select(F.lit(c).alias("metric"), "relative_lift", "p_value") for c in continuous]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return adjust_p_values(out)


def with_power(tests: DataFrame, effect: str, n: str = "n_c") -> DataFrame:
    """Power of the observed effect (normal limit): for any effect, and as reported, only if significant."""
    z = F.lit(normal_quantile(1 - ALPHA / 2))
    shift = F.abs(effect) * F.sqrt(n)
    power = normal_cdf(shift - z) + normal_cdf(-shift - z)
    return tests.withColumn("power_at_effect", power).withColumn("observed_power", F.when(F.col("is_significant") == 1, power))
