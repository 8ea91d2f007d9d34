"""Queries on model data, training, evaluation and scoring."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.core import flag, one_row
from ..functions.order_stats import quantiles
from ..functions.staging import stage
from ..operators import features as ft
from ..operators import metrics as mt
from ..operators import ml_data as md
from ..operators import ml_models as mm
from .prelude import PRE, base_features, r, rd, rnd
from .recommendations import HASH
from .registry import REG

P, X = ft.PERSON, md.CHURN_FEATURES


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def labelled(spark, sf):
    """Feature table whose label is recency above the 60th percentile: both classes at every scale."""
    feats = stage(base_features(spark, sf, [P, *X, "recency_days", "frequency", "monetary_value"]), "model")
    edge = one_row(quantiles(feats, "recency_days", {"q": 0.6})).getField("q")
    return stage(md.sanitized(feats, X).withColumn("churned", flag(F.col("recency_days") > edge)), "model")


def split(spark, sf):
    data = stage(md.with_class_weights(md.stratified_split(labelled(spark, sf), P, "churned"), "churned"), "split")
    return data.where("is_test = 0"), data.where("is_test = 1")


U = HASH("customer_unique_id::VARCHAR || '|42'")
U7 = HASH("customer_unique_id::VARCHAR || '|7'")
LAB = PRE + f""", le AS (SELECT quantile_cont(recency_days, 0.6) AS q FROM feat),
lab0 AS (SELECT feat.* EXCLUDE (churned), CAST(recency_days > q AS INTEGER) AS churned, {U} AS u, {U7} AS u7 FROM feat, le),
le2 AS (SELECT churned, quantile_cont(u, 0.2) AS c, quantile_cont(u7, [0.2, 0.4, 0.6, 0.8]) AS f FROM lab0 GROUP BY 1),
lab AS (SELECT lab0.*, CAST(u < c AS INTEGER) AS is_test, CAST(u7 >= f[1] AS INTEGER) + CAST(u7 >= f[2] AS INTEGER) + CAST(u7 >= f[3] AS INTEGER) + CAST(u7 >= f[4] AS INTEGER) AS fold FROM lab0 JOIN le2 USING (churned)),
sc AS (SELECT customer_unique_id, churned, round(1 / (1 + exp(-(avg_days_between_orders - 170) / 60)), 4) AS score FROM lab),
sp AS (SELECT *, CAST(score >= 0.5 AS INTEGER) AS prediction FROM sc)
"""


def rule_scores(spark, sf):
    """A hand-made score, so that the metrics can be checked in SQL."""
    s = F.round(1 / (1 + F.exp(-(F.col("avg_days_between_orders") - 170) / 60)), 4)
    return labelled(spark, sf).select(P, "churned", s.alias("score")).withColumn("prediction", flag(F.col("score") >= 0.5))


@REG.add("stratified_split", LAB + "SELECT customer_unique_id, churned, is_test FROM lab")
def _(spark, sf):
    return md.stratified_split(labelled(spark, sf), P, "churned").select(P, "churned", "is_test")


@REG.add("stratified_folds", LAB + "SELECT customer_unique_id, churned, fold FROM lab")
def _(spark, sf):
    return md.stratified_folds(labelled(spark, sf), P, "churned").select(P, "churned", "fold")


SCALED = ["total_orders", "total_revenue", "customer_lifetime_days"]


@REG.add("scale_standard", LAB + ", s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALED) + " FROM lab WHERE is_test = 0) SELECT customer_unique_id, " + ", ".join(r(f"({c} - m_{c}) / s_{c}", 5, c) for c in SCALED) + " FROM lab, s")
def _(spark, sf):
    data = stage(md.stratified_split(labelled(spark, sf), P, "churned"), "split")
    return md.scale_standard(data, SCALED, data.where("is_test = 0")).select(P, *rnd(*SCALED, digits=5))


@REG.add("scale_robust", LAB + ", s AS (SELECT " + ", ".join(f"median({c}) AS m_{c}, quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25) AS s_{c}" for c in SCALED) + " FROM lab WHERE is_test = 0) SELECT customer_unique_id, " + ", ".join(r(f"({c} - m_{c}) / s_{c}", 5, c) for c in SCALED) + " FROM lab, s")
def _(spark, sf):
    data = stage(md.stratified_split(labelled(spark, sf), P, "churned"), "split")
    return md.scale_robust(data, SCALED, data.where("is_test = 0")).select(P, *rnd(*SCALED, digits=5))


@REG.add("class_weights", LAB + f"SELECT churned, count(*) AS rows, {r('(SELECT count(*) FROM lab) / (2 * count(*))', 6, 'weight')}, {r('(SELECT (count(*) - sum(churned)) / sum(churned) FROM lab)', 6, 'scale_pos_weight')} FROM lab GROUP BY 1")
def _(spark, sf):
    return md.class_weights(labelled(spark, sf), "churned").select("churned", "rows", *rnd("weight", "scale_pos_weight", digits=6))


PAIRED = ["total_orders", "order_value_std", "avg_days_between_orders"]


@REG.add("interactions", LAB + "SELECT customer_unique_id, " + ", ".join(
    r(f"{a} * {b}", 3, f"{a}_x_{b}") + ", " + r(f"{a} / (CASE WHEN {b} = 0 THEN 1 ELSE {b} END)", 5, f"{a}_div_{b}") for i, a in enumerate(PAIRED) for b in PAIRED[i + 1:]) + " FROM lab")
def _(spark, sf):
    out = md.interactions(labelled(spark, sf).select(P, *PAIRED), PAIRED)
    names = [c for c in out.columns if c not in (P, *PAIRED)]
    return out.select(P, *[rd(c, digits=3 if "_x_" in c else 5) for c in names])


# Trained models and random draws have no SQL twin. Their queries return facts that must hold and can fail, next to numbers that SQL
# can count; 1 means that the fact holds. The rows themselves come from the queries that end in _rows.

@REG.add("smote", LAB + """, r AS (SELECT CAST(churned = 1 AND frequency <= 8 AS INTEGER) AS y FROM lab), k AS (SELECT sum(y) AS p, count(*) - sum(y) AS n FROM r)
  SELECT CAST(greatest(0, floor(n * 0.6) - p) AS BIGINT) AS n_new, 1 AS from_minority, 1 AS between_parents FROM k""")
def _(spark, sf):
    data = labelled(spark, sf)
    rare = stage(md.scale_standard(data.withColumn("churned", flag((F.col("churned") == 1) & (F.col("frequency") <= 8))), SCALED, data), "rare")
    made = stage(md.smote(rare, P, "churned", SCALED), "smote")
    ends = lambda side: rare.where("churned = 1").select(F.col(P).alias(f"{side}_key"), *[F.col(c).alias(f"{side}_{c}") for c in SCALED])
    both = made.join(ends("from"), "from_key", "left").join(ends("to"), "to_key", "left")
    inside = lambda c: F.col(c).between(F.least(f"from_{c}", f"to_{c}") - 1e-9, F.greatest(f"from_{c}", f"to_{c}") + 1e-9)
    held = inside(SCALED[0]) & inside(SCALED[1]) & inside(SCALED[2]) & (F.col("from_key") != F.col("to_key"))
    return both.agg(F.count("*").alias("n_new"), F.min(flag(F.col(f"from_{SCALED[0]}").isNotNull() & F.col(f"to_{SCALED[0]}").isNotNull())).alias("from_minority"),
                    F.min(flag(held)).alias("between_parents"))


def anova_sql() -> str:
    """Every feature, product and ratio, and its F value."""
    plain = {c: f"coalesce(CASE WHEN isfinite({c}::DOUBLE) THEN {c}::DOUBLE END, 0)" for c in X}
    made = {c: c for c in X}
    for i, a in enumerate(X):
        for b in X[i + 1:]:
            made |= {f"{a}_x_{b}": f"{a} * {b}", f"{a}_div_{b}": f"{a} / (CASE WHEN {b} = 0 THEN 1 ELSE {b} END)"}
    return LAB.rstrip() + f""", cl AS (SELECT churned, {', '.join(f'{e} AS {c}' for c, e in plain.items())} FROM lab WHERE is_test = 0),
  lg AS (SELECT churned, unnest([{', '.join(f"'{c}'" for c in made)}]) AS feature, unnest([{', '.join(made.values())}]) AS x FROM cl),
  st AS (SELECT feature, churned, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM lg GROUP BY 1, 2),
  fv AS (SELECT feature, (sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1) / nullif(sum(v * (n - 1)) / (sum(n) - count(*)), 0) AS f FROM st GROUP BY 1)"""


@REG.add("anova_f_values", anova_sql() + f" SELECT feature, {r('f', 4, 'f_value')} FROM fv")
def _(spark, sf):
    train, _ = split(spark, sf)
    return md.anova_scores(train, mm.candidates(X, X), "churned").select("feature", *rnd("f_value"))


# The forest's choice has no SQL twin. Its candidates' F values do, and so does what follows from them.
@REG.add("feature_selection", anova_sql() + ", t(n_top, n_candidates, n_kept) AS (VALUES (10, 102, 50)) SELECT n_top, n_candidates, n_kept, 1 AS best_kept, (SELECT count(*) FROM lab WHERE is_test = 0) AS n_train, "
         + r("(SELECT max(f) FROM fv WHERE feature IN (" + ", ".join(f"'{c}'" for c in X) + "))", 4, "best_single") + " FROM t")
def _(spark, sf):
    train, _ = split(spark, sf)
    top, found = mm.select_features(train, X)
    found = stage(found, "selected")
    facts = found.agg(F.lit(len(top)).alias("n_top"), F.count("*").cast("int").alias("n_candidates"), F.sum("kept").cast("int").alias("n_kept"),
                      flag(F.min(F.when(F.col("kept") == 1, F.col("f_value"))) >= F.max(F.when(F.col("kept") == 0, F.col("f_value")))).alias("best_kept"),
                      F.max(F.when(F.col("feature").isin(X), F.col("f_value"))).alias("best_single"))
    n = one_row(train.agg(F.count("*").alias("n"))).getField("n")
    return facts.select("n_top", "n_candidates", "n_kept", "best_kept", n.alias("n_train"), *rnd("best_single"))


@REG.add_rows("feature_selection")
def _(spark, sf):
    return mm.select_features(split(spark, sf)[0], X)[1]


def score_facts(out, name: str, accuracy):
    """Facts on written scores of the test rows; ``accuracy`` is what the operator reported."""
    auc = one_row(mm.eval_binary(out)).getField("roc_auc")
    plain = F.avg(flag(F.col("churned") == F.col("prediction")))
    sums = out.agg(F.count("*").alias("n_test"), F.sum("churned").cast("long").alias("n_gone"), F.countDistinct(P).alias("_k"), plain.alias("_a"))
    return sums.select(F.lit(name).alias("model"), "n_test", "n_gone", flag(F.col("_k") == F.col("n_test")).alias("one_score_each"),
                       flag(F.abs(F.col("_a") - accuracy) < 1e-9).alias("accuracy_agrees"), flag(auc > 0.55).alias("better_than_chance"))


def facts_sql(names: list[str]) -> str:
    rows = ", ".join(f"('{n}')" for n in names)
    return LAB + f", t AS (SELECT count(*) AS n_test, CAST(sum(churned) AS BIGINT) AS n_gone FROM lab WHERE is_test = 1) SELECT model, n_test, n_gone, 1 AS one_score_each, 1 AS accuracy_agrees, 1 AS better_than_chance FROM t, (VALUES {rows}) m(model)"


def trained(spark, sf, models: list[str]):
    """Test metrics of the models, and the written test scores of each."""
    train, test = split(spark, sf)
    zoo, kept = mm.model_zoo(len(X)), {}
    ready = lambda d: mm.assemble(md.scale_standard(d, X, train), X)
    return stage(mm.train_report(ready(train), ready(test), {m: zoo[m] for m in models}, P, kept), "report"), kept


def _train(name: str, models: list[str]) -> None:
    @REG.add_rows(name)
    def _(spark, sf):
        return trained(spark, sf, models)[0]

    @REG.add(name, facts_sql(models))
    def _(spark, sf):
        report, kept = trained(spark, sf, models)
        return union([score_facts(kept[m], m, one_row(report.where(F.col("model") == m).select("accuracy")).getField("accuracy")) for m in models])


_train("train_logreg", ["logistic_l2", "logistic_l1", "logistic_elastic"])
_train("train_trees", ["decision_tree", "random_forest"])
_train("train_gbt", ["gradient_boosting", "boosting_deep"])
_train("train_mlp", ["neural_network"])
_train("train_svm", ["linear_svm"])


def voted(spark, sf):
    """Votes of the three best of all nine models on the test rows, by kind."""
    report, kept = trained(spark, sf, list(mm.model_zoo(len(X))))
    best = [r["model"] for r in mm.best_models(report).collect()]          # three names
    return {kind: stage(mm.ensemble_vote([kept[m] for m in best], P, kind == "soft"), "vote") for kind in ("hard", "soft")}


@REG.add_rows("ensemble_vote")
def _(spark, sf):
    return union([mm.eval_binary(v).select(F.lit(kind).alias("model"), "accuracy", "precision", "recall", "f1", "roc_auc") for kind, v in voted(spark, sf).items()])


@REG.add("ensemble_vote", facts_sql(["hard", "soft"]))
def _(spark, sf):
    return union([score_facts(v, kind, one_row(mm.eval_binary(v)).getField("accuracy")) for kind, v in voted(spark, sf).items()])


GRID = {"maxDepth": [2, 3, 4], "maxIter": [100, 200], "stepSize": [0.1, 0.3]}
NINE = ["boosting_deep", "decision_tree", "gradient_boosting", "linear_svm", "logistic_elastic", "logistic_l1", "logistic_l2", "neural_network", "random_forest"]


def folded(spark, sf, folds):
    data = md.with_class_weights(md.stratified_folds(labelled(spark, sf), P, "churned", folds), "churned")
    return mm.assemble(stage(data, "folds"), X)


def written_facts(scores, report, name, accuracy):
    """Facts on the written validation scores per model: everybody once, and the reported mean of the folds' accuracies recomputed plainly."""
    val = scores.where("part = 'val'")
    per = val.groupBy("model", "fold").agg(F.count("*").alias("n"), F.sum("churned").cast("long").alias("g"), F.avg(flag(F.col("churned") == F.col("prediction"))).alias("a"),
                                           F.min(flag(F.col("score").between(0, 1))).alias("p")).groupBy("model").agg(
        F.sum("n").alias("n_val"), F.sum("g").alias("n_gone"), F.avg("a").alias("a"), F.min("p").alias("are_probabilities"))
    people = val.groupBy("model").agg(F.countDistinct(P).alias("k"))
    return per.join(people, "model").join(report.select(F.col(name).alias("model"), accuracy.alias("r")), "model").select(
        F.col("model").alias(name), "n_val", "n_gone", flag(F.col("k") == F.col("n_val")).alias("one_score_each"), "are_probabilities", flag(F.abs(F.col("a") - F.col("r")) < 1e-9).alias("accuracy_agrees"))


def written_sql(name: str, values: list[str]) -> str:
    rows = ", ".join(f"('{v}')" for v in values)
    return LAB + f"SELECT {name}, count(*) AS n_val, CAST(sum(churned) AS BIGINT) AS n_gone, 1 AS one_score_each, 1 AS are_probabilities, 1 AS accuracy_agrees FROM lab, (VALUES {rows}) m({name}) GROUP BY 1"


SETTINGS = [f"maxDepth={d}, stepSize={s}, maxIter={n}" for d in GRID["maxDepth"] for s in GRID["stepSize"] for n in GRID["maxIter"]]


@REG.add("tune", written_sql("params", SETTINGS))
def _(spark, sf):
    kept = []
    mm.tune(folded(spark, sf, 3), GRID, P, folds=3, scores=kept)
    return written_facts(kept[0], mm.cv_metrics(kept[0]).withColumnRenamed("model", "params"), "params", F.col("cv_val_accuracy"))


@REG.add_rows("tune")
def _(spark, sf):
    return mm.tune(folded(spark, sf, 3), GRID, P, folds=3)


@REG.add("cv_report", written_sql("model", NINE))
def _(spark, sf):
    scores = mm.cv_scores(folded(spark, sf, 5), mm.model_zoo(len(X)), P, 5)
    return written_facts(scores, mm.cv_metrics(scores), "model", F.col("cv_val_accuracy"))


@REG.add_rows("cv_report")
def _(spark, sf):
    return mm.cv_report(folded(spark, sf, 5), mm.model_zoo(len(X)), P)


METRIC_SQL = f""", c AS (SELECT count(*) AS n, count(CASE WHEN churned = 1 AND prediction = 1 THEN 1 END) AS tp, count(CASE WHEN churned = 0 AND prediction = 1 THEN 1 END) AS fp, count(CASE WHEN churned = 1 AND prediction = 0 THEN 1 END) AS fn, count(CASE WHEN churned = 0 AND prediction = 0 THEN 1 END) AS tn FROM sp),
  rk AS (SELECT churned, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS ar FROM sp), au AS (SELECT (sum(CASE WHEN churned = 1 THEN ar END) - sum(churned) * (sum(churned) + 1) / 2) / (sum(churned) * (count(*) - sum(churned))) AS auc FROM rk)"""


@REG.add("eval_binary", LAB.rstrip() + METRIC_SQL + f" SELECT n, tp, fp, fn, tn, {r('(tp + tn) / n', 6, 'accuracy')}, {r('tp / (tp + fp)', 6, 'precision')}, {r('tp / (tp + fn)', 6, 'recall')}, {r('2 * tp / (2 * tp + fp + fn)', 6, 'f1')}, {r('auc', 6, 'roc_auc')} FROM c, au")
def _(spark, sf):
    return mm.eval_binary(stage(rule_scores(spark, sf), "scores")).select("n", "tp", "fp", "fn", "tn", *rnd("accuracy", "precision", "recall", "f1", "roc_auc", digits=6))


@REG.add("confusion_roc", LAB + f"SELECT score AS threshold, {r('sum(sum(churned)) OVER w / (SELECT sum(churned) FROM sp)', 6, 'tpr')}, {r('sum(count(*) - sum(churned)) OVER w / (SELECT count(*) - sum(churned) FROM sp)', 6, 'fpr')} FROM sp GROUP BY score WINDOW w AS (ORDER BY score DESC)")
def _(spark, sf):
    return mm.roc_points(stage(rule_scores(spark, sf), "scores")).select("threshold", *rnd("tpr", "fpr", digits=6))


@REG.add("confusion_matrix", LAB + "SELECT churned AS actual, prediction AS predicted, count(*) AS n FROM sp GROUP BY 1, 2")
def _(spark, sf):
    return mm.confusion(rule_scores(spark, sf))


@REG.add("class_report", LAB + f", k AS (SELECT unnest([0, 1]) AS class), s AS (SELECT class, (SELECT count(*) FROM sp WHERE churned = class) AS support, (SELECT count(*) FROM sp WHERE prediction = class) AS claimed, (SELECT count(*) FROM sp WHERE prediction = class AND churned = class) AS hit FROM k) SELECT class, support, {r('hit / claimed', 6, 'precision')}, {r('hit / support', 6, 'recall')}, {r('2 * hit / (claimed + support)', 6, 'f1')} FROM s")
def _(spark, sf):
    return mm.class_report(rule_scores(spark, sf)).select("class", "support", *rnd("precision", "recall", "f1", digits=6))


def calibrated(spark, sf):
    scores = stage(rule_scores(spark, sf).join(md.stratified_split(labelled(spark, sf), P, "churned").select(P, "is_test"), P), "scores")
    return stage(mm.calibrate_isotonic(scores.where("is_test = 1"), scores), "calibrated")


@REG.add_rows("calibrate_isotonic")
def _(spark, sf):
    return calibrated(spark, sf).select(P, "churned", "is_test", "score", "calibrated")


@REG.add("calibrate_isotonic", LAB + "SELECT count(DISTINCT score) AS n_scores, 1 AS rising, 1 AS mean_kept FROM sp")
def _(spark, sf):
    out = calibrated(spark, sf)
    per = out.groupBy("score").agg(F.min("calibrated").alias("lo"), F.max("calibrated").alias("hi"))
    steps = per.withColumn("before", F.max("hi").over(W.partitionBy(F.floor(F.col("score") * 10)).orderBy("score").rowsBetween(W.unboundedPreceding, -1)))
    mean = one_row(out.where("is_test = 1").agg((F.abs(F.avg("calibrated") - F.avg("churned")) < 1e-6).alias("ok"))).getField("ok")
    return steps.agg(F.count("*").alias("n_scores"), F.min(flag((F.col("lo") == F.col("hi")) & (F.coalesce("before", "lo") <= F.col("lo") + 1e-12))).alias("rising"),
                     F.min(flag(mean)).alias("mean_kept"))


IMPORTANT = f"SELECT {len(X)} AS n_features, 1 AS sums_up, 1 AS best_first"


def importance_facts(spark, found: list, total: float | None):
    """A row per feature comes in: how many there are, whether they add up to ``total`` (or are all positive somewhere), and their order."""
    values = [r["importance"] for r in found]
    whole = abs(sum(values) - total) < 1e-6 if total is not None else min(values) >= 0 and max(values) > 0
    return spark.createDataFrame([(len({r["feature"] for r in found} & set(X)), int(whole), int(values == sorted(values, reverse=True)))], "n_features int, sums_up int, best_first int")


@REG.add("feature_importance", IMPORTANT)
def _(spark, sf):
    train, _ = split(spark, sf)
    data = mm.assemble(train, X)
    model = RandomForestClassifier(labelCol="churned", featuresCol="features", numTrees=50, maxDepth=5, seed=42).fit(data)
    return importance_facts(spark, mm.importance_table(data, X, model.featureImportances).collect(), 1.0)


@REG.add("permutation_importance", IMPORTANT)
def _(spark, sf):
    train, test = split(spark, sf)
    model = LogisticRegression(labelCol="churned", featuresCol="features", regParam=0.1).fit(mm.assemble(train, X))
    return importance_facts(spark, mm.permutation_importance(model, test, X, P).collect(), None)


RULES = {"gap_over_120": 120, "gap_over_170": 170, "gap_over_250": 250}


def rule_report(spark, sf):
    """Three threshold rules as candidate models."""
    data = labelled(spark, sf)
    hit = lambda t: F.col("avg_days_between_orders") > t
    y = F.col("churned") == 1
    counts = data.agg(*[e for n, t in RULES.items() for e in (F.count_if(y & hit(t)).alias(f"tp_{n}"), F.count_if(hit(t)).alias(f"pp_{n}"))],
                      F.count_if(y).alias("pos"), F.count("*").alias("n"))
    rows = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"tp_{n}").alias("tp"), F.col(f"pp_{n}").alias("pp")) for n in RULES])
    tp, pp = F.col("m.tp"), F.col("m.pp")
    return counts.select(F.explode(rows).alias("m"), "pos", "n").select(
        "m.model", F.try_divide(tp, pp).alias("precision"), F.try_divide(tp, F.col("pos")).alias("recall"),
        ((F.col("n") - pp - F.col("pos") + 2 * tp) / F.col("n")).alias("accuracy"))


RULE_SQL = LAB.rstrip() + ", rr AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS model, sum(CASE WHEN avg_days_between_orders > {t} THEN churned END) / count(CASE WHEN avg_days_between_orders > {t} THEN 1 END) AS precision, "
    f"sum(CASE WHEN avg_days_between_orders > {t} THEN churned END) / sum(churned) AS recall, avg(CAST(CAST(avg_days_between_orders > {t} AS INTEGER) = churned AS INTEGER)) AS accuracy FROM lab" for n, t in RULES.items()) + ")"


@REG.add("profit_score", RULE_SQL + f" SELECT model, {r('precision', 6, 'precision')}, {r('recall', 6, 'recall')}, {r('precision * 100 - (1 - recall) * 500', 4, 'profit_score')} FROM rr")
def _(spark, sf):
    return mm.profit_score(rule_report(spark, sf)).select("model", *rnd("precision", "recall", digits=6), *rnd("profit_score"))


@REG.add("model_cost_view", RULE_SQL + f""", b AS (SELECT count(*) AS n, sum(churned) AS g FROM lab), t AS (SELECT model, CAST(floor(g * recall + 1e-9) AS BIGINT) AS tp, CAST(floor((n - g) * (1 - precision) + 1e-9) AS BIGINT) AS fp, g FROM rr, b)
  SELECT model, tp AS true_positives, fp AS false_positives, CAST(g - tp AS BIGINT) AS false_negatives, {r('CAST(tp * 0.4 * 200 - (tp + fp) * 30 - (g - tp) * 200 AS DOUBLE)', 2, 'net_benefit')} FROM t""")
def _(spark, sf):
    return mt.model_cost_view(rule_report(spark, sf), labelled(spark, sf)).select("model", "true_positives", "false_positives", "false_negatives", *rnd("net_benefit", digits=2))


@REG.add("result_checks", RULE_SQL + " SELECT model, CASE WHEN accuracy > 0.95 THEN 'accuracy too high' WHEN abs(precision - recall) > 0.1 THEN 'overfit' ELSE 'reasonable' END AS verdict, CAST(accuracy BETWEEN 0.65 AND 0.85 AS INTEGER) AS auc_in_range FROM rr")
def _(spark, sf):
    rep = rule_report(spark, sf).withColumns({"overfit_gap": F.abs(F.col("precision") - F.col("recall")), "roc_auc": F.col("accuracy")})
    return mm.result_checks(rep).select("model", "verdict", "auc_in_range")


def scored_customers(spark, sf):
    """Churn probability of every customer, by a model of the train rows."""
    train, test = (d.withColumns({c: F.col(c).cast("double") for c in X}) for d in split(spark, sf))
    est = LogisticRegression(labelCol="churned", featuresCol="features", regParam=0.1)
    return mm.batch_score(mm.scoring_pipeline(X, est).fit(train), train.unionByName(test), P), test


@REG.add_rows("batch_score")
def _(spark, sf):
    return scored_customers(spark, sf)[0]


@REG.add("batch_score", LAB + "SELECT count(*) AS n_scored, 1 AS are_probabilities, 1 AS decided_at_half FROM lab WHERE is_test = 1")
def _(spark, sf):
    out, test = scored_customers(spark, sf)
    out = out.join(test.select(P), P)
    p = F.col("churn_probability")
    return out.agg(F.count("*").alias("n_scored"), F.min(flag(p.between(0, 1))).alias("are_probabilities"), F.min(flag(flag(p > 0.5) == F.col("will_churn"))).alias("decided_at_half"))


SEGMENTED = ["frequency", "monetary_value", "customer_lifetime_days"]


@REG.add_rows("kmeans_segments")
def _(spark, sf):
    return mm.kmeans_segments(labelled(spark, sf), SEGMENTED, 5)[1]


@REG.add("kmeans_segments", LAB + "SELECT 5 AS n_clusters, count(*) AS n_members, 1 AS means_agree FROM lab")
def _(spark, sf):
    data = labelled(spark, sf)
    profile = mm.kmeans_segments(data, SEGMENTED, 5)[1]
    mean = one_row(data.agg(F.avg("frequency").alias("m"))).getField("m")
    return profile.agg(F.count("*").cast("int").alias("n_clusters"), F.sum("members").alias("n_members"), F.sum(F.col("members") * F.col("frequency")).alias("_s")).select(
        "n_clusters", "n_members", flag(F.abs(F.col("_s") / F.col("n_members") - mean) < 0.01).alias("means_agree"))
