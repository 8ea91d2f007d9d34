"""Churn models on ``pyspark.ml``: training, tuning, ensembles, evaluation, scoring."""

from __future__ import annotations

import itertools
import random
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassificationModel, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.core import first_match, flag, one_row, ratio
from ..functions.order_stats import average_ranks, bucket_of
from ..functions.sampling import unit_hash
from ..functions.staging import stage, staging_path
from .ml_data import anova_scores, interaction_columns

LABEL, FEATURES, WEIGHT = "churned", "features", "weight"


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    doubles = df.withColumns({c: F.col(c).cast("double") for c in columns}).withColumn(LABEL, F.col(LABEL).cast("double"))
    return VectorAssembler(inputCols=columns, outputCol=FEATURES).transform(doubles)


def _common(cls, **kw):
    return cls(labelCol=LABEL, featuresCol=FEATURES, **kw)


def model_zoo(n_features: int, seed: int = 42) -> dict:
    """Estimators by name."""
    w = {"weightCol": WEIGHT}
    return {
        "logistic_l2": _common(LogisticRegression, regParam=0.1, elasticNetParam=0.0, maxIter=100, **w),
        "logistic_l1": _common(LogisticRegression, regParam=0.01, elasticNetParam=1.0, maxIter=100, **w),
        "logistic_elastic": _common(LogisticRegression, regParam=0.05, elasticNetParam=0.7, maxIter=100, **w),
        "decision_tree": _common(DecisionTreeClassifier, maxDepth=5, minInstancesPerNode=50, seed=seed, **w),
        "random_forest": _common(RandomForestClassifier, numTrees=50, maxDepth=5, minInstancesPerNode=50,
                                 featureSubsetStrategy="0.7", subsamplingRate=0.8, seed=seed, **w),
        "gradient_boosting": _common(GBTClassifier, maxIter=100, maxDepth=4, stepSize=0.1, subsamplingRate=0.8,
                                     featureSubsetStrategy="0.7", minInstancesPerNode=50, seed=seed, checkpointInterval=10, **w),
        "boosting_deep": _common(GBTClassifier, maxIter=200, maxDepth=6, stepSize=0.1, subsamplingRate=0.9,
                                 featureSubsetStrategy="0.9", minInstancesPerNode=10, seed=seed, checkpointInterval=10, **w),
        "linear_svm": _common(LinearSVC, regParam=0.01, maxIter=100, **w),
        "neural_network": _common(MultilayerPerceptronClassifier, layers=[n_features, 100, 50, 2], maxIter=500, seed=seed),
    }


def scored(model, df: DataFrame, key: str, also: list[str] = []) -> DataFrame:
    """``(key, label, score, prediction)`` and the columns ``also``; margins of models without probabilities go through a logistic."""
    out = model.transform(df)
    if "probability" in out.columns:
        score = vector_to_array("probability")[1]
    else:
        score = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.select(key, F.col(LABEL), score.alias("score"), flag(score >= 0.5).alias("prediction"), *also)


# --- evaluation -------------------------------------------------------------------------------------

def eval_binary(scores: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and exact ROC area (tie-aware rank sums) of ``label, prediction, score``."""
    y, p = F.col(LABEL), F.col("prediction")
    counts = scores.agg(F.count("*").alias("n"), F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    by_score = scores.groupBy("score").agg(F.sum(LABEL).alias("pos")).join(average_ranks(scores, "score"), "score")
    sums = by_score.agg(F.sum(F.col("pos") * F.col("avg_rank")).alias("r"), F.sum("pos").alias("n1"), F.sum("n").alias("n"))
    n1 = F.col("n1")
    auc = one_row(sums.select(ratio(F.col("r") - n1 * (n1 + 1) / 2, n1 * (F.col("n") - n1)).alias("auc"))).getField("auc")
    prec, rec = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn"))
    return counts.withColumns({"accuracy": ratio(F.col("tp") + F.col("tn"), "n"), "precision": prec, "recall": rec,
                               "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "roc_auc": auc})


def eval_grouped(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The metrics of ``eval_binary`` per group; ranks are prefix sums over buckets of scores and inside them."""
    y, p = F.col(LABEL), F.col("prediction")
    counts = scores.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                                       F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    per = scores.groupBy(*keys, "score").agg(F.sum(LABEL).alias("pos"), F.count("*").alias("m")).withColumn("_b", bucket_of("score"))
    over = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)             # a row per bucket
    starts = per.groupBy(*keys, "_b").agg(F.sum("m").alias("bm")).select(*keys, "_b", F.coalesce(F.sum("bm").over(over), F.lit(0)).alias("s"))
    inside = W.partitionBy(*keys, "_b").orderBy("score").rowsBetween(W.unboundedPreceding, 0)
    ranked = per.withColumn("upto", F.sum("m").over(inside)).join(starts, [*keys, "_b"])
    rank = F.col("s") + F.col("upto") - (F.col("m") - 1) / 2
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("pos") * rank).alias("r"), F.sum("pos").alias("n1"), F.sum("m").alias("m"))
    n1 = F.col("n1")
    auc = sums.select(*keys, ratio(F.col("r") - n1 * (n1 + 1) / 2, n1 * (F.col("m") - n1)).alias("roc_auc"))
    return counts.join(auc, keys).withColumns({
        "accuracy": ratio(F.col("tp") + F.col("tn"), "n"), "precision": ratio("tp", F.col("tp") + F.col("fp")), "recall": ratio("tp", F.col("tp") + F.col("fn")),
        "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def confusion(scores: DataFrame) -> DataFrame:
    return scores.groupBy(F.col(LABEL).cast("int").alias("actual"), F.col("prediction").alias("predicted")).agg(F.count("*").alias("n"))


def class_report(scores: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    cells = confusion(scores)
    truth = cells.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    claimed = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("claimed"))
    out = truth.join(claimed, "class", "left").withColumn("claimed", F.coalesce("claimed", F.lit(0)))
    return out.select("class", "support", ratio("hit", "claimed").alias("precision"), ratio("hit", "support").alias("recall"),
                      ratio(2 * F.col("hit"), F.col("claimed") + F.col("support")).alias("f1"))


def roc_points(scores: DataFrame) -> DataFrame:
    """One point per distinct score, from the strictest threshold down; prefix sums run bucket-wise."""
    per = scores.groupBy("score").agg(F.sum(LABEL).cast("long").alias("p"), F.count("*").alias("n")).withColumn("_b", bucket_of("score"))
    inside = W.partitionBy("_b").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    over = W.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    starts = per.groupBy("_b").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn")).select(
        "_b", F.coalesce(F.sum("bp").over(over), F.lit(0)).alias("sp"), F.coalesce(F.sum("bn").over(over), F.lit(0)).alias("sn"))
    run = per.withColumns({"cp": F.sum("p").over(inside), "cn": F.sum("n").over(inside)}).join(starts, "_b")
    tp = F.col("cp") + F.col("sp")
    fp = F.col("cn") + F.col("sn") - tp
    whole = one_row(scores.agg(F.sum(LABEL).alias("pos"), F.count("*").alias("n")))
    pos, neg = whole.getField("pos"), whole.getField("n") - whole.getField("pos")
    return run.select(F.col("score").alias("threshold"), ratio(tp, pos).alias("tpr"), ratio(fp, neg).alias("fpr"))


# --- training runs ------------------------------------------------------------------------------------

def _at_once(work: list, parallelism: int) -> list:
    """Results of several independent fits; their jobs share the cluster."""
    with ThreadPoolExecutor(parallelism) as pool:
        return [f.result() for f in [pool.submit(w) for w in work]]


ROWS = 25_000                     # of a training table in one part, about


def dealt(data: DataFrame, key: str, rows: int = ROWS) -> DataFrame:
    """Training rows in parts of about ``rows``, as many as there are cores at most.

    A staged table of few bytes is a part or two, however many rows it has; a small table in many parts costs more tasks than work.
    """
    parts = max(1, min(data.sparkSession.sparkContext.defaultParallelism, -(-data.count() // rows)))
    now = data.rdd.getNumPartitions()
    return data.coalesce(parts) if parts < now else data.repartition(parts, key) if parts > now else data


def _fitted(est, data: DataFrame, key: str):
    """A network's rows cost far more than another model's, so they are dealt finer."""
    return est.fit(dealt(data, key, ROWS // 5) if isinstance(est, MultilayerPerceptronClassifier) else data)


def _heavy_first(models: dict) -> list:
    """Names in the order of their fits: networks and boosting take longest, so nothing waits for one that starts last."""
    weight = lambda e: 2 if isinstance(e, MultilayerPerceptronClassifier) else 1 if isinstance(e, (tuple, GBTClassifier)) else 0
    return sorted(models, key=lambda n: -weight(models[n]))


def train_report(train: DataFrame, test: DataFrame, models: dict, key: str, scores: dict[str, DataFrame] | None = None, parallelism: int = 8) -> DataFrame:
    """Fit each model on ``train`` and report its test metrics; ``scores`` receives the written scores of each."""
    train = dealt(train, key).persist()
    try:
        order = _heavy_first(models)
        written = dict(zip(order, _at_once([lambda est=models[n]: stage(scored(_fitted(est, train, key), test, key), "scores") for n in order], parallelism)))
    finally:
        train.unpersist()
    parts = []
    for name in models:
        out = written[name]
        if scores is not None:
            scores[name] = out
        parts.append(eval_binary(out).select(F.lit(name).alias("model"), "accuracy", "precision", "recall", "f1", "roc_auc"))
    return reduce(DataFrame.unionByName, parts)


def cv_scores(data: DataFrame, models: dict, key: str, folds: int = 5, training_too: bool = True, parallelism: int = 8) -> DataFrame:
    """Written scores of every model and fold: ``model``, ``fold``, ``part`` (``val`` or ``train``), key, label, ``score``, ``prediction``.

    ``data`` has a ``fold`` column. A value of ``models`` is an estimator, or a pair of a boosting estimator and numbers of rounds: one
    fit then gives a model per number, ``name`` with the number in place of ``{}``, from its first so many trees.
    """
    data = dealt(data, key).persist()
    spark, paths = data.sparkSession, []

    def fit(name: str, est, f: int) -> list[str]:
        rounds = None
        if isinstance(est, tuple):
            est, rounds = est
        fitted = _fitted(est, data.where(F.col("fold") != f), key)
        rows = data.withColumn("part", F.when(F.col("fold") == f, "val").otherwise("train"))
        rows = rows if training_too else rows.where(F.col("part") == "val")
        out = []
        for n in rounds or [None]:
            path = staging_path(spark, "cv")
            got = scored(fitted if n is None else first_trees(fitted, n), rows, key, ["part"])
            got.select(F.lit(name.format(n)).alias("model"), F.lit(f).alias("fold"), "part", key, LABEL, "score", "prediction").write.parquet(path)
            out.append(path)
        return out

    try:
        for found in _at_once([lambda n=n, e=e, f=f: fit(n, e, f) for n, e in [(n, models[n]) for n in _heavy_first(models)] for f in range(folds)], parallelism):
            paths += found
    finally:
        data.unpersist()
    return spark.read.parquet(*paths)


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The boosted model after its first ``n`` rounds."""
    java, gateway = model._java_obj, SparkContext._gateway
    trees = list(java.trees())[:n]
    held = gateway.new_array(SparkContext._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(SparkContext._jvm.double, len(trees))
    for i, t in enumerate(trees):
        held[i], weights[i] = t, model.treeWeights[i]
    short = SparkContext._jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"{model.uid}_{n}", held, weights)
    java.copyValues(short, java.extractParamMap())
    return GBTClassificationModel(short)


def cv_metrics(scores: DataFrame) -> DataFrame:
    """Mean training and validation metrics per model of what ``cv_scores`` wrote."""
    cols = ["accuracy", "precision", "recall", "f1", "roc_auc"]
    long = eval_grouped(scores, ["model", "fold", "part"])
    side = lambda p, c: F.avg(F.when(F.col("part") == p, F.col(c)))
    out = long.groupBy("model").agg(
        side("train", "accuracy").alias("cv_train_accuracy"), *[side("val", c).alias(f"cv_val_{c}") for c in cols],
        F.stddev_pop(F.when(F.col("part") == "val", F.col("accuracy"))).alias("cv_val_accuracy_std"))
    return out.withColumn("cv_overfit_gap", F.col("cv_train_accuracy") - F.col("cv_val_accuracy"))


def cv_report(data: DataFrame, models: dict, key: str, folds: int = 5) -> DataFrame:
    """Cross-validated training and validation metrics per model; ``data`` has a ``fold`` column.

    The folds of all models are fitted side by side and scored into one table, so evaluation is one grouped aggregate.
    """
    return cv_metrics(cv_scores(data, models, key, folds))


def tuning_grid(grid: dict[str, list], samples: int | None = None, seed: int = 42) -> dict:
    """Boosting settings as models for ``cv_scores``: the whole grid, or a random sample of it. Numbers of rounds share their fits."""
    rounds = sorted(grid.get("maxIter", [20]))
    rest = {k: v for k, v in grid.items() if k != "maxIter"}
    combos = [dict(zip(rest, v)) for v in itertools.product(*rest.values())]
    if samples is not None and samples < len(combos):
        combos = random.Random(seed).sample(combos, samples)
    return {", ".join([*(f"{k}={v}" for k, v in c.items()), "maxIter={}"]): (_common(GBTClassifier, seed=seed, maxIter=rounds[-1], checkpointInterval=10, **c), rounds) for c in combos}


def tune(data: DataFrame, grid: dict[str, list], key: str, samples: int | None = None, folds: int = 3, seed: int = 42, scores: list | None = None) -> DataFrame:
    """Grid search, or a random sample of the grid, by the mean area under the ROC curve; ``scores`` receives the written scores."""
    written = cv_scores(data, tuning_grid(grid, samples, seed), key, folds, training_too=False)
    if scores is not None:
        scores.append(written)
    return cv_metrics(written).select(F.col("model").alias("params"), F.col("cv_val_roc_auc").alias("auc")).orderBy(F.desc("auc"), "params")


def ensemble_vote(scores: list[DataFrame], key: str, soft: bool = True) -> DataFrame:
    """Mean probability (soft) or majority of predictions (hard) over models, joined by key."""
    stacked = reduce(DataFrame.unionByName, scores)
    voted = stacked.groupBy(key, LABEL).agg(F.avg("score").alias("score"), F.avg("prediction").alias("_votes"))
    decide = flag(F.col("score") >= 0.5) if soft else flag(F.col("_votes") > 0.5)
    return voted.withColumn("prediction", decide).drop("_votes")


def best_models(report: DataFrame, n: int = 3, by: str = "accuracy") -> DataFrame:
    return report.orderBy(F.desc(by), "model").limit(n)


# --- importance, calibration, selection ---------------------------------------------------------------------

def importance_table(df: DataFrame, columns: list[str], importances) -> DataFrame:
    rows = [(c, float(v)) for c, v in zip(columns, importances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def select_features(train: DataFrame, columns: list[str], top: int = 10, best: int = 50, trees: int = 50, seed: int = 42) -> tuple[list[str], DataFrame]:
    """Names of a forest's ``top`` features, and the candidates by rank: ``feature``, ``f_value``, ``rank``, ``kept``.

    Candidates are all columns and the products and ratios of the top features; the ``best`` of them by analysis of variance are kept.
    """
    forest = _common(RandomForestClassifier, numTrees=trees, seed=seed).fit(assemble(train, columns))
    ranked = sorted(zip(columns, forest.featureImportances.toArray()), key=lambda x: (-x[1], x[0]))
    chosen = [c for c, _ in ranked[:top]]
    scores = anova_scores(train, candidates(columns, chosen), LABEL)
    rank = F.row_number().over(W.orderBy(F.desc_nulls_last("f_value"), "feature"))              # a row per candidate
    return chosen, scores.withColumn("rank", rank).withColumn("kept", flag(F.col("rank") <= best))


def candidates(columns: list[str], top: list[str]) -> dict:
    return {c: F.col(c) for c in columns} | interaction_columns(top)


def with_candidates(df: DataFrame, columns: list[str], top: list[str], kept: list[str]) -> DataFrame:
    """The kept candidates as columns."""
    made = candidates(columns, top)
    return df.withColumns({c: made[c].cast("double") for c in kept})


def permutation_importance(model, df: DataFrame, columns: list[str], key: str, seed: int = 42) -> DataFrame:
    """Mean absolute change of the score when one feature is exchanged with another row's.

    The exchange partner comes from a second hash order of the rows: an equi-join on rank, no collect.
    """
    from ..functions.order_stats import global_rank
    base = stage(df.select(key, LABEL, *columns), "perm")
    first = global_rank(base.select(key, unit_hash(F.col(key), "a", seed).alias("h")), "h", key, "pos").select(key, "pos")
    second = global_rank(base.select(key, unit_hash(F.col(key), "b", seed).alias("h")), "h", key, "pos").select(F.col(key).alias("_p"), "pos")
    partner = first.join(second, "pos").drop("pos")
    other = base.select(F.col(key).alias("_p"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    rows = stage(base.join(partner, key).join(other, "_p"), "perm")
    plain = scored(model, assemble(rows, columns), key).select(key, F.col("score").alias("s0"))
    parts = []
    for c in columns:
        swapped = scored(model, assemble(rows.withColumn(c, F.col(f"_o_{c}")), columns), key).select(key, "score")
        parts.append(swapped.join(plain, key).agg(F.avg(F.abs(F.col("score") - F.col("s0"))).alias("importance")).select(F.lit(c).alias("feature"), "importance"))
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("importance"), "feature")


def calibrate_isotonic(held_out: DataFrame, scores: DataFrame, width: float = 1e-4) -> DataFrame:
    """Calibrated probability of every row of ``scores``, fitted on the labels of ``held_out``.

    Scores are rounded to ``width`` before the fit, so the fit pools at most ``1 / width`` rows whatever the input.
    """
    binned = held_out.withColumn("score", F.round(F.col("score") / F.lit(width)) * F.lit(width))
    merged = binned.groupBy("score").agg(F.avg(LABEL).alias("rate"), F.count("*").cast("double").alias("w"))
    model = IsotonicRegression(featuresCol="score", labelCol="rate", weightCol="w", predictionCol="calibrated").fit(merged)
    return model.transform(scores)


# --- decisions -------------------------------------------------------------------------------------------

def profit_score(report: DataFrame) -> DataFrame:
    return report.withColumn("profit_score", F.col("precision") * 100 - (1 - F.col("recall")) * 500)


def result_checks(report: DataFrame) -> DataFrame:
    """Plausibility verdict per model; ``report`` has accuracy, roc_auc and overfit_gap."""
    verdict = first_match([(F.col("accuracy") > 0.95, "accuracy too high"), (F.col("overfit_gap") > 0.1, "overfit")], "reasonable")
    return report.withColumns({"verdict": verdict, "auc_in_range": flag(F.col("roc_auc").between(0.65, 0.85))})


def scoring_pipeline(columns: list[str], estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="error"),
                            StandardScaler(inputCol="raw", outputCol=FEATURES, withMean=True), estimator])


def batch_score(model: PipelineModel, df: DataFrame, key: str) -> DataFrame:
    p = vector_to_array("probability")[1]
    return model.transform(df).select(key, p.alias("churn_probability"), flag(p > 0.5).alias("will_churn"))


def kmeans_segments(df: DataFrame, columns: list[str], k: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Cluster per row on standardised columns, and the profile of the clusters."""
    data = df.fillna(0, columns).withColumns({c: F.col(c).cast("double") for c in columns})
    pipe = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol=FEATURES, withMean=True),
                            KMeans(k=k, seed=seed, featuresCol=FEATURES, predictionCol="cluster")])
    out = pipe.fit(data).transform(data).drop("raw", FEATURES)
    profile = out.groupBy("cluster").agg(F.count("*").alias("members"), *[F.round(F.avg(c), 2).alias(c) for c in columns])
    return out, profile
