"""Collaborative filtering as batch jobs over all users at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.core import one_row, ratio
from ..functions.order_stats import dense_codes
from ..functions.sampling import unit_hash
from ..functions.staging import drop_staged, free_shuffles, stage
from .cosine import WHOLE, Lists, cosine_pairs, nearest_members
from .factor_models import Setting, cross_validated_errors
from .features import PERSON
from .inner_products import top_inner_products
from .pairs import both_ways
from .rating_neighbours import neighbour_estimates
from .relational import topk_per_group

ITEM = "product_id"
SPREAD = 150_000_000                 # numbers of factor vectors that ratings carry through a shuffle at once, about


# --- ratings ------------------------------------------------------------------------------------

def purchases(orders: DataFrame, items: DataFrame) -> DataFrame:
    return items.select("order_id", ITEM, "price").join(orders.select("order_id", PERSON), "order_id")


def implicit_ratings(lines: DataFrame) -> DataFrame:
    """0.7 x purchases + 1.5 x mean price relative to the highest mean price."""
    pairs = lines.groupBy(PERSON, ITEM).agg(F.count("*").alias("purchase_count"),
                                            ratio(F.round(F.sum("price"), 2), F.count("*")).alias("avg_price"))
    top = one_row(pairs.agg(F.max("avg_price").alias("m"))).getField("m")
    return pairs.withColumn("rating", F.round(F.col("purchase_count") * 0.7 + ratio("avg_price", top) * 1.5, 6))


def explicit_ratings(lines: DataFrame, reviews: DataFrame, min_user: int = 5, min_item: int = 10) -> DataFrame:
    """Mean review score per user and item (3.5 where there is none), for users and items with enough ratings."""
    score = reviews.groupBy("order_id").agg(F.avg("review_score").alias("review_score"))
    pairs = (lines.join(score, "order_id", "left").groupBy(PERSON, ITEM)
                  .agg(F.avg(F.coalesce("review_score", F.lit(3.5))).alias("rating")))
    users = pairs.groupBy(PERSON).agg(F.count("*").alias("n")).where(F.col("n") >= min_user)
    items = pairs.groupBy(ITEM).agg(F.count("*").alias("n")).where(F.col("n") >= min_item)
    kept = pairs.join(users, PERSON, "left_semi").join(items, ITEM, "left_semi")
    return kept.withColumn("rating", F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.col("rating"))))


# --- neighbourhoods ----------------------------------------------------------------------------------

def item_cosine(ratings: DataFrame, min_similarity: float = 0.0) -> DataFrame:
    return cosine_pairs(ratings, ITEM, PERSON, min_similarity=min_similarity)


def user_cosine(ratings: DataFrame, min_similarity: float = 0.0) -> DataFrame:
    return cosine_pairs(ratings, PERSON, ITEM, min_similarity=min_similarity)


def nearest_users(ratings: DataFrame, k: int = 10) -> DataFrame:
    return nearest_members(ratings, PERSON, ITEM, k)


def popular_items(items: DataFrame, products: DataFrame, n: int = 10, category: str = "product_category_name") -> DataFrame:
    counts = items.groupBy(ITEM).agg(F.count("*").alias("order_count"), F.avg("price").alias("avg_price"))
    top = one_row(counts.agg(F.max("order_count").alias("m"))).getField("m")
    best = counts.withColumn("popularity_score", ratio("order_count", top)).orderBy(F.desc("order_count"), ITEM).limit(n)
    return best.join(products.select(ITEM, F.col(category).alias("category")), ITEM)


def similar_items(pairs: DataFrame, products: DataFrame, n: int = 10, category: str = "product_category_name") -> DataFrame:
    """Most similar items of each item; items outside the catalogue are left out before ranking, so a
    score always stays with its item."""
    listed = products.select(F.col(ITEM), F.col(category).alias("category"))
    both = both_ways(pairs.withColumn("similarity", F.round("similarity", 10)), "similarity")
    known = both.join(listed.withColumnRenamed(ITEM, "other"), "other")
    return topk_per_group(known, ["member"], [F.desc("similarity"), F.asc("other")], n)


def with_popular_fallback(similar: DataFrame, items: DataFrame, popular: DataFrame) -> DataFrame:
    """Items without any similar item get the popular ones instead."""
    without = items.select(F.col(ITEM).alias("member")).distinct().join(similar, "member", "left_anti")
    # the popular list is a top-n report, so it fits into one scalar array
    listed = one_row(popular.agg(F.collect_list(F.struct(F.col(ITEM).alias("other"), "category", "popularity_score", "order_count")).alias("p")))
    filler = without.withColumn("p", F.explode(listed.getField("p"))).select("member", "p.*")
    rows = topk_per_group(filler.where("member <> other"), ["member"], [F.desc("order_count"), F.asc("other")], 10)
    cols = ["member", "other", "category", "score", "rank", "method"]
    a = similar.withColumn("score", F.col("similarity")).withColumn("method", F.lit("similarity")).select(*cols)
    return a.unionByName(rows.withColumn("score", F.col("popularity_score")).withColumn("method", F.lit("popularity")).select(*cols))


def recommend_by_neighbours(ratings: DataFrame, n: int = 10, k: int = 10, plan: Lists = Lists()) -> DataFrame:
    """Items rated by the ``k`` nearest users, scored by similarity x rating, without those already bought.

    The neighbours' ratings are many times the ratings, so users are taken in several passes, and the files of a pass are deleted
    before the next.
    """
    near = nearest_users(ratings, k).select(F.col("member").alias("user"), F.col("other").alias(PERSON), "similarity")
    near = stage(near, "near")
    free_shuffles(near.sparkSession)
    had = ratings.groupBy(PERSON).agg(F.count("*").alias("c"))
    met, held = near.join(had, PERSON).agg(F.sum("c")).first()[0] or 0, ratings.count()
    passes, found = plan.passes(met, held), None
    for i in range(passes):
        here = lambda c: F.pmod(F.xxhash64(c), F.lit(passes)) == i if passes > 1 else F.lit(True)
        scores = (near.where(here("user")).join(ratings.select(PERSON, ITEM, "rating"), PERSON).groupBy("user", ITEM)
                      .agg(F.round(F.sum(F.col("similarity") * F.col("rating")), 8).alias("score")))
        fresh = scores.join(ratings.where(here(PERSON)).select(F.col(PERSON).alias("user"), ITEM), ["user", ITEM], "left_anti")
        best = topk_per_group(fresh, ["user"], [F.desc("score"), F.asc(ITEM)], n)
        if passes > 1:
            best = stage(best, "recommended")
            free_shuffles(near.sparkSession)
        found = best if found is None else found.unionByName(best)
    return found


def anti_join_purchased(candidates: DataFrame, ratings: DataFrame) -> DataFrame:
    return candidates.join(ratings.select(PERSON, ITEM), [PERSON, ITEM], "left_anti")


def hold_out(ratings: DataFrame, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test ratings by a hash of user and item; both parts are reproducible."""
    u = unit_hash(F.col(PERSON), F.col(ITEM), seed)
    return ratings.where(u >= share), ratings.where(u < share)


def hit_rate(recommended: DataFrame, test: DataFrame) -> DataFrame:
    """Share of held-out purchases found among the recommendations made from the rest."""
    held = test.select(F.col(PERSON).alias("user"), ITEM)
    found = held.join(recommended.select("user", ITEM).withColumn("hit", F.lit(1)), ["user", ITEM], "left")
    return found.agg(F.count("*").alias("held_out"), F.count("hit").alias("hits"), ratio(F.count("hit"), F.count("*")).alias("hit_rate"))


def predict_knn(train: DataFrame, test: DataFrame, k: int = 20, min_k: int = 5, centred: bool = False,
                shrinkage: float = 0.0) -> DataFrame:
    """Rating prediction from users who rated the item, weighted by similarity over common items.

    ``centred=False`` uses the cosine over common items; ``centred=True`` uses Pearson correlation and
    predicts deviations from user means. Only positive similarities count; with fewer than ``min_k``
    neighbours the prediction is the global mean (or the user's mean).
    """
    means = train.groupBy(PERSON).agg(F.avg("rating").alias("_mean"))
    targets = test.select(F.col(PERSON).alias("u"), F.col(ITEM).alias("target"), F.col("rating").alias("actual"))
    users, user = _whole_numbers(train, test, PERSON, "m")
    items, item = _whole_numbers(train, test, ITEM, "d")
    known = items(users(train.join(means, PERSON))).select("m", "d", F.col("rating").cast("double").alias("w"), F.col("_mean").alias("mean"))
    wanted = items(users(test)).select("m", "d")
    found = neighbour_estimates(known.where("m IS NOT NULL AND d IS NOT NULL AND w IS NOT NULL"), wanted.where("m IS NOT NULL AND d IS NOT NULL"), k, centred, shrinkage)
    est = item(user(found, "u"), "target").withColumnRenamed("e", "_e")
    whole = one_row(train.agg(F.avg("rating").alias("m"))).getField("m")
    out = targets.join(est, ["u", "target"], "left").join(means.withColumnRenamed(PERSON, "u"), "u", "left")
    enough = F.coalesce(F.col("neighbours"), F.lit(0)) >= min_k
    if centred:
        base = F.coalesce("_mean", whole)
        value = F.when(enough, base + F.col("_e")).otherwise(base)
    else:
        value = F.when(enough, F.col("_e")).otherwise(whole)
    clipped = F.greatest(F.lit(1.0), F.least(F.lit(5.0), value))
    return out.select("u", "target", "actual", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), clipped.alias("prediction"))


def _whole_numbers(train: DataFrame, test: DataFrame, key: str, name: str) -> tuple[Callable, Callable]:
    """Two functions: one adds ``name``, a whole number in the order of ``key``; one turns a column of such numbers back."""
    kind = dict(train.dtypes)[key]
    if kind in WHOLE:
        return lambda d: d.withColumn(name, F.col(key).cast("long")), lambda d, c: d.withColumn(c, F.col(c).cast(kind))
    codes = stage(dense_codes(train.select(key).unionByName(test.select(key)), key, name, "long"), "codes")
    return (lambda d: d.join(codes, key),
            lambda d, c: d.withColumnRenamed(c, "_code").join(codes.select(F.col(name).alias("_code"), F.col(key).alias(c)), "_code").drop("_code"))


def rating_errors(predictions: DataFrame) -> DataFrame:
    e = F.col("prediction") - F.col("actual")
    return predictions.agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


# --- factor models -------------------------------------------------------------------------------------

def truncated_svd(ratings: DataFrame, rank: int = 50, rounds: int = 8, seed: int = 42, extra: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leading singular triplets of the user x item matrix: ``(user factors, item factors, values)``.

    Subspace iteration on the long rating table. A round is two joins with sums (items to users and back);
    only small square matrices visit the driver, to keep the columns orthonormal. ``extra`` more columns
    than wanted speed up convergence and are cut at the end. A join of many ratings is made in several passes.
    """
    cells = stage(ratings.select(PERSON, ITEM, F.col("rating").cast("double").alias("rating")), "svd")
    width = min(rank + extra, cells.select(ITEM).distinct().count(), cells.select(PERSON).distinct().count())
    passes = max(1, -(-cells.count() * width // SPREAD))
    draw = F.array(*[unit_hash(F.col(ITEM), i, seed) - 0.5 for i in range(width)])
    items = _rotate(stage(cells.select(ITEM).distinct().select(ITEM, draw.alias("v")), "svd"), ITEM, width)
    for _ in range(rounds):
        users, before = _spread(cells, items, ITEM, PERSON, passes), items
        drop_staged(before)
        held, before = _spread(cells, users, PERSON, ITEM, passes), users
        drop_staged(before)
        items = _rotate(held, ITEM, width)
    users = _spread(cells, items, ITEM, PERSON, passes)
    power, turn = np.linalg.eigh(_gram(users, width))
    order = np.argsort(power)[::-1][:rank]
    turn, values = turn[:, order], np.sqrt(np.maximum(power[order], 0.0))
    names = ratings.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "component int, singular_value double")
    wide = lambda d, key: d.select(key, *[F.col("v")[j].alias(f"f{j}") for j in range(len(order))])
    return wide(_apply(users, PERSON, turn), PERSON), wide(_apply(items, ITEM, turn), ITEM), names


def _spread(cells: DataFrame, factors: DataFrame, source: str, target: str, passes: int = 1) -> DataFrame:
    """Rating-weighted sums of the factor vectors of all partners, written. In a pass a part of the targets gets all of its ratings."""
    found = None
    for i in range(passes):
        some = cells.where(F.pmod(F.xxhash64(target), F.lit(passes)) == i) if passes > 1 else cells
        scaled = some.join(factors, source).select(target, array_to_vector(F.transform("v", lambda x: x * F.col("rating"))).alias("v"))
        sums = stage(scaled.groupBy(target).agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("v")), "svd")
        free_shuffles(cells.sparkSession)
        found = sums if found is None else found.unionByName(sums)
    return found


def _gram(factors: DataFrame, k: int) -> np.ndarray:
    """Gram matrix, from one small matrix per part of the table."""
    def part(frames):
        total = np.zeros((k, k))
        for f in frames:
            x = np.array(f["v"].tolist()).reshape(-1, k)
            total += x.T @ x
        yield pd.DataFrame({"cell": np.arange(k * k), "v": total.ravel()})

    sums = factors.select("v").mapInPandas(part, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()   # k * k rows
    out = np.zeros(k * k)
    for r in sums:
        out[r["cell"]] = r["v"]
    return out.reshape(k, k)


def _apply(factors: DataFrame, key: str, m: np.ndarray) -> DataFrame:
    """Every factor vector times a small matrix."""
    def turned(frames):
        for f in frames:
            yield pd.DataFrame({key: f[key], "v": list(np.array(f["v"].tolist()).reshape(-1, len(m)) @ m)})

    return factors.select(key, "v").mapInPandas(turned, factors.select(key, "v").schema)


def _rotate(held: DataFrame, key: str, k: int) -> DataFrame:
    """Orthonormal columns of a staged table: divide by the Cholesky factor of the Gram matrix."""
    scale = np.linalg.cholesky(_gram(held, k) + 1e-12 * np.eye(k))
    return _apply(held, key, np.linalg.inv(scale).T)


def als_model(rank: int = 50, reg: float = 0.1, nonnegative: bool = False, iterations: int = 10, seed: int = 42) -> ALS:
    """Every round ends in a checkpoint, after which Spark deletes the round's shuffle files and the checkpoint before."""
    return ALS(userCol="user_code", itemCol="item_code", ratingCol="rating", rank=rank, regParam=reg, maxIter=iterations,
               nonnegative=nonnegative, coldStartStrategy="drop", seed=seed, checkpointInterval=1)


def coded_ratings(ratings: DataFrame) -> DataFrame:
    """Ratings with the integer ids the factor models need."""
    users, items = dense_codes(ratings, PERSON, "user_code"), dense_codes(ratings, ITEM, "item_code")
    return ratings.join(users, PERSON).join(items, ITEM).select(PERSON, ITEM, "user_code", "item_code", F.col("rating").cast("float").alias("rating"))


def recommend_by_factors(coded: DataFrame, model, n: int = 10) -> DataFrame:
    """Best unseen items per user by the model's factors: exact, block by block as far as a user's bound reaches."""
    users = model.userFactors.select(F.col("id").alias("user"), F.col("features").alias("v"))
    items = model.itemFactors.select(F.col("id").alias("item"), F.col("features").alias("v"))
    best = top_inner_products(users, items, coded.select(F.col("user_code").alias("user"), F.col("item_code").alias("item")), n)
    people = coded.select(F.col("user_code").cast("long").alias("user"), PERSON).distinct()
    goods = coded.select(F.col("item_code").cast("long").alias("item"), ITEM).distinct()
    return best.join(people, "user").join(goods, "item").select(PERSON, ITEM, "score", "rank")


def compare_factor_models(coded: DataFrame, folds: int = 5, seed: int = 42, grid: dict | None = None, iterations: int = 20) -> DataFrame:
    """Cross-validated errors of the factor models, best first: ``model``, ``rank``, ``reg``, ``rmse``, ``mae``.

    ``als`` and ``nmf`` have the grid's first setting; ``als_tuned`` is the setting of the grid with the smallest error. All models
    of all folds are trained in one pass. Every setting of the grid has a row of its own besides.
    """
    grid = grid or {"rank": [30, 50, 70], "regParam": [0.1, 0.2, 0.3]}
    fold = F.floor(unit_hash(F.col("user_code"), F.col("item_code"), seed) * folds)
    data = coded.select(F.col("user_code").alias("user"), F.col("item_code").alias("item"), "rating", fold.alias("fold"))
    settings = [Setting(f"als rank {r} reg {g}", r, g) for r in grid["rank"] for g in grid["regParam"]]
    settings.append(Setting("nmf", grid["rank"][0], grid["regParam"][0], True))
    found = cross_validated_errors(data, settings, folds, iterations, seed).drop("n", "nonnegative")
    plain = found.where(F.col("model") == settings[0].name).withColumn("model", F.lit("als"))
    tuned = found.where(F.col("model") != "nmf").orderBy("rmse", "model").limit(1).withColumn("model", F.lit("als_tuned"))
    return found.unionByName(plain).unionByName(tuned).orderBy("rmse", "model")
