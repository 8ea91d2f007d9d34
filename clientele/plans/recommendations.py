"""Queries on ratings, neighbourhoods, recommendations and product or customer networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import flag, one_row
from ..functions.staging import stage, staging_path
from ..operators import features as ft
from ..operators import graphs as gr
from ..operators import pairs as pr
from ..operators import recommend as rc
from ..operators import relational as rel
from ..sources import io
from ..sources.star import Star
from .prelude import PRE, r, rnd
from .registry import REG

P, I = ft.PERSON, rc.ITEM


def lines(spark, sf):
    s = Star(spark, sf)
    return rc.purchases(s.orders(), s.items())


def implicit(spark, sf):
    return stage(rc.implicit_ratings(lines(spark, sf)).select(P, I, "rating"), "ratings")


def explicit(spark, sf):
    s = Star(spark, sf)
    return stage(rc.explicit_ratings(lines(spark, sf), s.reviews()), "ratings")


def branded(spark, sf):
    """Order lines by product brand: few products, so that pairs repeat."""
    s = Star(spark, sf)
    return s.items().join(s.products(), I).select("order_id", F.col("product_brand"))


HASH = lambda text: f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0)"
RAT = PRE + f""", ln AS (SELECT customer_unique_id AS u, product_id AS i, order_id, price FROM itm JOIN ord USING (order_id)),
im0 AS (SELECT u, i, count(*) AS n, round(sum(price), 2) / count(*) AS p FROM ln GROUP BY 1, 2),
im AS (SELECT u, i, n, p, round(n * 0.7::DOUBLE + p / max(p) OVER () * 1.5::DOUBLE, 6) AS rating FROM im0),
ex0 AS (SELECT u, i, avg(coalesce(review_score, 3.5)) AS rating FROM ln LEFT JOIN rev USING (order_id) GROUP BY 1, 2),
ex AS (SELECT u, i, least(5, greatest(1, rating)) AS rating FROM ex0 WHERE u IN (SELECT u FROM ex0 GROUP BY 1 HAVING count(*) >= 5) AND i IN (SELECT i FROM ex0 GROUP BY 1 HAVING count(*) >= 10))
"""


def cos_sql(name: str, table: str, member: str, dim: str, low: float) -> str:
    return f""", {name}n AS (SELECT {member} AS m, sqrt(sum(rating * rating)) AS nn FROM {table} GROUP BY 1),
  {name}v AS (SELECT {member} AS m, {dim} AS d, rating / nn AS w FROM {table} JOIN {name}n ON {member} = m),
  {name} AS (SELECT * FROM (SELECT a.m AS a, b.m AS b, sum(a.w * b.w) AS similarity FROM {name}v a JOIN {name}v b ON a.d = b.d AND a.m < b.m GROUP BY 1, 2) WHERE similarity >= {low})"""


@REG.add("implicit_ratings", RAT + f"SELECT u AS customer_unique_id, i AS product_id, n AS purchase_count, p AS avg_price, {r('rating', 5, 'rating')} FROM im")
def _(spark, sf):
    return rc.implicit_ratings(lines(spark, sf)).select(P, I, "purchase_count", "avg_price", *rnd("rating", digits=5))


@REG.add("explicit_ratings", RAT + f"SELECT u AS customer_unique_id, i AS product_id, {r('rating', 5, 'rating')} FROM ex")
def _(spark, sf):
    s = Star(spark, sf)
    return rc.explicit_ratings(lines(spark, sf), s.reviews()).select(P, I, *rnd("rating", digits=5))


@REG.add("item_cosine", RAT + cos_sql("c", "im", "i", "u", 0.1) + f" SELECT a, b, {r('similarity', 6, 'similarity')} FROM c")
def _(spark, sf):
    return rc.item_cosine(implicit(spark, sf), 0.1).select("a", "b", *rnd("similarity", digits=6))


@REG.add("user_cosine", RAT + cos_sql("c", "im", "u", "i", 0.1) + f" SELECT a, b, {r('similarity', 6, 'similarity')} FROM c")
def _(spark, sf):
    return rc.user_cosine(implicit(spark, sf), 0.1).select("a", "b", *rnd("similarity", digits=6))


TWO_WAYS = ", w AS (SELECT a AS m, b AS o, round(similarity, 10) AS s FROM c UNION ALL SELECT b, a, round(similarity, 10) FROM c)"


@REG.add("similar_items", RAT + cos_sql("c", "im", "i", "u", 0.05) + TWO_WAYS + f""", k AS (SELECT m, o, s, category, row_number() OVER (PARTITION BY m ORDER BY s DESC, o) AS rank FROM w JOIN prod ON o = product_id)
  SELECT m AS member, o AS other, category, {r('s', 6, 'similarity')}, rank FROM k WHERE rank <= 10""")
def _(spark, sf):
    out = rc.similar_items(rc.item_cosine(implicit(spark, sf), 0.05), Star(spark, sf).products(), 10)
    return out.select("member", "other", "category", *rnd("similarity", digits=6), "rank")


@REG.add("similar_items_fallback", RAT + cos_sql("c", "im", "i", "u", 0.12) + TWO_WAYS + f""", k AS (SELECT m, o, s, category, row_number() OVER (PARTITION BY m ORDER BY s DESC, o) AS rank FROM w JOIN prod ON o = product_id),
  pc AS (SELECT product_id AS o, count(*) AS n FROM itm GROUP BY 1), pp AS (SELECT o, n, n / max(n) OVER () AS sc FROM pc ORDER BY n DESC, o LIMIT 10),
  f AS (SELECT m, o, sc, n, category FROM (SELECT DISTINCT product_id AS m FROM itm) ANTI JOIN k USING (m), pp JOIN prod ON o = product_id WHERE m <> o)
  SELECT m AS member, o AS other, category, {r('s', 6, 'score')}, rank, 'similarity' AS method FROM k WHERE rank <= 10 UNION ALL SELECT m, o, category, {r('sc', 6)}, row_number() OVER (PARTITION BY m ORDER BY n DESC, o), 'popularity' FROM f""")
def _(spark, sf):
    s = Star(spark, sf)
    similar = rc.similar_items(rc.item_cosine(implicit(spark, sf), 0.12), s.products(), 10)
    out = rc.with_popular_fallback(stage(similar, "similar"), s.items(), rc.popular_items(s.items(), s.products(), 10))
    return out.select("member", "other", "category", *rnd("score", digits=6), "rank", "method")


def knn_sql(ratings: str) -> str:
    return cos_sql("c", ratings, "u", "i", 0.0) + TWO_WAYS + f""", nb AS (SELECT * FROM (SELECT m, o, s, row_number() OVER (PARTITION BY m ORDER BY s DESC, o) AS k FROM w) WHERE k <= 10),
  sc AS (SELECT m, i, round(sum(s * rating), 8) AS score FROM nb JOIN {ratings} ON o = u GROUP BY 1, 2), fr AS (SELECT * FROM sc ANTI JOIN {ratings} x ON m = x.u AND sc.i = x.i),
  rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY score DESC, i) AS rank FROM fr) WHERE rank <= 10)"""


@REG.add("user_recs_knn", RAT + knn_sql("im") + f" SELECT m AS user, i AS product_id, {r('score', 6, 'score')}, rank FROM rec")
def _(spark, sf):
    ratings = implicit(spark, sf)
    return rc.recommend_by_neighbours(ratings).select("user", I, *rnd("score", digits=6), "rank")


@REG.add("anti_join_purchased", RAT + ", top AS (SELECT i FROM ln GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5), c AS (SELECT DISTINCT ln.u, top.i FROM ln, top) SELECT c.u AS customer_unique_id, c.i AS product_id FROM c ANTI JOIN ln ON ln.u = c.u AND ln.i = c.i")
def _(spark, sf):
    bought = lines(spark, sf)
    top = one_row(rel.top_groups(bought, I, 5).agg(F.collect_list(I).alias("t"))).getField("t")   # five ids
    candidates = bought.select(P).distinct().withColumn(I, F.explode(top))
    return rc.anti_join_purchased(candidates, bought)


@REG.add("popular_items", PRE + f", c AS (SELECT product_id, count(*) AS order_count, avg(price) AS a FROM itm GROUP BY 1), t AS (SELECT *, order_count / max(order_count) OVER () AS p FROM c ORDER BY order_count DESC, product_id LIMIT 10) SELECT product_id, order_count, {r('a', 3, 'avg_price')}, {r('p', 6, 'popularity_score')}, category FROM t JOIN prod USING (product_id)")
def _(spark, sf):
    s = Star(spark, sf)
    return rc.popular_items(s.items(), s.products(), 10).select(I, "order_count", *rnd("avg_price", digits=3), *rnd("popularity_score", digits=6), "category")


KNN_ARMS = {"cosine": ("sxy", "sqrt(sxx * syy)"),
            "pearson": ("n * sxy - sx * sy", "sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))")}


def knn_predict_sql(kind: str) -> str:
    num, den = KNN_ARMS[kind]
    gain, base = ("rv - mv", "coalesce(mean, gm)") if kind == "pearson" else ("rv", "gm")
    value = f"CASE WHEN coalesce(k, 0) >= 5 THEN {'coalesce(mean, gm) + e' if kind == 'pearson' else 'e'} ELSE {base} END"
    return RAT + f""", hx AS (SELECT *, {HASH("u::VARCHAR || '|' || i::VARCHAR || '|42'")} AS h FROM ex), tr AS (SELECT u, i, rating FROM hx WHERE h >= 0.2), te AS (SELECT u, i, rating FROM hx WHERE h < 0.2),
  mn AS (SELECT u, avg(rating) AS mean FROM tr GROUP BY 1), g AS (SELECT avg(rating) AS gm FROM tr),
  wt AS (SELECT te.u, te.i, tr.u AS v, tr.rating AS rv, mn.mean AS mv FROM te JOIN tr ON te.i = tr.i AND te.u <> tr.u JOIN mn ON mn.u = tr.u),
  sm AS (SELECT p.u, p.v, count(*) AS n, sum(x.rating) AS sx, sum(y.rating) AS sy, sum(x.rating * y.rating) AS sxy, sum(x.rating * x.rating) AS sxx, sum(y.rating * y.rating) AS syy
    FROM (SELECT DISTINCT u, v FROM wt) p JOIN tr x ON x.u = p.u JOIN tr y ON y.u = p.v AND y.i = x.i GROUP BY 1, 2),
  sims AS (SELECT u, v, round(({num}) / nullif({den}, 0), 10) AS s FROM sm), near AS (SELECT *, row_number() OVER (PARTITION BY u, i ORDER BY s DESC, v) AS k FROM wt JOIN sims USING (u, v) WHERE s > 0),
  est AS (SELECT u, i, count(*) AS k, sum(s * ({gain})) / sum(s) AS e FROM near WHERE k <= 20 GROUP BY 1, 2)
  SELECT te.u, te.i AS target, coalesce(k, 0) AS neighbours, {r(f'greatest(1, least(5, {value}))', 5, 'prediction')} FROM te LEFT JOIN est USING (u, i) LEFT JOIN mn USING (u), g"""


def _knn(name: str, kind: str) -> None:
    @REG.add(name, knn_predict_sql(kind))
    def _(spark, sf):
        train, test = rc.hold_out(explicit(spark, sf))
        return rc.predict_knn(train, test, centred=kind == "pearson").select("u", "target", "neighbours", *rnd("prediction", digits=5))


_knn("knn_rating_predict", "cosine")
_knn("knn_rating_predict_centred", "pearson")


@REG.add("hit_rate", RAT + f""", hx AS (SELECT u, i, rating, {HASH("u::VARCHAR || '|' || i::VARCHAR || '|42'")} AS h FROM im), tr AS (SELECT u, i, rating FROM hx WHERE h >= 0.2), te AS (SELECT u, i FROM hx WHERE h < 0.2)""" + knn_sql("tr")
         + f" SELECT count(*) AS held_out, count(rank) AS hits, {r('count(rank) / count(*)', 6, 'hit_rate')} FROM te LEFT JOIN rec ON te.u = rec.m AND te.i = rec.i")
def _(spark, sf):
    train, test = rc.hold_out(implicit(spark, sf))
    recs = rc.recommend_by_neighbours(stage(train, "train"))
    return rc.hit_rate(recs, test).select("held_out", "hits", *rnd("hit_rate", digits=6))


# Facts on trained factors, as in churn_models: 1 means that the fact holds.

@REG.add("svd_factors", "SELECT 50 AS n_components, 1 AS falling, 1 AS norms_agree, 1 AS within_total")
def _(spark, sf):
    ratings = implicit(spark, sf)
    users, _, values = rc.truncated_svd(ratings, rank=50)
    norms = users.agg(*[F.sqrt(F.sum(F.col(f"f{i}") ** 2)).alias(f"n{i}") for i in range(50)]).first()       # one row
    found = [r["singular_value"] for r in values.orderBy("component").collect()]                             # 50 rows
    total = ratings.agg(F.sum(F.col("rating") ** 2)).first()[0]
    agree = all(abs(norms[i] - v) <= 1e-6 * found[0] for i, v in enumerate(found))
    return spark.createDataFrame([(len(found), int(found == sorted(found, reverse=True)), int(agree), int(sum(v * v for v in found) <= total * (1 + 1e-9)))],
                                 "n_components int, falling int, norms_agree int, within_total int")


def factor_recs(spark, sf):
    """Coded ratings and each user's ten recommendations."""
    coded = stage(rc.coded_ratings(implicit(spark, sf)), "coded")
    return coded, rc.recommend_by_factors(coded, rc.als_model().fit(coded), 10)


@REG.add_rows("user_recs_mf")
def _(spark, sf):
    return factor_recs(spark, sf)[1]


@REG.add("user_recs_mf", RAT + "SELECT u AS customer_unique_id, 10 AS n_items, 1 AS unbought, 1 AS ranks_whole FROM im GROUP BY 1")
def _(spark, sf):
    coded, recs = factor_recs(spark, sf)
    bought = coded.select(P, I, F.lit(1).alias("b"))
    return recs.join(bought, [P, I], "left").groupBy(P).agg(F.countDistinct(I).cast("int").alias("n_items"), F.min(flag(F.col("b").isNull())).alias("unbought"),
                                                             flag((F.min("rank") == 1) & (F.max("rank") == F.count("*"))).alias("ranks_whole"))


def factor_errors(spark, sf):
    """Errors of the factor models by the operator's own folds, rounds and grid."""
    return rc.compare_factor_models(stage(rc.coded_ratings(explicit(spark, sf)), "coded"))


@REG.add_rows("als_train_eval")
def _(spark, sf):
    return factor_errors(spark, sf)


@REG.add("als_train_eval", "SELECT *, 1 AS mae_below_rmse FROM (VALUES ('als'), ('als_tuned'), ('nmf'), " + ", ".join(f"('als rank {r} reg {g}')" for r in (30, 50, 70) for g in (0.1, 0.2, 0.3)) + ") t(model)")
def _(spark, sf):
    return factor_errors(spark, sf).select("model", flag((F.col("mae") <= F.col("rmse")) & (F.col("rmse") > 0) & (F.col("rmse") < 5)).alias("mae_below_rmse"))


# --- networks ---------------------------------------------------------------------------------------

EDGES = PRE + """, bi AS (SELECT order_id, brand, count(*) AS w FROM itm JOIN prod USING (product_id) GROUP BY 1, 2),
bedge AS (SELECT a.brand AS a, b.brand AS b, CAST(sum(a.w * b.w) AS BIGINT) AS weight FROM bi a JOIN bi b ON a.order_id = b.order_id AND a.brand < b.brand GROUP BY 1, 2 HAVING sum(a.w * b.w) >= {low})"""
PAIRS = PRE + """, pi AS (SELECT order_id, product_id, count(*) AS w FROM itm GROUP BY 1, 2), tp AS (SELECT a.product_id AS a, b.product_id AS b, CAST(sum(a.w * b.w) AS BIGINT) AS weight FROM pi a JOIN pi b ON a.order_id = b.order_id AND a.product_id < b.product_id GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20)"""


@REG.add("co_purchase_edges", EDGES.replace("{low}", "5") + " SELECT a, b, weight FROM bedge")
def _(spark, sf):
    return pr.co_occurrence(branded(spark, sf), member="product_brand", min_weight=5)


@REG.add("self_join_pairs", PAIRS.replace(" LIMIT 20", "").replace("GROUP BY 1, 2 ORDER BY", "GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 2 ORDER BY") + " SELECT a, b, weight FROM tp")
def _(spark, sf):
    return pr.co_occurrence(Star(spark, sf).items(), min_weight=2)


@REG.add("graph_stats", EDGES.replace("{low}", "60") + f", d AS (SELECT n, count(*) AS g FROM (SELECT a AS n FROM bedge UNION ALL SELECT b FROM bedge) GROUP BY 1) SELECT count(*) AS num_nodes, CAST(sum(g) / 2 AS BIGINT) AS num_edges, {r('sum(g) / count(*)', 6, 'avg_degree')}, {r('sum(g) / (count(*) * (count(*) - 1))', 6, 'density')} FROM d")
def _(spark, sf):
    edges = pr.co_occurrence(branded(spark, sf), member="product_brand", min_weight=60)
    return gr.graph_stats(edges).select("num_nodes", "num_edges", *rnd("avg_degree", "density", digits=6))


@REG.add("graph_degrees", EDGES.replace("{low}", "60") + " SELECT n AS node, count(*) AS degree FROM (SELECT a AS n FROM bedge UNION ALL SELECT b FROM bedge) GROUP BY 1")
def _(spark, sf):
    return gr.degrees(pr.co_occurrence(branded(spark, sf), member="product_brand", min_weight=60))


@REG.add("graph_communities", PAIRS.replace(" LIMIT 20", "").replace("GROUP BY 1, 2 ORDER BY", "GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 2 ORDER BY") + " SELECT a AS node, 0 AS could_do_better FROM (SELECT a FROM tp UNION SELECT b FROM tp)")
def _(spark, sf):
    edges = stage(pr.co_occurrence(Star(spark, sf).items(), min_weight=2), "edges")
    found = stage(gr.communities(edges), "communities")
    # a community could do better if a merge with a neighbour raised the modularity
    of = lambda c: found.select(F.col("node").alias(c), F.col("community").alias(f"c_{c}"))
    sides = edges.select(F.explode(F.array("a", "b")).alias("node"), F.col("weight").cast("double").alias("w")).join(found, "node")
    sums = sides.groupBy("community").agg(F.sum("w").alias("k"))
    m = one_row(edges.agg(F.sum("weight").cast("double").alias("m"))).getField("m")
    k = lambda c: sums.select(F.col("community").alias(f"c_{c}"), F.col("k").alias(f"k_{c}"))
    between = edges.join(of("a"), "a").join(of("b"), "b").where("c_a <> c_b").groupBy(F.least("c_a", "c_b").alias("c_a"), F.greatest("c_a", "c_b").alias("c_b")).agg(F.sum("weight").cast("double").alias("w"))
    gains = between.join(k("a"), "c_a").join(k("b"), "c_b").where(F.col("w") / m - F.col("k_a") * F.col("k_b") / (2 * m * m) > 1e-9)
    better = gains.select(F.explode(F.array("c_a", "c_b")).alias("community")).distinct().withColumn("could", F.lit(1))
    return found.join(better, "community", "left").select("node", F.coalesce("could", F.lit(0)).alias("could_do_better"))


@REG.add("customer_similarity_edges", RAT + ", act AS (SELECT u FROM ex GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 100), sub AS (SELECT * FROM ex SEMI JOIN act USING (u))" + cos_sql("c", "sub", "u", "i", 0.05) + f" SELECT a, b, {r('similarity', 6, 'weight')} FROM c WHERE similarity > 0.05")
def _(spark, sf):
    return gr.customer_similarity_edges(explicit(spark, sf), 100, 0.05).select("a", "b", *rnd("weight", digits=6))


@REG.add("sink_graph_edges", EDGES.replace("{low}", "60") + " SELECT a, b, weight, da.degree AS degree_a FROM bedge JOIN (SELECT n, count(*) AS degree FROM (SELECT a AS n FROM bedge UNION ALL SELECT b FROM bedge) GROUP BY 1) da ON n = a")
def _(spark, sf):
    edges = stage(pr.co_occurrence(branded(spark, sf), member="product_brand", min_weight=60), "edges")
    path = staging_path(spark, "graph")
    io.sink_graph(gr.degrees(edges), edges, path)
    nodes = io.scan_parquet(spark, f"{path}/vertices").select(F.col("node").alias("a"), F.col("degree").alias("degree_a"))
    return io.scan_parquet(spark, f"{path}/edges").join(nodes, "a")


@REG.add("top_pairs", PAIRS + " SELECT a, b, weight, pa.category AS category_a, pb.category AS category_b FROM tp LEFT JOIN prod pa ON a = pa.product_id LEFT JOIN prod pb ON b = pb.product_id")
def _(spark, sf):
    s = Star(spark, sf)
    return gr.with_categories(pr.top_pairs(s.items()), s.products())


@REG.add("cross_category_pairs", PAIRS.replace(" ORDER BY 3 DESC, 1, 2 LIMIT 20", "") + " SELECT a, b, weight, pa.category AS category_a, pb.category AS category_b FROM tp LEFT JOIN prod pa ON a = pa.product_id LEFT JOIN prod pb ON b = pb.product_id WHERE pa.category <> pb.category ORDER BY weight DESC, a, b LIMIT 10")
def _(spark, sf):
    s = Star(spark, sf)
    return pr.top_pairs(s.items(), 10, wanted=gr.across_categories(s.products()))
