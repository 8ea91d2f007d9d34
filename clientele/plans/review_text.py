"""Queries on review texts and word vectors."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.core import flag, one_row
from ..functions.sampling import unit_hash
from ..functions.staging import stage
from ..operators import text as tx
from ..sources.star import Star
from .prelude import r, rnd
from .recommendations import HASH
from .registry import REG

ID = tx.ID


def docs(spark, sf):
    full = tx.corpus(Star(spark, sf).review_texts()).drop("review_comment_message")
    return full.withColumn("clean_words", tx.words(F.col("clean_text")))


def lexicon(table):
    """Stand-in lexicon: the texts are invented words, so every word gets a polarity from a hash, the same in any text and at any scale."""
    known = table.select(F.explode(F.array_distinct("tokens")).alias("token")).distinct()
    return known.select("token", F.round(unit_hash(F.col("token"), "polarity") * 2 - 1, 4).alias("polarity"),
                         F.round(unit_hash(F.col("token"), "subjectivity"), 4).alias("subjectivity"))


def rated(spark, sf):
    table = stage(docs(spark, sf), "corpus")
    return tx.with_aspects(tx.sentiment(table, lexicon(table)))


STOPS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS + tx.DOMAIN_WORDS)
LEN_SQL = "CASE WHEN clean_text = '' THEN 0 ELSE len(string_split(clean_text, ' ')) END"
TXT = rf"""WITH d0 AS (SELECT doc_id AS review_id, 1 + doc_id % 5 AS review_score, doc_id % 150 AS customer_unique_id,
  trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS clean_text FROM documents WHERE text IS NOT NULL),
docs AS (SELECT *, list_filter(string_split(clean_text, ' '), lambda t: t <> '') AS ws, list_filter(string_split(clean_text, ' '), lambda t: length(t) > 2 AND t NOT IN ({STOPS})) AS toks FROM d0),
tk AS (SELECT review_id, review_score, unnest(toks) AS token FROM docs),
wk AS (SELECT review_id, unnest(ws) AS token FROM docs),
lex AS (SELECT token, round({HASH("token || '|polarity'")} * 2 - 1, 4) AS polarity, round({HASH("token || '|subjectivity'")}, 4) AS subjectivity FROM tk GROUP BY 1),
pol0 AS (SELECT review_id, round(sum(polarity) / count(*), 8) AS polarity, round(sum(subjectivity) / count(*), 8) AS subjectivity FROM wk JOIN lex USING (token) GROUP BY 1),
pol AS (SELECT docs.*, coalesce(polarity, 0) AS polarity, coalesce(subjectivity, 0) AS subjectivity FROM docs LEFT JOIN pol0 USING (review_id)),
asp AS (SELECT *, {", ".join("CAST(" + " OR ".join(f"contains(clean_text, '{k}')" for k in keys) + f" AS INTEGER) AS {a}_mentioned" for a, keys in tx.ASPECTS.items())},
  CASE WHEN polarity > 0.1 THEN 'positive' WHEN polarity < -0.1 THEN 'negative' ELSE 'neutral' END AS s3,
  CASE WHEN polarity >= 0.3 THEN 'very_positive' WHEN polarity >= 0.1 THEN 'positive' WHEN polarity >= -0.1 THEN 'neutral' WHEN polarity >= -0.3 THEN 'negative' ELSE 'very_negative' END AS s5 FROM pol),
voc AS (SELECT token AS word, count(*) AS frequency FROM tk GROUP BY 1 HAVING count(*) >= 5),
cov AS (SELECT DISTINCT review_id, 1 AS has_embedding FROM tk WHERE token IN (SELECT word FROM voc))
"""


@REG.add("clean_text", TXT + "SELECT review_id, md5(clean_text) AS digest, length(clean_text) AS chars FROM docs")
def _(spark, sf):
    t = docs(spark, sf)
    return t.select(ID, F.md5("clean_text").alias("digest"), F.length("clean_text").cast("long").alias("chars"))


@REG.add("tokenize", TXT + "SELECT review_id, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens FROM tk GROUP BY 1")
def _(spark, sf):
    counts = tx.token_counts(docs(spark, sf))
    return counts.groupBy(ID).agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct_tokens"))


@REG.add("sentiment_polarity", TXT + f"SELECT review_id, {r('polarity', 6, 'polarity')}, {r('subjectivity', 6, 'subjectivity')}, s3 AS sentiment, s5 AS sentiment_category FROM asp")
def _(spark, sf):
    t = stage(docs(spark, sf), "corpus")
    return tx.sentiment(t, lexicon(t)).select(ID, *rnd("polarity", "subjectivity", digits=6), tx.sentiment_3().alias("sentiment"), tx.sentiment_5().alias("sentiment_category"))


@REG.add("sentiment_by_rating", TXT + "SELECT review_score, count(CASE WHEN s3 = 'negative' THEN 1 END) AS negative, count(CASE WHEN s3 = 'neutral' THEN 1 END) AS neutral, count(CASE WHEN s3 = 'positive' THEN 1 END) AS positive FROM asp GROUP BY 1")
def _(spark, sf):
    t = stage(docs(spark, sf), "corpus")
    return tx.sentiment_by_rating(tx.sentiment(t, lexicon(t)))


@REG.add("aspect_sentiment", TXT + " UNION ALL ".join(f"SELECT '{a}' AS aspect, count(*) AS mentions, {r('avg(polarity)', 6, 'avg_sentiment')} FROM asp WHERE {a}_mentioned = 1 HAVING count(*) > 0" for a in tx.ASPECTS))
def _(spark, sf):
    return tx.aspect_summary(rated(spark, sf)).select("aspect", "mentions", *rnd("avg_sentiment", digits=6))


@REG.add("keywords_by_rating", TXT + ", c AS (SELECT review_score, token, count(*) AS n FROM tk WHERE length(token) > 3 GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_score ORDER BY n DESC, token) AS rank FROM c) WHERE rank <= 20")
def _(spark, sf):
    return tx.keywords_by_rating(docs(spark, sf))


@REG.add("top_phrases", TXT + """, g AS (SELECT token AS phrase FROM tk UNION ALL SELECT unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) FROM docs
  UNION ALL SELECT unnest(list_transform(range(1, len(toks) - 1), lambda i: toks[i] || ' ' || toks[i + 1] || ' ' || toks[i + 2])) FROM docs) SELECT phrase, count(*) AS n FROM g GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, sf):
    return tx.top_phrases(docs(spark, sf), 10)


# Stand-in patterns: the same shape as the library's, on words which the invented texts contain.
STAR_PATTERNS = {"SIZE": r"\b(small|medium|large|xl|xxl|size|tion|ment)\b", "COLOR": r"\b(red|blue|green|black|white|yellow|color|eau|der)\b"}


def entity_sql(label: str, pattern: str) -> str:
    return rf"""SELECT review_id, '{label}' AS label, m[j] AS entity, CAST(list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0) AS INTEGER) AS start
    FROM (SELECT review_id, m, g, unnest(range(1, len(m) + 1)) AS j FROM (SELECT review_id, regexp_extract_all(clean_text, '{pattern}') AS m, regexp_split_to_array(clean_text, '{pattern}') AS g FROM docs))"""


ENT = TXT + ", ents AS (" + " UNION ALL ".join(entity_sql(k, v) for k, v in STAR_PATTERNS.items()) + ")"


@REG.add("scalar_regex_find", ENT + " SELECT review_id, label, entity, start, CAST(start + length(entity) AS INTEGER) AS end_at FROM ents")
def _(spark, sf):
    return tx.regex_entities(docs(spark, sf), STAR_PATTERNS).withColumnRenamed("end", "end_at")


@REG.add("regex_entities", ENT + " SELECT label, entity, count(*) AS count FROM ents GROUP BY 1, 2")
def _(spark, sf):
    return tx.entity_statistics(tx.regex_entities(docs(spark, sf), STAR_PATTERNS))


def colloc_sql(tag: str, source: str, low: int, threshold: float) -> str:
    return f""", {tag}u AS (SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM {source}) GROUP BY 1),
  {tag}p AS (SELECT p.a AS a, p.b AS b, count(*) AS pair_count FROM (SELECT unnest(list_transform(range(1, len(toks)), lambda i: {{'a': toks[i], 'b': toks[i + 1]}})) AS p FROM {source}) GROUP BY 1, 2),
  {tag}c AS (SELECT a, b, pair_count, x.n AS count_a, y.n AS count_b, (pair_count - {low}) / x.n / y.n * ((SELECT count(*) FROM {tag}u) + (SELECT count(*) FROM {tag}p)) AS score
    FROM {tag}p JOIN {tag}u x ON a = x.token JOIN {tag}u y ON b = y.token WHERE pair_count >= {low}),
  {tag} AS (SELECT * FROM {tag}c WHERE score > {threshold})"""


@REG.add("collocations", TXT + colloc_sql("co", "docs", 10, 50) + f" SELECT a, b, pair_count, count_a, count_b, {r('score', 4, 'score')} FROM co")
def _(spark, sf):
    return tx.collocations(stage(docs(spark, sf).select(ID, "tokens"), "corpus")).select("a", "b", "pair_count", "count_a", "count_b", *rnd("score"))


MERGED = """, px AS (SELECT review_id, unnest(range(1, len(toks) + 1)) AS pos, toks FROM docs), pl AS (SELECT review_id, pos, toks[pos] AS a, toks[pos + 1] AS b FROM px),
  ph AS (SELECT review_id, pos, pos - row_number() OVER (PARTITION BY review_id ORDER BY pos) AS run FROM pl SEMI JOIN co USING (a, b)),
  pt AS (SELECT review_id, pos FROM (SELECT *, min(pos) OVER (PARTITION BY review_id, run) AS f FROM ph) WHERE (pos - f) % 2 = 0),
  md AS (SELECT review_id, list(CASE WHEN pt.pos IS NOT NULL THEN a || '_' || b ELSE a END ORDER BY pl.pos) AS toks FROM pl LEFT JOIN pt USING (review_id, pos)
    WHERE NOT EXISTS (SELECT 1 FROM pt e WHERE e.review_id = pl.review_id AND e.pos + 1 = pl.pos) GROUP BY 1)"""


@REG.add("collocations_trigram", TXT + colloc_sql("co", "docs", 10, 50) + MERGED + colloc_sql("tr", "md", 5, 50) + f" SELECT a, b, pair_count, {r('score', 4, 'score')} FROM tr WHERE contains(a, '_') OR contains(b, '_')")
def _(spark, sf):
    return tx.phrase_collocations(stage(docs(spark, sf).select(ID, "tokens"), "corpus")).select("a", "b", "pair_count", *rnd("score"))


@REG.add("vocabulary", TXT + "SELECT word, frequency FROM voc")
def _(spark, sf):
    return tx.vocabulary(docs(spark, sf))


def trained(spark, sf):
    return tx.word_vectors(stage(docs(spark, sf).select(ID, "tokens"), "tokens"))


# Facts on trained vectors and topics, as in churn_models: 1 means that the fact holds.

def vectors(spark, sf):
    return trained(spark, sf).getVectors().select("word", vector_to_array("vector").alias("v"))


@REG.add_rows("word2vec")
def _(spark, sf):
    return vectors(spark, sf)


@REG.add("word2vec", TXT + "SELECT word, 1 AS whole FROM voc")
def _(spark, sf):
    return vectors(spark, sf).select("word", flag((F.size("v") == 100) & F.forall("v", lambda x: ~F.isnan(x)) & F.exists("v", lambda x: x != 0)).alias("whole"))


DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
COS = lambda a, b: f"({DOT.format(a=a, b=b)} / (sqrt({DOT.format(a=a, b=a)}) * sqrt({DOT.format(a=b, b=b)})))"


@REG.add("similar_words", f"WITH t AS (SELECT embedding AS t FROM embeddings WHERE vec_id = 7) SELECT vec_id, {r(COS('embedding', 't'), 5, 'similarity')} FROM embeddings, t WHERE vec_id <> 7 ORDER BY {COS('embedding', 't')} DESC, vec_id LIMIT 10")
def _(spark, sf):
    return tx.similar_words(Star(spark, sf).vectors(), 7, 10, "vec_id", "embedding").select("vec_id", *rnd("similarity", digits=5))


UNIT = lambda v: f"list_transform({v}, lambda x: x::DOUBLE / sqrt({DOT.format(a=v, b=v)}))"


@REG.add("word_analogy", f"""WITH e AS (SELECT x.embedding AS a, y.embedding AS b, z.embedding AS c FROM embeddings x, embeddings y, embeddings z WHERE x.vec_id = 1 AND y.vec_id = 2 AND z.vec_id = 3),
  v AS (SELECT {UNIT('a')} AS a, {UNIT('b')} AS b, {UNIT('c')} AS c FROM e), t AS (SELECT list_transform(range(1, 65), lambda i: b[i] - a[i] + c[i]) AS t FROM v),
  s AS (SELECT vec_id, {COS('embedding', 't')} AS s FROM embeddings, t WHERE vec_id NOT IN (1, 2, 3)) SELECT vec_id, {r('s', 5, 'similarity')} FROM s ORDER BY s DESC, vec_id LIMIT 5""")
def _(spark, sf):
    return tx.word_analogy(Star(spark, sf).vectors(), 1, 2, 3, 5, "vec_id", "embedding").select("vec_id", *rnd("similarity", digits=5))


@REG.add("word_similarity_matrix", f"WITH c AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1) SELECT p.label AS a, q.label AS b, {r(COS('p.v', 'q.v'), 5, 'similarity')} FROM c p, c q")
def _(spark, sf):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    vec = array_to_vector(F.col("embedding").cast("array<double>"))
    centres = Star(spark, sf).vectors().select("label", vec.alias("v")).groupBy("label").agg(Summarizer.mean(F.col("v")).alias("m"))
    return tx.similarity_matrix(centres.select("label", vector_to_array("m").alias("v")), "label", "v").select("a", "b", *rnd("similarity", digits=5))


@REG.add("doc_embedding", TXT + ", tw AS (SELECT review_id, unnest(toks) AS word FROM docs) SELECT review_id, CAST(count(voc.word) > 0 AS INTEGER) AS has_embedding, 1 AS mean_agrees FROM docs LEFT JOIN tw USING (review_id) LEFT JOIN voc USING (word) GROUP BY 1")
def _(spark, sf):
    t = stage(docs(spark, sf).select(ID, "tokens"), "tokens")
    vectors = tx.word_vectors(t).getVectors()
    first = t.select(ID, F.explode("tokens").alias("word")).join(vectors.select("word", vector_to_array("vector")[0].alias("x")), "word").groupBy(ID).agg(F.avg("x").alias("x"))
    out = tx.doc_embeddings(t, vectors, 100).join(first, ID, "left")
    return out.select(ID, "has_embedding", flag(F.abs(F.col("embedding")[0] - F.coalesce("x", F.lit(0.0))) < 1e-6).alias("mean_agrees"))


@REG.add("tfidf", TXT + f""", us AS (SELECT review_id, toks FROM docs WHERE len(toks) > 3), gm AS (SELECT review_id, unnest(toks) AS term FROM us UNION ALL SELECT review_id, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) FROM us),
  tf AS (SELECT review_id, term, count(*) AS n FROM gm GROUP BY 1, 2), df AS (SELECT term, sum(n) AS total, count(*) AS df FROM tf GROUP BY 1), k AS (SELECT count(*) AS k FROM us),
  vo AS (SELECT term, ln((1 + k) / (1 + df)) + 1 AS idf FROM df, k WHERE df >= 5 AND df <= k * 0.8 ORDER BY total DESC, term LIMIT 100), wt AS (SELECT review_id, term, n * idf AS w FROM tf JOIN vo USING (term))
  SELECT review_id, term, {r('w / sqrt(sum(w * w) OVER (PARTITION BY review_id))', 6, 'tfidf')} FROM wt""")
def _(spark, sf):
    return tx.tfidf(stage(docs(spark, sf).select(ID, "tokens"), "corpus")).select(ID, "term", *rnd("tfidf", digits=6))


@REG.add("lda_topics", "SELECT CAST(t AS INTEGER) AS topic, 10 AS n_words, 1 AS falling, 1 AS mixes_whole FROM range(10) r(t)")
def _(spark, sf):
    words, mixes = tx.lda_topics(stage(docs(spark, sf).select(ID, "tokens"), "corpus"))
    total = F.aggregate("topics", F.lit(0.0), lambda s, x: s + x)              # 0 for a text without any of the terms
    whole = one_row(mixes.agg(F.min(flag((F.abs(total - 1) < 1e-6) | (total == 0))).alias("ok"))).getField("ok")
    order = F.sort_array(F.collect_list(F.struct("rank", "weight")))
    falling = lambda a: F.forall(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.get(a, i)["weight"] <= F.get(a, i - 1)["weight"])
    return words.groupBy("topic").agg(F.countDistinct("word").cast("int").alias("n_words"), order.alias("a")).select("topic", "n_words", flag(falling(F.col("a"))).alias("falling"), whole.alias("mixes_whole"))


@REG.add("embedding_clusters", "SELECT count(*) AS n_vectors, 10 AS n_clusters, 1 AS uncorrelated, 1 AS first_is_wider FROM embeddings")
def _(spark, sf):
    out = stage(tx.embedding_clusters(Star(spark, sf).vectors(), 10, "vec_id", "embedding"), "clusters")
    return out.agg(F.count("*").alias("n_vectors"), F.countDistinct("cluster").cast("int").alias("n_clusters"), flag(F.abs(F.corr("x", "y")) < 1e-6).alias("uncorrelated"),
                   flag(F.var_samp("x") >= F.var_samp("y")).alias("first_is_wider"))


def covered(table, counted):
    known = tx.vocabulary(table)
    seen = counted.join(known, F.col("token") == F.col("word"), "left_semi").select(ID).distinct().withColumn("has_embedding", F.lit(1))
    return seen


CTF = ["avg_review_score", "review_score_std", "avg_sentiment_polarity", "sentiment_polarity_std", "avg_subjectivity", "very_positive_ratio", "positive_sentiment_ratio",
       "avg_delivery_sentiment", "avg_quality_sentiment", "avg_price_sentiment", "avg_review_length", "embedding_coverage"]
NZ = lambda a: r(f"coalesce(avg(CASE WHEN {a}_mentioned = 1 AND polarity <> 0 THEN polarity END), 0)", 4, f"avg_{a}_sentiment")


@REG.add("customer_text_features", TXT + f"""SELECT customer_unique_id, {r('avg(review_score)', 4, 'avg_review_score')}, {r('stddev_samp(review_score)', 4, 'review_score_std')}, min(review_score) AS min_review_score, max(review_score) AS max_review_score,
  {r('avg(polarity)', 4, 'avg_sentiment_polarity')}, {r('stddev_samp(polarity)', 4, 'sentiment_polarity_std')}, {r('avg(subjectivity)', 4, 'avg_subjectivity')}, {r("avg(CAST(s5 = 'very_positive' AS INTEGER))", 4, 'very_positive_ratio')}, {r("avg(CAST(s3 = 'positive' AS INTEGER))", 4, 'positive_sentiment_ratio')},
  {", ".join(f"CAST(sum({a}_mentioned) AS BIGINT) AS {a}_mentions" for a in tx.ASPECTS)}, {NZ('delivery')}, {NZ('quality')}, {NZ('price')}, {r(f'avg({LEN_SQL})', 4, 'avg_review_length')}, {r('avg(coalesce(has_embedding, 0))', 4, 'embedding_coverage')}
  FROM asp LEFT JOIN cov USING (review_id) GROUP BY 1""")
def _(spark, sf):
    table = stage(docs(spark, sf), "corpus")
    full = tx.with_aspects(tx.sentiment(table, lexicon(table)))
    seen = covered(table, tx.token_counts(table))
    full = full.join(seen, ID, "left").withColumn("has_embedding", F.coalesce("has_embedding", F.lit(0)))
    return tx.customer_text_features(full).select("customer_unique_id", *rnd(*CTF), "min_review_score", "max_review_score", *[f"{a}_mentions" for a in tx.ASPECTS])


@REG.add("text_insights", TXT + f"""SELECT 'total_reviews' AS fact, 'all' AS name, count(*)::DOUBLE AS value FROM asp UNION ALL SELECT 'reviews_with_text', 'all', count(*)::DOUBLE FROM asp WHERE clean_text <> '' UNION ALL SELECT 'avg_review_length', 'all', {r(f'avg({LEN_SQL})', 4)} FROM asp
  UNION ALL SELECT 'vocabulary_size', 'all', count(*)::DOUBLE FROM voc UNION ALL SELECT 'sentiment', s5, count(*)::DOUBLE FROM asp GROUP BY 2 UNION ALL """ + " UNION ALL ".join(f"SELECT 'mentions_{a}', 'all', sum({a}_mentioned)::DOUBLE FROM asp" for a in tx.ASPECTS))
def _(spark, sf):
    return tx.text_insights(rated(spark, sf)).select("fact", "name", *rnd("value"))
