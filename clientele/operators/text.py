"""Review text analytics. Texts are processed whole; words are counted per text before any shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import IDF, PCA, CountVectorizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import first_match, flag, one_row, ratio
from ..functions.staging import stage
from .relational import topk_per_group
from .skip_gram import SkipGram, WordVectors, fit, mean_vectors

ID = "review_id"

# English stop words of the NLTK corpus, and five words which say nothing in shop reviews.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his",
    "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at",
    "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren",
    "couldn", "didn", "doesn", "hadn", "hasn", "haven", "isn", "ma", "mightn", "mustn", "needn", "shan", "shouldn", "wasn", "weren", "won",
    "wouldn"]
DOMAIN_WORDS = ["product", "order", "delivery", "arrived", "received"]

# Keywords of the five review aspects.
ASPECTS = {
    "delivery": ["delivery", "shipping", "arrived", "fast", "slow", "delay"],
    "quality": ["quality", "good", "bad", "excellent", "poor", "defect"],
    "price": ["price", "expensive", "cheap", "value", "worth", "cost"],
    "packaging": ["package", "packaging", "box", "wrapped", "damaged"],
    "service": ["service", "support", "help", "response", "customer"],
}

# Patterns of size and colour mentions.
ENTITY_PATTERNS = {"SIZE": r"\b(small|medium|large|xl|xxl|size)\b",
                   "COLOR": r"\b(red|blue|green|black|white|yellow|color)\b"}


# --- cleaning and tokens ------------------------------------------------------------------------

def clean_text(c) -> Column:
    """Lower case, only a-z, digits and single spaces."""
    c = F.col(c) if isinstance(c, str) else c
    # a run of anything else becomes one space: one pass instead of one for signs and one for white space
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]++", " "))


def words(clean) -> Column:
    return F.filter(F.split(clean, " "), lambda t: t != "")


def tokens(clean, stop: list[str] = STOP_WORDS + DOMAIN_WORDS, longer_than: int = 2) -> Column:
    return F.filter(F.split(clean, " "), lambda t: (F.length(t) > longer_than) & ~t.isin(stop))


def corpus(reviews: DataFrame, text: str = "review_comment_message") -> DataFrame:
    """Reviews with text, plus ``clean_text`` and ``tokens``."""
    used = reviews.na.drop(subset=[text]).withColumn("clean_text", clean_text(text))
    return used.withColumn("tokens", tokens(F.col("clean_text")))


def token_counts(docs: DataFrame, column: str = "tokens", keep: tuple[str, ...] = (ID,)) -> DataFrame:
    """Word counts per text, in long form. A text is one row, so counting needs no more than its own task
    before the shuffle."""
    return docs.select(*keep, F.explode(column).alias("token")).groupBy(*keep, "token").agg(F.count("*").alias("n"))


# --- sentiment ------------------------------------------------------------------------------------

def sentiment(docs: DataFrame, lexicon: DataFrame, column: str = "clean_words") -> DataFrame:
    """Mean polarity and subjectivity of the lexicon words in each text (0 without any).

    ``lexicon`` has ``token, polarity, subjectivity``; Spark broadcasts it if its measured size allows.
    """
    # words of one text come from one row, so the sums per text combine before the shuffle
    hits = docs.select(ID, F.explode(column).alias("token")).join(lexicon, "token")
    per = hits.groupBy(ID).agg(F.round(F.avg("polarity"), 8).alias("polarity"), F.round(F.avg("subjectivity"), 8).alias("subjectivity"))
    zero = F.lit(0.0)
    return (docs.join(per, ID, "left")
                .withColumns({"polarity": F.coalesce("polarity", zero), "subjectivity": F.coalesce("subjectivity", zero)}))


def sentiment_3(c="polarity") -> Column:
    return first_match([(F.col(c) > 0.1, "positive"), (F.col(c) < -0.1, "negative")], "neutral")


def sentiment_5(c="polarity") -> Column:
    p = F.col(c)
    return first_match([(p >= 0.3, "very_positive"), (p >= 0.1, "positive"), (p >= -0.1, "neutral"), (p >= -0.3, "negative")], "very_negative")


def sentiment_by_rating(docs: DataFrame) -> DataFrame:
    kinds = ["negative", "neutral", "positive"]
    return (docs.withColumn("sentiment", sentiment_3()).groupBy("review_score").pivot("sentiment", kinds).count().fillna(0, kinds))


def with_aspects(docs: DataFrame, aspects: dict[str, list[str]] = ASPECTS) -> DataFrame:
    """Per aspect: mentioned (any keyword occurs) and the text's polarity where it is."""
    out = docs
    for name, keys in aspects.items():
        hit = reduce(lambda a, b: a | b, [F.contains(F.col("clean_text"), F.lit(k)) for k in keys])
        out = out.withColumn(f"{name}_mentioned", flag(hit))
        out = out.withColumn(f"{name}_sentiment", F.when(F.col(f"{name}_mentioned") == 1, F.col("polarity")).otherwise(F.lit(0.0)))
    return out


def aspect_summary(docs: DataFrame, aspects: dict[str, list[str]] = ASPECTS) -> DataFrame:
    sides = [F.struct(F.lit(a).alias("aspect"), F.col(f"{a}_mentioned").alias("m"), F.col(f"{a}_sentiment").alias("s")) for a in aspects]
    long = docs.select(F.explode(F.array(*sides)).alias("x")).where("x.m = 1")
    return long.groupBy("x.aspect").agg(F.count("*").alias("mentions"), F.avg("x.s").alias("avg_sentiment"))


# --- keywords, phrases, entities ----------------------------------------------------------------------

def keywords_by_rating(docs: DataFrame, k: int = 20, longer_than: int = 3) -> DataFrame:
    used = docs.select("review_score", F.explode("tokens").alias("token")).where(F.length("token") > longer_than)
    counts = used.groupBy("review_score", "token").agg(F.count("*").alias("n"))
    return topk_per_group(counts, ["review_score"], [F.desc("n"), F.asc("token")], k)


def ngrams(column, n: int) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    joined = F.transform(neighbours(c, n), lambda x: F.concat_ws(" ", *[x.getField(str(i)) for i in range(n)]))
    return F.when(F.size(c) >= n, F.slice(joined, 1, F.greatest(F.size(c) - (n - 1), F.lit(0)))).otherwise(F.array().cast("array<string>"))


def neighbours(column, n: int = 2) -> Column:
    """A struct per place: the word there and the ``n - 1`` words behind it, null past the end of the text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.arrays_zip(*[(c if i == 0 else F.slice(c, i + 1, F.greatest(F.size(c), F.lit(0)))).alias(str(i)) for i in range(n)])


def top_phrases(docs: DataFrame, k: int = 10, longest: int = 3) -> DataFrame:
    """The ``k`` most frequent phrases of up to ``longest`` words, ties by the phrase.

    A phrase is not more frequent than any of its words, and the k-th most frequent word is a bound of the k-th phrase: longer phrases
    are counted among words that reach it.
    """
    single = stage(docs.select(F.explode("tokens").alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n")), "words")
    floor = single.orderBy(F.desc("n")).limit(k).agg(F.when(F.count("*") == k, F.min("n")).otherwise(F.lit(1)).alias("m"))
    frequent = stage(single.where(F.col("n") >= one_row(floor).getField("m")), "frequent")
    names = [f"w{i}" for i in range(longest)]
    rows = docs.select(F.explode(neighbours("tokens", longest)).alias("x")).select(*[F.col("x").getField(str(i)).alias(w) for i, w in enumerate(names)])
    found = [frequent]
    for i, w in enumerate(names):
        rows = rows.join(frequent.select(F.col("phrase").alias(w)), w, "left_semi")
        if i:
            counts = rows.groupBy(*names[:i + 1]).agg(F.count("*").alias("n"))
            found.append(counts.select(F.concat_ws(" ", *names[:i + 1]).alias("phrase"), "n").groupBy("phrase").agg(F.sum("n").alias("n")))
    phrases = reduce(DataFrame.unionByName, found).groupBy("phrase").agg(F.sum("n").alias("n"))
    return phrases.orderBy(F.desc("n"), "phrase").limit(k)


def regex_entities(docs: DataFrame, patterns: dict[str, str] = ENTITY_PATTERNS) -> DataFrame:
    """All matches with 0-based start and end offsets in the cleaned text."""
    text = F.col("clean_text")
    parts = []
    none = F.array().cast("array<struct<entity:string,start:int,end:int>>")
    for label, pattern in patterns.items():
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        gaps = F.split(text, pattern)
        # walk over (text before match, match) pairs, carrying the offset
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        zipped = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))

        def step(acc, x):
            at = acc["at"] + x["g"]
            hit = F.struct(x["m"].alias("entity"), at.alias("start"), (at + F.length(x["m"])).alias("end"))
            return F.struct((at + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

        spans = F.when(text.rlike(pattern), F.aggregate(zipped, start, step, lambda acc: acc["out"])).otherwise(none)
        name = F.lit(label).alias("label")
        parts.append(F.transform(spans, lambda e: F.struct(name, e["entity"].alias("entity"), e["start"].alias("start"), e["end"].alias("end"))))
    # one pass over the texts for all patterns
    return docs.select(ID, F.explode(F.concat(*parts)).alias("e")).select(ID, "e.label", "e.entity", "e.start", "e.end")


def entity_statistics(entities: DataFrame) -> DataFrame:
    return entities.groupBy("label", "entity").agg(F.count("*").alias("count")).orderBy("label", F.desc("count"), "entity")


def collocations(docs: DataFrame, column: str = "tokens", min_count: int = 10, threshold: float = 50.0) -> DataFrame:
    """Word pairs that occur together more often than chance: (count - min) x V / (count a x count b), where V
    counts the distinct words and neighbouring pairs."""
    # the counts are read twice below and are much smaller than the texts; of pairs below the minimum only their number is kept
    single = stage(docs.select(F.explode(column).alias("token")).groupBy("token").agg(F.count("*").alias("n")), "words")
    both = docs.select(F.explode(neighbours(column)).alias("x")).select(F.col("x").getField("0").alias("a"), F.col("x").getField("1").alias("b"))
    counts = both.where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("pair_count"))
    enough = lambda x: F.when(F.col("pair_count") >= min_count, F.col(x)).alias(x)
    pairs = stage(counts.select(enough("a"), enough("b"), enough("pair_count")).groupBy("a", "b", "pair_count").agg(F.count("*").alias("n")), "pairs")
    size = (one_row(single.agg(F.count("*").alias("n"))).getField("n") + one_row(pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))).getField("n"))
    side = lambda x: single.select(F.col("token").alias(x), F.col("n").alias(f"count_{x}"))
    frequent = pairs.where("pair_count IS NOT NULL").drop("n")
    scored = frequent.join(side("a"), "a").join(side("b"), "b").withColumn(
        "score", (F.col("pair_count") - min_count) / F.col("count_a") / F.col("count_b") * size)
    return scored.where(F.col("score") > threshold)


def merge_collocations(docs: DataFrame, pairs: DataFrame, column: str = "tokens") -> DataFrame:
    """Texts with accepted pairs joined by ``_``, left to right without overlap.

    A text's distinct neighbours are looked up once each; the text then folds its own words by what was found. A null column stays null.
    """
    c = F.col(column)
    near = docs.select(ID, F.explode(neighbours(column)).alias("x")).select(ID, F.col("x").getField("0").alias("a"), F.col("x").getField("1").alias("b"))
    known = near.join(pairs.select("a", "b"), ["a", "b"], "left_semi").groupBy(ID).agg(F.collect_set(F.struct("a", "b")).alias("_pairs"))     # pairs of one text

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words_, found in zip(batch.column("tokens").to_pylist(), batch.column("_pairs").to_pylist()):
                if found:
                    wanted, merged, i = {(p["a"], p["b"]) for p in found}, [], 0
                    while i < len(words_):
                        both = i + 1 < len(words_) and (words_[i], words_[i + 1]) in wanted
                        merged.append(f"{words_[i]}_{words_[i + 1]}" if both else words_[i])
                        i += 1 + both
                    words_ = merged
                out.append(words_)
            yield pa.RecordBatch.from_arrays([batch.column(ID), pa.array(out, pa.list_(pa.string()))], [ID, "tokens"])

    rows = docs.select(ID, c.alias("tokens")).join(known, ID, "left")
    return rows.mapInArrow(fold, f"{ID} {dict(docs.dtypes)[ID]}, tokens array<string>")


def phrase_collocations(docs: DataFrame, min_count: int = 10, threshold: float = 50.0, second_min: int = 5) -> DataFrame:
    """Second pass over merged texts: word triples and quadruples."""
    first = stage(collocations(docs, "tokens", min_count, threshold), "first")
    merged = stage(merge_collocations(docs, first), "merged")
    again = collocations(merged, "tokens", second_min, threshold)
    return again.where(F.contains(F.col("a"), F.lit("_")) | F.contains(F.col("b"), F.lit("_")))


# --- vectors ------------------------------------------------------------------------------------------

def word_vectors(docs: DataFrame, size: int = 100, window: int = 5, min_count: int = 5, rounds: int = 10,
                 seed: int = 42) -> WordVectors:
    """Fitted skip-gram model of the words in ``min_count`` places or more."""
    return fit(docs, vocabulary(docs, min_count), "tokens", SkipGram(size=size, window=window, rounds=rounds, seed=seed))


def vocabulary(docs: DataFrame, min_count: int = 5) -> DataFrame:
    return (docs.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("frequency"))
                .where(F.col("frequency") >= min_count))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a, b) -> Column:
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit(v) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / norm)


def similar_words(vectors: DataFrame, word, n: int = 10, key: str = "word", vector: str = "vector") -> DataFrame:
    """The ``n`` nearest words by cosine; one pass over the vectors against one scalar vector."""
    target = one_row(vectors.where(F.col(key) == word).select(F.col(vector).alias("v")).limit(1)).getField("v")
    rows = vectors.where(F.col(key) != word).withColumn("_target", target)
    scored = rows.select(key, cosine(F.col(vector), F.col("_target")).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), key).limit(n)


def word_analogy(vectors: DataFrame, a, b, c, n: int = 5, key: str = "word", vector: str = "vector") -> DataFrame:
    """a is to b as c is to ?: nearest words to unit(b) - unit(a) + unit(c)."""
    pick = lambda w: F.max(F.when(F.col(key) == w, F.col(vector)))
    three = vectors.where(F.col(key).isin(a, b, c)).agg(pick(a).alias("a"), pick(b).alias("b"), pick(c).alias("c"))
    gap = F.zip_with(unit(F.col("b")), unit(F.col("a")), lambda x, y: x - y)
    target = one_row(three.select(F.zip_with(gap, unit(F.col("c")), lambda x, y: x + y).alias("v"))).getField("v")
    rows = vectors.where(~F.col(key).isin(a, b, c)).withColumn("_target", target)
    scored = rows.select(key, cosine(F.col(vector), F.col("_target")).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), key).limit(n)


def similarity_matrix(chosen: DataFrame, key: str = "word", vector: str = "vector") -> DataFrame:
    """Pairwise cosine of a short list of words or centroids (the list is part of the request)."""
    listed = one_row(chosen.agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vector).alias("v"))).alias("l"))).getField("l")
    rows = chosen.select(F.col(key).alias("a"), F.col(vector).alias("_v"), F.explode(listed).alias("o"))
    return rows.select("a", F.col("o.k").alias("b"), cosine(F.col("_v"), F.col("o.v")).alias("similarity"))


def doc_embeddings(docs: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """Mean word vector per text with coverage flag and norm; zero vector without any known word."""
    known = vectors.select("word", vector_to_array("vector").alias("vector"))
    per = mean_vectors(docs.select(ID, "tokens"), ID, "tokens", known).select(ID, "n", array_to_vector("mean").alias("m"))
    mean = per.groupBy(ID).agg(Summarizer.mean(F.col("m"), F.col("n").cast("double")).alias("m"))     # rows with one id
    mean = mean.select(ID, vector_to_array("m").alias("m"))
    zeros = F.array_repeat(F.lit(0.0), size)
    out = docs.select(ID).join(mean, ID, "left").select(ID, F.coalesce("m", zeros).alias("embedding"))
    return out.withColumns({"embedding_norm": F.sqrt(dot(F.col("embedding"), F.col("embedding"))),
                            "has_embedding": flag(F.exists("embedding", lambda x: x != 0))})


def tfidf(docs: DataFrame, features: int = 100, min_df: int = 5, max_df: float = 0.8, longest: int = 2, more_than: int = 3) -> DataFrame:
    """Length-normed TF-IDF weights of the most frequent terms, as ``(review, term, tfidf)``.

    The vocabulary comes first, from one aggregate over all terms; only its terms are then counted per text.
    """
    used = docs.where(F.size("tokens") > more_than)
    terms = used.select(ID, F.concat(*[ngrams("tokens", n) for n in range(1, longest + 1)]).alias("terms"))
    n = one_row(used.agg(F.count("*").alias("n"))).getField("n")
    one = lambda c, total, df: F.transform(c, lambda t: F.struct(t.alias("token"), F.lit(total).alias("total"), F.lit(df).alias("df")))
    seen = terms.select(F.explode(F.concat(one("terms", 1, 0), one(F.array_distinct("terms"), 0, 1))).alias("x"))
    per = seen.groupBy("x.token").agg(F.sum("x.total").alias("total"), F.sum("x.df").alias("df"))
    vocab = (per.where((F.col("df") >= min_df) & (F.col("df") <= n * F.lit(max_df))).orderBy(F.desc("total"), "token").limit(features)
                .select("token", (F.ln((1 + n) / (1 + F.col("df"))) + 1).alias("idf")))
    vocab = stage(vocab, "vocabulary")                             # ``features`` rows
    counts = terms.select(ID, F.explode("terms").alias("token")).join(F.broadcast(vocab), "token").groupBy(ID, "token").agg(F.count("*").alias("n"), F.first("idf").alias("idf"))
    weights = stage(counts.withColumn("w", F.col("n") * F.col("idf")), "weights")
    norms = weights.groupBy(ID).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(norms, ID).select(ID, F.col("token").alias("term"), (F.col("w") / F.col("norm")).alias("tfidf"))


def lda_topics(docs: DataFrame, topics: int = 10, words_per_topic: int = 10, features: int = 100, min_df: float = 5,
               max_df: float = 0.8, rounds: int = 10, seed: int = 42, more_than: int = 3) -> tuple[DataFrame, DataFrame]:
    """Topic words with weights, and the topic mix of each text."""
    used = docs.where(F.size("tokens") > more_than).withColumn("terms", F.concat(ngrams("tokens", 1), ngrams("tokens", 2)))
    counter = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=features, minDF=min_df, maxDF=max_df).fit(used)
    counted = counter.transform(used)
    counted = stage(counted.select(ID, "tf"), "terms")                 # every round reads the counts; phrases are made once for them
    weighted = IDF(inputCol="tf", outputCol="features").fit(counted).transform(counted).select(ID, "features")
    model = LDA(k=topics, maxIter=rounds, seed=seed, optimizer="online").fit(weighted)
    vocab = F.array(*[F.lit(w) for w in counter.vocabulary])   # at most ``features`` terms
    top = model.describeTopics(words_per_topic).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
    named = top.select("topic", (F.col("rank") + 1).alias("rank"), F.element_at(vocab, F.col("t.termIndices") + 1).alias("word"), F.col("t.termWeights").alias("weight"))
    return named, model.transform(weighted).select(ID, vector_to_array("topicDistribution").alias("topics"))


def embedding_clusters(vectors: DataFrame, k: int = 10, key: str = "word", vector: str = "vector", seed: int = 42) -> DataFrame:
    """k-means cluster, distance to the cluster's mean and two principal components per vector."""
    data = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    clustered = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(data).transform(data)
    flat = PCA(k=2, inputCol="features", outputCol="pc").fit(clustered).transform(clustered)
    pc = vector_to_array("pc")
    return flat.select(key, "cluster", pc[0].alias("x"), pc[1].alias("y"))


# --- per customer, overall ------------------------------------------------------------------------------

def customer_text_features(docs: DataFrame, key: str = "customer_unique_id") -> DataFrame:
    """``docs`` carries score, polarity, subjectivity, aspects, clean text and embedding coverage."""
    nonzero = lambda c: F.coalesce(F.avg(F.when(F.col(c) != 0, F.col(c))), F.lit(0.0))
    length = F.when(F.col("clean_text") == "", 0).otherwise(F.size(F.split("clean_text", " ")))
    return docs.groupBy(key).agg(
        F.avg("review_score").alias("avg_review_score"), F.stddev_samp("review_score").alias("review_score_std"),
        F.min("review_score").alias("min_review_score"), F.max("review_score").alias("max_review_score"),
        F.avg("polarity").alias("avg_sentiment_polarity"), F.stddev_samp("polarity").alias("sentiment_polarity_std"),
        F.avg("subjectivity").alias("avg_subjectivity"), F.avg(flag(sentiment_5() == "very_positive")).alias("very_positive_ratio"),
        F.avg(flag(sentiment_3() == "positive")).alias("positive_sentiment_ratio"),
        *[F.sum(f"{a}_mentioned").alias(f"{a}_mentions") for a in ASPECTS],
        *[nonzero(f"{a}_sentiment").alias(f"avg_{a}_sentiment") for a in ("delivery", "quality", "price")],
        F.avg(length).alias("avg_review_length"), F.avg("has_embedding").alias("embedding_coverage"))


def text_insights(docs: DataFrame, min_count: int = 5) -> DataFrame:
    """Totals as ``(fact, name, value)`` rows."""
    length = F.when(F.col("clean_text") == "", 0).otherwise(F.size(F.split("clean_text", " ")))
    one = docs.agg(F.count("*").cast("double").alias("total_reviews"), F.count_if(F.col("clean_text") != "").cast("double").alias("reviews_with_text"),
                   F.avg(length).alias("avg_review_length"), *[F.sum(f"{a}_mentioned").cast("double").alias(f"mentions_{a}") for a in ASPECTS])
    facts = one.unpivot([], one.columns, "fact", "value").select("fact", F.lit("all").alias("name"), "value")
    vocab = vocabulary(docs, min_count).agg(F.count("*").cast("double").alias("value")).select(F.lit("vocabulary_size").alias("fact"), F.lit("all").alias("name"), "value")
    kinds = docs.groupBy(sentiment_5().alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit("sentiment").alias("fact"), "name", "value")
    return facts.unionByName(vocab).unionByName(kinds)
