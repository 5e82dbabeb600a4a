"""Topic models, classifiers and the frames they are trained on."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archiveloom.functions import text as T
from archiveloom.functions.vectors import embed
from archiveloom.session import settle, spread


#: Buckets that words are hashed into: every word of a corpus counts, however many there are.
WORD_BUCKETS = 1 << 18


def _buckets_of(words: DataFrame, buckets: int) -> DataFrame:
    """``words`` (word) with ``termIndices``, the bucket of each."""
    place = F.udf(lambda v: int(v.indices[0]), "int")
    return HashingTF(inputCol="w", outputCol="v", numFeatures=buckets).transform(words.withColumn("w", F.array("word"))).withColumn("termIndices", place("v")).drop("w", "v")


def lda_topics(df: DataFrame, text: str, stop: list[str], topics: int = 10, words: int = 10, rounds: int = 15, seed: int = 11, buckets: int = WORD_BUCKETS) -> DataFrame:
    """Rows (topic, place, word, weight): the leading words of each topic of a corpus. Words are hashed into ``buckets``; a bucket goes by the word that
    is most frequent in it."""
    tokens = settle(spread(df.select(T.simple_tokens(F.col(text), stop).alias("tokens")).where("size(tokens) > 0")))
    model = LDA(k=topics, maxIter=rounds, seed=seed).fit(HashingTF(inputCol="tokens", outputCol="features", numFeatures=buckets).transform(tokens))
    found = model.describeTopics(words).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("place", "t")).select("topic", "place", "t.*")
    counted = tokens.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    named = _buckets_of(counted, buckets).join(F.broadcast(found.select("termIndices").distinct()), "termIndices", "left_semi")  # words of the leading buckets
    named = named.groupBy("termIndices").agg(F.max_by("word", F.struct("n", "word")).alias("word"))
    return found.join(named, "termIndices").select("topic", "place", "word", F.col("termWeights").alias("weight"))


def _leading(least: float, top: int):
    shares = F.transform(vector_to_array("topicDistribution"), lambda p, i: F.struct((-p).alias("p"), i.alias("topic")))
    best = F.slice(F.array_sort(F.filter(shares, lambda s: s["p"] <= -least)), 1, top)
    return F.transform(best, lambda s: s["topic"])


def _model(tokens: DataFrame, topics: int, rounds: int, seed: int, buckets: int):
    return Pipeline(stages=[HashingTF(inputCol="tokens", outputCol="features", numFeatures=buckets), LDA(k=topics, maxIter=rounds, seed=seed)]).fit(tokens)


def document_topics(df: DataFrame, key: str, text: str, stop: list[str], topics: int = 5, rounds: int = 5, least: float = 0.05, top: int = 3, seed: int = 11, buckets: int = WORD_BUCKETS) -> DataFrame:
    """Rows (key, topics): each text's leading topics of one model of the whole corpus, of at least a share, best first."""
    tokens = settle(spread(df.select(F.col(key), T.topic_tokens(F.col(text), stop).alias("tokens")).where("size(tokens) > 0")))
    return _model(tokens, topics, rounds, seed, buckets).transform(tokens).select(key, _leading(least, top).alias("topics"))


def run_topics(df: DataFrame, key: str, text: str, stop: list[str], topics: int = 5, rounds: int = 5, least: float = 0.05, top: int = 3, seed: int = 11, buckets: int = WORD_BUCKETS) -> DataFrame:
    """Rows (doc_id, sets): for :func:`archiveloom.operators.chunking.chunk_topics`, the leading topics of each sentence by one topic model of all sentences, joined
    over runs of three sentences of a text (the last two stand alone)."""
    sents = spread(df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("doc_id"), F.posexplode(T.split_sentences(F.col(text), 3)).alias("i", "sentence")))
    each = settle(sents.select("doc_id", "i", T.topic_tokens(F.col("sentence"), stop).alias("tokens")))
    told = _model(each.where("size(tokens) > 0"), topics, rounds, seed, buckets).transform(each).select("doc_id", "i", F.when(F.size("tokens") > 0, _leading(least, top)).otherwise(F.array().cast("array<int>")).alias("topics"))
    # the sentences of one text
    own = told.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "topics"))), lambda x: x["topics"]).alias("each"))
    return own.select("doc_id", F.transform("each", lambda x, i: F.when(i < F.size("each") - 2, F.array_distinct(F.flatten(F.slice("each", i + 1, 3)))).otherwise(x)).alias("sets"))


def topic_groups(df: DataFrame, topic: str, doc: str) -> DataFrame:
    """Rows (topic_id, topic, doc): documents by topic, duplicates kept, with an id that follows from the topic. The groups stay rows:
    a topic may hold a third of all documents, which no single row could."""
    return df.where(F.col(topic).isNotNull()).select(F.md5(F.col(topic).cast("string")).alias("topic_id"), F.col(topic).alias("topic"), F.col(doc).alias("doc"))


# How a model's excuses begin.
EXCUSES = "^(This|Un|un|No|Cryptic)"


def training_frame(df: DataFrame, topic: str, doc: str, corpus: str) -> DataFrame:
    """Rows (topic, doc, corpus, doc_embeddings) without topics that a model phrased as an excuse."""
    rows = df.select(F.col(topic).alias("topic"), F.col(doc).alias("doc"), F.col(corpus).alias("corpus")).where(~F.col("topic").rlike(EXCUSES))
    return rows.withColumn("doc_embeddings", embed(F.col("doc")))


def boosted_classifier(df: DataFrame, vector: str, label: str, seed: int = 3137, rounds: int = 10) -> DataFrame:
    """``df`` with ``score`` and ``predicted`` of gradient-boosted trees for a 0/1 label."""
    points = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))).withColumn("label", F.col(label).cast("double"))
    model = GBTClassifier(seed=seed, maxIter=rounds).fit(points.where("label is not null"))
    out = model.transform(points)
    return out.select(*df.columns, vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("predicted"))


def linear_adapter(df: DataFrame, vector: str, label: str) -> DataFrame:
    """``df`` with ``adapted``: class probabilities of a linear model on the vectors, which stands for tuning an encoder it can't reach."""
    points = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    model = Pipeline(stages=[StringIndexer(inputCol=label, outputCol="label", handleInvalid="skip", stringOrderType="alphabetAsc"), LogisticRegression(maxIter=30, regParam=0.01)]).fit(points)
    return model.transform(points).select(*df.columns, vector_to_array("probability").alias("adapted"), F.col("prediction").cast("int").alias("predicted"))
