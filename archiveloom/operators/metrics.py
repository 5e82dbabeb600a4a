"""Evaluation of retrieval, and the relational helpers around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archiveloom.functions import text as T

METRICS = ("hit_rate", "mrr", "precision", "recall", "ap", "ndcg")

# How malformed questions begin, and what they hold.
NOT_ASKED = ("```", "import")
ASKING = "uestion"


def array_metrics(expected: Column, retrieved: Column) -> dict[str, Column]:
    """The metrics of one ranked list against its relevant ids; a null or empty list scores 0, no relevant ids give null recall, ap and ndcg."""
    e = F.array_distinct(F.coalesce(expected, F.array().cast("array<string>")))
    r = F.array_distinct(F.coalesce(retrieved, F.array().cast("array<string>")))
    ranks = F.filter(F.transform(r, lambda x, i: F.when(F.array_contains(e, x), i + 1)), lambda i: i.isNotNull())
    hits, n = F.size(ranks).cast("double"), F.size(e)
    dcg = lambda a: F.aggregate(a, F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1.0))
    ideal = F.when(F.least(n, F.size(r)) > 0, F.sequence(F.lit(1), F.least(n, F.size(r)))).otherwise(F.array().cast("array<int>"))
    ap = F.aggregate(F.transform(ranks, lambda x, i: (i + 1) / x), F.lit(0.0), lambda s, v: s + v)
    some = lambda c: F.when(n > 0, c)
    return {
        "hit_rate": (hits > 0).cast("double"),
        "mrr": F.coalesce(F.lit(1.0) / F.get(ranks, F.lit(0)), F.lit(0.0)),
        "precision": F.when(F.size(r) > 0, hits / F.size(r)).otherwise(0.0),
        "recall": some(hits / n),
        "ap": some(ap / n),
        "ndcg": some(F.when(hits > 0, dcg(ranks) / dcg(ideal)).otherwise(0.0)),
    }


def retriever_metrics(rows: DataFrame, expected: str = "expected_ids", retrieved: str = "retrieved_ids", keep: tuple[str, ...] = ("qid", "retriever")) -> DataFrame:
    """One row per evaluated list with the metrics of :func:`array_metrics`."""
    return rows.select(*keep, *[c.alias(name) for name, c in array_metrics(F.col(expected), F.col(retrieved)).items()])


def judged(found: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Rows (qid, expected_ids, retrieved_ids) of ranked results (qid, node_id, rank): every query, also one without results."""
    want = qrels.groupBy("qid").agg(F.sort_array(F.collect_set("node_id")).alias("expected_ids"))
    got = found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda x: x["node_id"]).alias("retrieved_ids"))
    return queries.select("qid").distinct().join(want, "qid", "left").join(got, "qid", "left")


def metrics_mean(per_query: DataFrame, by: str = "retriever") -> DataFrame:
    """Unweighted means over the queries of each retriever."""
    return per_query.groupBy(by).agg(*[F.avg(m).alias(m) for m in METRICS], F.count("*").alias("n_queries"))


def select_qa(queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Well-formed questions and their relevance pairs; null texts aren't well-formed."""
    bad = F.contains("text", F.lit(ASKING))
    for start in NOT_ASKED:
        bad = bad | F.startswith("text", F.lit(start))
    good = queries.where(~bad)
    return good, qrels.join(good.select("qid"), "qid", "left_semi")


def with_title(rows: DataFrame, nodes: DataFrame, key: str = "node_id") -> DataFrame:
    """The title of each row's node; null where the node is unknown or has none."""
    titles = nodes.groupBy(F.col("id_").alias(key)).agg(F.min("metadata.title").alias("title"))
    return rows.join(titles, key, "left")


def language_accuracy(evals: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per language of the first expected node, and over all (language 'ALL'): how often it is among the retrieved."""
    first = evals.select("qid", F.get("expected_ids", F.lit(0)).alias("node_id"), F.coalesce(F.array_contains("retrieved_ids", F.get("expected_ids", F.lit(0))), F.lit(False)).alias("hit"))
    rows = with_title(first, nodes).withColumn("language", T.title_language(F.coalesce("title", F.lit(""))))
    return rows.rollup("language").agg(F.avg(F.col("hit").cast("double")).alias("accuracy"), F.count("*").alias("n")).withColumn("language", F.coalesce("language", F.lit("ALL")))


def pass_rate(rows: DataFrame, passing: Column, by: str | None = None) -> DataFrame:
    """Share of rows that pass; nulls don't."""
    grouped = rows.groupBy(by) if by else rows.groupBy()
    return grouped.agg(F.avg(F.coalesce(passing.cast("int"), F.lit(0))).alias("pass_rate"), F.count("*").alias("n"))


def sample_rows(rows: DataFrame, key: str, n: int = 500, salt: str = "") -> DataFrame:
    """A sample of exactly so many rows (all, if there are fewer), the same on every engine: the least hashes of the key."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(salt))), key).limit(n)


def rows_from(rows: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` (exclusive) in order of the key."""
    return rows.orderBy(key).offset(first).limit(last - first)
