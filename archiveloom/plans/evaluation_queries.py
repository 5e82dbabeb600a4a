"""Queries of retrieval, its evaluation and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from archiveloom.functions.vectors import hashed
from archiveloom.operators import metrics as M
from archiveloom.operators import providers
from archiveloom.operators import reporting as R
from archiveloom.operators import retrieval as S
from archiveloom.operators import topics
from archiveloom.plans.registry import query, table
from archiveloom.plans.text_queries import STRIP

#: The stated query set: every row whose id divides by 20 (of a hexadecimal id, its first eight digits).
HEX_20 = "('0x' || substr(qid, 1, 8))::BIGINT % 20 = 0"


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("vec"))


def _dense(spark, folder, metric):
    rows = _vectors(spark, folder)
    asked = rows.where("node_id % 20 = 0").select(F.col("node_id").alias("qid"), "vec")
    return S.dense_topk(asked, rows, 3, metric, skip_self=True).withColumn("score", F.round("score", 6) + 0.0)


def _dense_sql(score: str) -> str:
    return f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS qid, b.vec_id AS node_id, round({score}, 9) AS score FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id)::INT AS rank FROM s)
SELECT qid, node_id, round(score, 6) AS score, rank FROM r WHERE rank <= 3"""


@query(_dense_sql("list_cosine_similarity(a.v, b.v)"))
def dense_topk_cosine(spark, folder):
    return _dense(spark, folder, "cosine")


@query(_dense_sql("-list_distance(a.v, b.v)"))
def dense_topk_l2(spark, folder):
    return _dense(spark, folder, "l2")


def _asked(spark, folder):
    queries = table(spark, folder, "qa_queries").where("text is not null")
    return queries.where(F.conv(F.substring("qid", 1, 8), 16, 10).cast("bigint") % 20 == 0)


def _corpus(spark, folder):
    return table(spark, folder, "qa_corpus").where("text is not null").groupBy("node_id").agg(F.min("text").alias("text"))


BM25 = rf"""
WITH c AS (SELECT node_id, min(text) AS text FROM qa_corpus WHERE text IS NOT NULL GROUP BY node_id),
w AS (SELECT node_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM c),
n AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM w),
tf AS (SELECT node_id, len(any_value(w)) AS dl, term, count(*) AS tf FROM (SELECT node_id, w, unnest(w) AS term FROM w) GROUP BY node_id, term),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
q AS (SELECT qid, text, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'))) AS term FROM qa_queries WHERE text IS NOT NULL AND {HEX_20}),
s AS (SELECT qid, node_id, round(sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score
    FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY qid, node_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id)::INT AS rank FROM s),
top AS (SELECT * FROM r WHERE rank <= 10)"""


@query(BM25 + " SELECT qid, node_id, round(score, 6) AS score, rank FROM top")
def bm25_topk(spark, folder):
    return S.bm25_topk(_asked(spark, folder), _corpus(spark, folder)).withColumn("score", F.round("score", 6))


RERANKED = (
    BM25
    + r""", sets AS (SELECT top.qid, top.node_id, list_distinct(regexp_extract_all(lower(qq.text), '[\p{L}\p{N}]+')) AS a, list_distinct(regexp_extract_all(lower(c.text), '[\p{L}\p{N}]+')) AS b
    FROM top JOIN qa_queries qq USING (qid) JOIN c USING (node_id)),
again AS (SELECT qid, node_id, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 9) AS score FROM sets),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id)::INT AS rank FROM again)"""
)


def _cascade(spark, folder):
    asked, corpus = _asked(spark, folder), _corpus(spark, folder)
    return S.rerank(S.bm25_topk(asked, corpus), asked, corpus)


@query(RERANKED + " SELECT qid, node_id, round(score, 6) AS score, rank FROM best WHERE rank <= 3")
def cascade_rerank(spark, folder):
    return _cascade(spark, folder).withColumn("score", F.round("score", 6))


@query(
    RERANKED
    + f""", asked AS (SELECT DISTINCT qid FROM qa_queries WHERE text IS NOT NULL AND {HEX_20}), rel AS (SELECT DISTINCT qid, node_id FROM qa_qrels),
hits AS (SELECT asked.qid, max(CASE WHEN rel.node_id IS NOT NULL THEN 1 ELSE 0 END) AS hit, max(CASE WHEN rel.node_id IS NOT NULL THEN 1.0 / rank ELSE 0 END) AS mrr
    FROM asked LEFT JOIN (SELECT * FROM best WHERE rank <= 3) b USING (qid) LEFT JOIN rel ON rel.qid = asked.qid AND rel.node_id = b.node_id GROUP BY asked.qid)
SELECT count(*) AS n_queries, round(avg(hit), 6) AS hit_rate, round(avg(mrr), 6) AS mrr FROM hits"""
)
def retrieval_evaluation(spark, folder):
    """The whole lifecycle: keyword retrieval, rerank, judgement of every query against its relevant nodes."""
    found = M.judged(_cascade(spark, folder), _asked(spark, folder), table(spark, folder, "qa_qrels"))
    per = M.retriever_metrics(found, keep=("qid",))
    return per.agg(F.count("*").alias("n_queries"), F.round(F.avg("hit_rate"), 6).alias("hit_rate"), F.round(F.avg("mrr"), 6).alias("mrr"))


ENGINE = (
    BM25
    + rf""", told AS (SELECT top.qid, string_agg(c.text, chr(10) || chr(10) ORDER BY rank) AS passages, string_agg(top.node_id, '|' ORDER BY rank) AS node_ids, any_value(q.text) AS question
    FROM top JOIN c USING (node_id) JOIN qa_queries q USING (qid) WHERE rank <= 3 GROUP BY top.qid),
answered AS (SELECT qid, node_ids, question, passages, regexp_replace(string_split('Question: ' || question || chr(10) || 'Passages:' || chr(10) || passages, ':' || chr(10))[-1], {STRIP}) AS answer FROM told)"""
)


@query(ENGINE + " SELECT qid, node_ids, len(answer) AS n_chars, md5(answer) AS digest FROM answered")
def query_engine(spark, folder):
    """Questions answered from the three best passages (the default model answers with the passages themselves)."""
    made = providers.query_engine(_asked(spark, folder), _corpus(spark, folder), S.bm25_topk)
    return made.select("qid", F.array_join("node_ids", "|").alias("node_ids"), F.length("answer").cast("bigint").alias("n_chars"), F.md5("answer").alias("digest"))


JUDGED = r"""
WITH c AS (SELECT node_id, min(text) AS text FROM qa_corpus WHERE text IS NOT NULL GROUP BY node_id),
rows AS (SELECT DISTINCT r.qid, r.node_id, q.text AS question, c.text AS passages, regexp_replace(c.text, '[\s\x0b\p{Z}\x{85}]+', ' ', 'g') AS answer FROM qa_qrels r JOIN qa_queries q USING (qid) JOIN c USING (node_id) WHERE q.text IS NOT NULL),
words AS (SELECT *, regexp_extract_all(lower(question), '[\p{L}]{6,}') AS q, regexp_extract_all(lower(passages), '[\p{L}]{6,}') AS p, regexp_extract_all(lower(answer), '[\p{L}]{6,}') AS a FROM rows)
SELECT count(*) AS n, round(avg(list_has_any(p, a)::INT), 6) AS faithful, round(avg(list_has_any(q, a)::INT), 6) AS relevant FROM words"""


@query(JUDGED)
def judged_answers(spark, folder):
    """The share of answers that a judge calls faithful and relevant. (The answers are the relevant passages; the judge is a stand-in that looks for a common word.)"""
    asked = table(spark, folder, "qa_queries").where("text is not null").select("qid", F.col("text").alias("question"))
    told = _corpus(spark, folder).select("node_id", F.col("text").alias("passages"), F.regexp_replace("text", r"(?U)\s+", " ").alias("answer"))
    rows = table(spark, folder, "qa_qrels").select("qid", "node_id").distinct().join(asked, "qid").join(told, "node_id")
    judged = providers.judged_answers(rows, "question", "answer", "passages")
    mean = lambda c: F.round(F.avg(F.col(c).cast("int")), 6).alias(c)
    return judged.agg(F.count("*").alias("n"), mean("faithful"), mean("relevant"))


@query(
    """
WITH v AS (SELECT vec_id // 10 AS g, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), q AS (SELECT row_number() OVER () AS i, v FROM v WHERE g = 0)
SELECT g, round(sum(best), 6) AS score FROM (SELECT v.g, q.i, max(list_inner_product(q.v, v.v)) AS best FROM v, q GROUP BY v.g, q.i) GROUP BY g"""
)
def maxsim_scores(spark, folder):
    """Late interaction of one query (the first ten vectors) with every group of ten."""
    groups = table(spark, folder, "embeddings").where("embedding is not null").select(F.expr("vec_id div 10").alias("g"), F.col("embedding").cast("array<double>").alias("v"))
    groups = groups.groupBy("g").agg(F.collect_list("v").alias("vs"))  # ten at most
    asked = groups.where("g = 0").select("vs").first()["vs"]
    q = F.array(*[F.array(*map(F.lit, v)) for v in asked])
    return groups.select("g", F.round(S.maxsim(q, F.col("vs")), 6).alias("score"))


@query(
    """
WITH v AS (SELECT vec_id // 10 AS g, row_number() OVER () AS i, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
b AS (SELECT q.g AS qid, t.g AS node_id, max(list_inner_product(q.v, t.v)) AS best FROM v q JOIN v t ON q.g % 20 = 0 AND q.g <> t.g GROUP BY q.g, q.i, t.g),
s AS (SELECT qid, node_id, round(sum(best), 9) AS score FROM b GROUP BY qid, node_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id)::INT AS rank FROM s)
SELECT qid, node_id, round(score, 6) AS score, rank FROM r WHERE rank <= 3"""
)
def maxsim_topk(spark, folder):
    """Late interaction of the stated query set (groups of ten vectors whose number divides by 20) with every other group."""
    groups = table(spark, folder, "embeddings").where("embedding is not null").groupBy(F.expr("vec_id div 10").alias("node_id")).agg(F.collect_list("embedding").alias("vecs"))  # ten at most
    asked = groups.where("node_id % 20 = 0").withColumnRenamed("node_id", "qid")
    return S.maxsim_topk(asked, groups, 3, skip_self=True).withColumn("score", F.round("score", 6) + 0.0)


@query(
    BM25
    + rf""", qw AS (SELECT qid, row_number() OVER () AS i, ('0x' || substr(md5(w), 1, 4))::INT AS h FROM (SELECT qid, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM qa_queries WHERE text IS NOT NULL AND {HEX_20})),
tw AS (SELECT DISTINCT node_id, ('0x' || substr(md5(term), 1, 4))::INT % 128 AS h FROM tf),
best AS (SELECT top.qid, top.node_id, any_value(top.score) AS retrieval_score, qw.i, max(CASE WHEN qw.h % 64 <> tw.h % 64 THEN 0 WHEN qw.h % 128 = tw.h THEN 1 ELSE -1 END) AS best
    FROM top JOIN qw USING (qid) JOIN tw USING (node_id) GROUP BY top.qid, top.node_id, qw.i),
again AS (SELECT qid, node_id, any_value(retrieval_score) AS retrieval_score, sum(best)::DOUBLE AS score FROM best GROUP BY qid, node_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id)::INT AS rank FROM again)
SELECT qid, node_id, score, rank, round(retrieval_score, 6) AS retrieval_score FROM ranked WHERE rank <= 3"""
)
def maxsim_rerank(spark, folder):
    """The cascade with late interaction as its second stage; the first stage's score is kept."""
    asked, corpus = _asked(spark, folder), _corpus(spark, folder)
    return S.rerank(S.bm25_topk(asked, corpus), asked, corpus, S.maxsim_score, keep_score=True).withColumn("retrieval_score", F.round("retrieval_score", 6))


@query(
    rf'''
WITH t AS (SELECT 'q' AS side, qid AS id, text FROM qa_queries WHERE text IS NOT NULL AND {HEX_20} UNION ALL SELECT 'c', node_id, min(text) FROM qa_corpus WHERE text IS NOT NULL GROUP BY node_id),
w AS (SELECT side, id, ('0x' || substr(md5(w), 1, 4))::INT AS h FROM (SELECT side, id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM t)),
v AS (SELECT side, id, h % 64 AS dim, sum(1 - 2 * ((h // 64) % 2))::BIGINT AS v FROM w GROUP BY ALL),
n AS (SELECT side, id, sum(v * v)::DOUBLE AS q FROM v GROUP BY ALL),
d AS (SELECT a.id AS qid, b.id AS node_id, sum(a.v * b.v)::DOUBLE AS dot FROM v a JOIN v b ON a.side = 'q' AND b.side = 'c' AND a.dim = b.dim GROUP BY ALL),
s AS (SELECT q.id AS qid, c.id AS node_id, round(CASE WHEN coalesce(nq.q, 0) * coalesce(nc.q, 0) > 0 THEN coalesce(dot, 0) / sqrt(nq.q * nc.q) ELSE 0 END, 9) AS score
    FROM t q JOIN t c ON q.side = 'q' AND c.side = 'c' LEFT JOIN n nq ON nq.side = 'q' AND nq.id = q.id LEFT JOIN n nc ON nc.side = 'c' AND nc.id = c.id LEFT JOIN d ON d.qid = q.id AND d.node_id = c.id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id)::INT AS rank FROM s)
SELECT qid, node_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10'''
)
def dense_text_topk(spark, folder):
    """Dense retrieval over embedded texts (the default hashed embedder)."""
    from archiveloom.functions.vectors import embed

    asked = _asked(spark, folder).select("qid", embed(F.col("text"), lambda: hashed).alias("vec"))
    corpus = _corpus(spark, folder).select("node_id", embed(F.col("text"), lambda: hashed).alias("vec"))
    return S.dense_topk(asked, corpus, 10).withColumn("score", F.round("score", 6))


METRICS_SQL = """
WITH base AS (SELECT qid, retriever, asked_at, list_distinct(coalesce(expected_ids, []::VARCHAR[])) AS e, list_filter(coalesce(retrieved_ids, []::VARCHAR[]), lambda x: x IS NOT NULL) AS r, expected_ids, retrieved_ids, logged_at FROM eval_rows),
m AS (SELECT *, list_transform(list_filter(range(1, len(r) + 1), lambda i: list_contains(e, r[i])), lambda i: i::DOUBLE) AS ranks FROM base),
v AS (SELECT *, len(ranks)::DOUBLE AS hits, len(e) AS n FROM m),
per AS (SELECT qid, retriever,
    CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate, round(coalesce(1.0 / ranks[1], 0), 9)::DOUBLE AS mrr, round(CASE WHEN len(r) > 0 THEN hits / len(r) ELSE 0 END, 9) AS precision,
    round(CASE WHEN n > 0 THEN hits / n END, 9) AS recall,
    round(CASE WHEN n > 0 THEN coalesce(list_sum(list_transform(range(1, len(ranks) + 1), lambda i: i / ranks[i])), 0) / n END, 9) AS ap,
    round(CASE WHEN n > 0 THEN CASE WHEN hits > 0 THEN list_sum(list_transform(ranks, lambda x: 1.0 / log2(x + 1))) / list_sum(list_transform(range(1, least(n, len(r)) + 1), lambda x: 1.0 / log2(x + 1.0))) ELSE 0 END END, 9) AS ndcg
    FROM v)"""


def _per_query(spark, folder):
    per = M.retriever_metrics(table(spark, folder, "eval_rows"))
    return per.select("qid", "retriever", *[F.round(m, 9).alias(m) for m in M.METRICS])


@query(METRICS_SQL + " SELECT * FROM per")
def retriever_metrics(spark, folder):
    return _per_query(spark, folder)


@query(METRICS_SQL + " SELECT retriever, round(avg(hit_rate), 6) AS hit_rate, round(avg(mrr), 6) AS mrr, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(ap), 6) AS ap, round(avg(ndcg), 6) AS ndcg, count(*) AS n_queries FROM per GROUP BY retriever")
def metrics_mean(spark, folder):
    mean = M.metrics_mean(_per_query(spark, folder))
    return mean.select("retriever", *[F.round(m, 6).alias(m) for m in M.METRICS], "n_queries")


GOOD = "NOT (text LIKE '```%' OR text LIKE 'import%' OR contains(text, 'uestion'))"


@query(f"SELECT qid, text FROM qa_queries WHERE {GOOD}")
def select_qa(spark, folder):
    return M.select_qa(table(spark, folder, "qa_queries"), table(spark, folder, "qa_qrels"))[0]


@query(f"SELECT qid, node_id FROM qa_qrels WHERE qid IN (SELECT qid FROM qa_queries WHERE {GOOD})")
def select_qrels(spark, folder):
    return M.select_qa(table(spark, folder, "qa_queries"), table(spark, folder, "qa_qrels"))[1]


@query("SELECT q.qid, q.node_id, t.title FROM qa_qrels q LEFT JOIN (SELECT id_, min(metadata.title) AS title FROM nodes GROUP BY id_) t ON t.id_ = q.node_id")
def node_titles(spark, folder):
    return M.with_title(table(spark, folder, "qa_qrels"), table(spark, folder, "nodes")).select("qid", "node_id", "title")


@query(
    """
WITH f AS (SELECT expected_ids[1] AS node_id, coalesce(list_contains(retrieved_ids, expected_ids[1]), false)::INT AS hit FROM eval_rows),
t AS (SELECT hit, CASE WHEN contains(title, 'ENG') OR contains(title, 'annual-report') OR contains(title, '-en-') THEN 'ENG' ELSE 'FR' END AS language
    FROM f LEFT JOIN (SELECT id_, min(metadata.title) AS title FROM nodes GROUP BY id_) n ON n.id_ = f.node_id)
SELECT coalesce(language, 'ALL') AS language, round(avg(hit), 6) AS accuracy, count(*) AS n FROM t GROUP BY ROLLUP (language)"""
)
def lang_accuracy_rollup(spark, folder):
    return M.language_accuracy(table(spark, folder, "eval_rows"), table(spark, folder, "nodes")).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT retriever, round(avg(coalesce((metric_vals['hit_rate'] >= 0.5)::INT, 0)), 6) AS pass_rate, count(*) AS n FROM eval_rows GROUP BY retriever")
def pass_rate(spark, folder):
    return M.pass_rate(table(spark, folder, "eval_rows"), F.col("metric_vals")["hit_rate"] >= 0.5, "retriever").withColumn("pass_rate", F.round("pass_rate", 6))


@query("SELECT md5(source) AS topic_id, source AS topic, doc_id AS doc FROM documents WHERE source IS NOT NULL")
def topic_groups(spark, folder):
    return topics.topic_groups(table(spark, folder, "documents"), "source", "doc_id")


@query("SELECT qid, text FROM qa_queries WHERE text IS NOT NULL AND NOT regexp_matches(text, '^(This|Un|un|No|Cryptic)')")
def topic_prefix_filter(spark, folder):
    made = topics.training_frame(table(spark, folder, "qa_queries"), "text", "text", "qid")
    return made.select(F.col("corpus").alias("qid"), F.col("topic").alias("text"))


@query("SELECT rec_no FROM archive_records ORDER BY md5(rec_no::VARCHAR), rec_no LIMIT 500")
def sample_500(spark, folder):
    """A sample is the operator's whole point here."""
    return M.sample_rows(table(spark, folder, "archive_records"), "rec_no", 500).select("rec_no")


@query("SELECT rec_no FROM archive_records ORDER BY rec_no LIMIT 90 OFFSET 10")
def prefix_limit(spark, folder):
    """Rows 10 to 100, the operator's whole point."""
    return M.rows_from(table(spark, folder, "archive_records"), "rec_no", 10, 100).select("rec_no")


STAGED = "SELECT retriever, row_number() OVER (ORDER BY hits, retriever)::BIGINT AS stage, hits FROM (SELECT retriever, sum(metric_vals['hit_rate']) AS hits FROM eval_rows WHERE retriever IS NOT NULL GROUP BY retriever)"


def _stages(spark, folder):
    from pyspark.sql.window import Window

    hits = table(spark, folder, "eval_rows").where("retriever is not null").groupBy("retriever").agg(F.sum(F.col("metric_vals")["hit_rate"]).alias("hits"))
    return hits.withColumn("stage", F.row_number().over(Window.orderBy("hits", "retriever")).cast("bigint")).withColumn("metric", F.lit("hits"))  # one row per retriever


@query(f"SELECT retriever, round((hits - lo) / (hi - lo) * -10 + 10, 6) AS scaled FROM ({STAGED}), (SELECT min(hits) AS lo, max(hits) AS hi FROM ({STAGED}))")
def minmax_scale(spark, folder):
    rows = _stages(spark, folder)
    low, high = rows.select(F.min("hits")).scalar(), rows.select(F.max("hits")).scalar()
    return rows.select("retriever", F.round(R.rescaled(F.col("hits"), low, high, 10.0, 0.0), 6).alias("scaled"))


@query(
    f"""SELECT stage, round(gain, 6) AS gain, round(100.0 * gain / last_hits, 1) AS gain_share FROM (
    SELECT stage, hits - coalesce(lag(hits) OVER (ORDER BY stage), 0) AS gain, last_value(hits) OVER (ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_hits FROM ({STAGED}))"""
)
def stage_increment_share(spark, folder):
    return R.increments(_stages(spark, folder), "metric", "stage", "hits").select("stage", F.round("gain", 6).alias("gain"), "gain_share")


@query(METRICS_SQL + " SELECT retriever, round(avg(hit_rate), 6) AS hit_rate, round(avg(mrr), 6) AS mrr FROM per WHERE retriever IS NOT NULL GROUP BY retriever")
def score_pivot(spark, folder):
    mean = M.metrics_mean(_per_query(spark, folder)).where("retriever is not null")
    return R.wide(R.long(mean, "retriever", ["hit_rate", "mrr", "ndcg"]).withColumn("value", F.round("value", 6)), "retriever", "metric", "value", ["hit_rate", "mrr"])


@query()
def lda_topics(spark, folder):
    from archiveloom.plans.text_queries import docs, stop_words

    return topics.lda_topics(docs(spark, folder), "text", stop_words(spark, folder)).withColumn("weight", F.round("weight", 6))


@query()
def document_topics(spark, folder):
    from archiveloom.plans.text_queries import docs, stop_words

    return topics.document_topics(docs(spark, folder), "doc_id", "text", stop_words(spark, folder)).select("doc_id", F.array_join(F.transform("topics", lambda t: t.cast("string")), ",").alias("topics"))


@query()
def boosted_classifier(spark, folder):
    rows = table(spark, folder, "embeddings").withColumn("target", (F.col("label") == 0).cast("int"))
    return topics.boosted_classifier(rows, "embedding", "target").select("vec_id", "target", "predicted")


@query()
def linear_adapter(spark, folder):
    return topics.linear_adapter(table(spark, folder, "embeddings").withColumnRenamed("label", "topic"), "embedding", "topic").select("vec_id", "topic", "predicted")
