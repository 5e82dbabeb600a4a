"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archiveloom.functions import text as T
from archiveloom.operators import chunking as C
from archiveloom.operators import extraction as X
from archiveloom.plans.registry import query, table

SPACE = r"[\s\x0b\p{Z}\x{85}]"
W = r"[\p{L}\p{N}\p{M}_]"
#: The garbled pattern without word boundaries, which RE2 has for ASCII only.
GARBLED_RE2 = rf"(?:^|[^\p{{L}}\p{{N}}\p{{M}}_])(?:{W}{{1,2}}{SPACE}+){{4,}}{W}{{1,2}}(?:$|[^\p{{L}}\p{{N}}\p{{M}}_])"
STRIP = rf"'^{SPACE}+|{SPACE}+$', '', 'g'"
SENTS = r"list_filter(regexp_split_to_array(text, '[.?!]\n+'), lambda x: x <> '')"
SENTS3 = r"list_filter(regexp_split_to_array(text, '[.?!]\n+'), lambda x: len(x) >= 3)"
MARKED_SENTS = r"list_filter(string_split(regexp_replace(text, '([.?!])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null")


def stop_words(spark: SparkSession, folder: str) -> list[str]:
    """The fixed table of function words."""
    return [r["word"] for r in table(spark, folder, "common_words").select("word").distinct().collect()]


def _digest(items):
    return [F.size(items).cast("bigint").alias("n"), F.md5(F.array_join(items, "|")).alias("digest")]


@query(f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {SENTS} AS s FROM documents WHERE text IS NOT NULL)")
def sentences_split(spark, folder):
    return docs(spark, folder).select("doc_id", *_digest(T.split_sentences(F.col("text"))))


@query(f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {SENTS3} AS s FROM documents WHERE text IS NOT NULL)")
def sentences_split_min3(spark, folder):
    return docs(spark, folder).select("doc_id", *_digest(T.split_sentences(F.col("text"), 3)))


@query(f"SELECT rec_no FROM archive_records WHERE regexp_matches(content, '{GARBLED_RE2}')")
def garbled_docs(spark, folder):
    return table(spark, folder, "archive_records").where(T.is_garbled(F.col("content"))).select("rec_no")


@query(
    f"""SELECT doc_id, len(c) AS n_chars, md5(c) AS digest FROM (
    SELECT doc_id, array_to_string(list_filter({MARKED_SENTS}, lambda x: NOT regexp_matches(x, '{GARBLED_RE2}')), ' ') AS c FROM documents WHERE text IS NOT NULL)"""
)
def clean_text(spark, folder):
    c = T.clean_text(F.col("text"))
    return docs(spark, folder).select("doc_id", F.length(c).cast("bigint").alias("n_chars"), F.md5(c).alias("digest"))


@query(f"SELECT rec_no FROM archive_records WHERE len(list_filter(regexp_split_to_array(lower(content), '{SPACE}+'), lambda x: x = 'the')) > 2")
def word_occurrence_filter(spark, folder):
    return table(spark, folder, "archive_records").where(T.occurs_often(F.col("content"), "the")).select("rec_no")


TITLED = rf"""
WITH parts AS (
    SELECT rec_no, title AS name, unnest(range(len(p))) AS pos, unnest(p) AS part
    FROM (SELECT rec_no, title, string_split(regexp_replace(content, '\n(#+ [^\n]+?)\n', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS p FROM archive_records WHERE content IS NOT NULL)
), split AS (
    SELECT rec_no, name, pos, CASE WHEN pos = 0 THEN '' ELSE split_part(part, chr(2), 1) END AS title,
        regexp_replace(CASE WHEN pos = 0 THEN part ELSE substr(part, instr(part, chr(2)) + 1) END, {STRIP}) AS body
    FROM parts
), titled AS (
    SELECT rec_no, any_value(name) AS name, min(pos) AS pos, title, arg_max(body, pos) AS body
    FROM split WHERE NOT (pos = 0 AND body = '') GROUP BY rec_no, title
)"""


@query(TITLED + " SELECT rec_no, pos, title, len(body) AS n_chars, md5(body) AS digest FROM titled")
def title_sections(spark, folder):
    rows = table(spark, folder, "archive_records").where("content is not null").select("rec_no", F.explode(T.titled_sections(F.col("content"))).alias("s"))
    return rows.select("rec_no", F.col("s.pos").cast("bigint").alias("pos"), "s.title", F.length("s.body").cast("bigint").alias("n_chars"), F.md5("s.body").alias("digest"))


@query(
    rf"""SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id,
    list_transform(list_filter(list_transform(string_split(replace(text, chr(10) || chr(10), chr(10) || '.' || chr(10)), chr(10) || '.' || chr(10)), lambda x: regexp_replace(x, {STRIP})), lambda x: len(x) > 100), lambda x: lower(x)) AS s
    FROM documents WHERE text IS NOT NULL)"""
)
def dot_line_sections(spark, folder):
    text = F.replace("text", F.lit("\n\n"), F.lit("\n.\n"))
    return docs(spark, folder).select("doc_id", *_digest(T.dot_line_sections(text, X.FOOTER)))


@query(
    TITLED
    + rf""", kinds AS (
    SELECT rec_no, title AS name, content, CASE WHEN contains(t, 'CAP') THEN 'communication' WHEN contains(t, 'CIRC') THEN 'circular' WHEN contains(t, 'CDP') OR contains(t, 'RA') THEN 'sections'
        WHEN contains(t, 'annual-report') THEN 'report' ELSE 'whole' END AS kind
    FROM (SELECT *, coalesce(title, '') AS t FROM archive_records WHERE content IS NOT NULL)
), found AS (
    SELECT k.rec_no, k.name, t.pos, t.title, t.body FROM kinds k JOIN titled t USING (rec_no) WHERE kind IN ('sections', 'report') AND len(t.body) > 100 AND NOT (kind = 'report' AND contains(t.body, repeat('-', 56)))
    UNION ALL
    SELECT rec_no, name, unnest(range(len(p))) AS pos, NULL AS title, unnest(p) AS body FROM (
        SELECT rec_no, name, list_transform(list_filter(list_transform(string_split(content, chr(10) || '.' || chr(10)), lambda x: regexp_replace(x, {STRIP})), lambda x: len(x) > 100), lambda x: lower(x)) AS p FROM kinds WHERE kind IN ('communication', 'circular'))
    UNION ALL
    SELECT rec_no, name, 0 AS pos, NULL AS title, content AS body FROM kinds WHERE kind = 'whole'
), numbered AS (SELECT rec_no, name, row_number() OVER (PARTITION BY rec_no ORDER BY pos) - 1 AS id, title, body FROM found),
cleaned AS (SELECT *, {MARKED_SENTS.replace('text', 'body')} AS s FROM numbered)
SELECT name AS title, id, len(coalesce(title, '') || body) AS n_chars, md5(coalesce(title, '') || body) AS digest FROM cleaned
WHERE NOT contains(body, '|----------') AND array_to_string(list_filter(s, lambda x: NOT regexp_matches(x, '{GARBLED_RE2}')), ' ') <> ''
    AND NOT (title IS NULL AND (len(list_filter(regexp_split_to_array(lower(body), '{SPACE}+'), lambda x: x = 'content')) > 2 OR len(list_filter(regexp_split_to_array(lower(body), '{SPACE}+'), lambda x: x = 'consider')) > 2))"""
)
def corpus_records(spark, folder):
    made = X.corpus_records(X.sections(table(spark, folder, "archive_records"), "title", "content"), drop_first=False)
    return made.select("title", F.col("id").cast("bigint").alias("id"), F.length("content").cast("bigint").alias("n_chars"), F.md5("content").alias("digest"))


@query(
    """
WITH lines AS (SELECT rec_no AS file, id AS page, unnest(range(len(l))) AS pos, unnest(l) AS info FROM (SELECT rec_no, id, string_split(content, chr(10)) AS l FROM archive_records WHERE content IS NOT NULL)),
titled AS (SELECT *, coalesce(last_value(CASE WHEN info LIKE '#%' THEN info END IGNORE NULLS) OVER (PARTITION BY file, page ORDER BY pos ROWS UNBOUNDED PRECEDING), '') AS title FROM lines),
firsts AS (SELECT *, row_number() OVER (PARTITION BY file, page, info ORDER BY pos) AS nth FROM titled WHERE NOT info LIKE '#%')
SELECT file, page, pos, title, md5(info) AS digest FROM firsts WHERE nth = 1"""
)
def paged_titles(spark, folder):
    lines = table(spark, folder, "archive_records").where("content is not null").select("rec_no", "id", F.posexplode(F.split("content", "\n")).alias("pos", "info"))
    kind = F.when(F.startswith("info", F.lit("#")), "title").otherwise("text")
    made = X.paged_documents(lines.withColumn("kind", kind), "rec_no", "id", "pos", "kind", "info")
    return made.select("file", "page", F.col("pos").cast("bigint").alias("pos"), "title", F.md5("text").alias("digest"))


WIKI = "replace(text, chr(10) || chr(10), chr(10) || ' ' || chr(10) || ' = part = ' || chr(10))"


def wiki_text():
    return F.replace("text", F.lit("\n\n"), F.lit("\n \n = part = \n"))


@query(
    rf"""
WITH lines AS (SELECT doc_id AS file, unnest(range(len(l))) AS line_no, unnest(l) || chr(10) AS line FROM (SELECT doc_id, string_split({WIKI}, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
cuts AS (SELECT *, coalesce(lead(line, 1) OVER w IN (' ' || chr(10), '') AND regexp_matches(lead(line, 2) OVER w, '^\s* = [^=]* = \n?$'), false) AND line_no < count(*) OVER (PARTITION BY file) - 2 AS cut FROM lines WINDOW w AS (PARTITION BY file ORDER BY line_no)),
numbered AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS article_no FROM cuts)
SELECT file, article_no, min(line_no) AS first_line, count(*) AS n_lines, md5(string_agg(line, '' ORDER BY line_no)) AS digest FROM numbered GROUP BY file, article_no"""
)
def article_segmentation(spark, folder):
    lines = docs(spark, folder).select(F.col("doc_id").alias("file"), F.posexplode(F.split(wiki_text(), "\n")).alias("line_no", "line"))
    made = X.wiki_articles(lines.withColumn("line", F.concat("line", F.lit("\n"))))
    return made.select("file", F.col("article_no").cast("bigint").alias("article_no"), F.col("first_line").cast("bigint").alias("first_line"), "n_lines", F.md5("text").alias("digest"))


@query(
    rf"""SELECT doc_id, len(p) AS n, md5(array_to_string(p, '|')) AS digest FROM (
    SELECT doc_id, string_split(replace({WIKI}, '= ' || chr(10), ' : '), chr(10) || ' =') AS p FROM documents WHERE text IS NOT NULL)"""
)
def paragraphs_split(spark, folder):
    return docs(spark, folder).select("doc_id", *_digest(T.paragraphs(T.inline_headings(wiki_text()))))


@query("SELECT CASE WHEN contains(title, 'ENG') OR contains(title, 'annual-report') OR contains(title, '-en-') THEN 'ENG' ELSE 'FR' END AS language, count(*) AS n FROM archive_records GROUP BY 1")
def language_of_title(spark, folder):
    return table(spark, folder, "archive_records").groupBy(T.title_language(F.col("title")).alias("language")).agg(F.count("*").alias("n"))


@query(
    rf"""SELECT doc_id, len(t) AS n, md5(array_to_string(t, '|')) AS digest FROM (
    SELECT doc_id, list_filter(regexp_extract_all(lower(translate(text, '{T.ACCENTED}', '{T.PLAIN}')), '[\p{{L}}]+'), lambda w: len(w) BETWEEN 4 AND 15 AND NOT list_contains(stops, w)) AS t
    FROM documents, (SELECT list(DISTINCT word) AS stops FROM common_words) WHERE text IS NOT NULL)"""
)
def preprocessed_tokens(spark, folder):
    return docs(spark, folder).select("doc_id", *_digest(T.simple_tokens(F.col("text"), stop_words(spark, folder))))


@query(
    r"""SELECT doc_id, len(t) AS n, md5(array_to_string(t, '|')) AS digest FROM (
    SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}]+'), lambda w: len(w) >= 3 AND NOT list_contains(stops, w)) AS t
    FROM documents, (SELECT list(DISTINCT word) AS stops FROM common_words) WHERE text IS NOT NULL)"""
)
def topic_tokens(spark, folder):
    return docs(spark, folder).select("doc_id", *_digest(T.topic_tokens(F.col("text"), stop_words(spark, folder))))


def _windows_sql(b: int) -> str:
    w = f"list_transform(range(1, len(s) + 1), lambda i: array_to_string(list_slice(s, greatest(i - {b}, 1), least(i + {b}, len(s))), ' '))"
    return f"SELECT doc_id, len(w) AS n, md5(array_to_string(w, '|')) AS digest FROM (SELECT doc_id, {w} AS w FROM (SELECT doc_id, {SENTS} AS s FROM documents WHERE text IS NOT NULL))"


@query(_windows_sql(1))
def context_windows_b1(spark, folder):
    return docs(spark, folder).withColumn("s", T.split_sentences(F.col("text"))).select("doc_id", *_digest(C.context_windows(F.col("s"), 1)))


@query(_windows_sql(2))
def context_windows_b2(spark, folder):
    return docs(spark, folder).withColumn("s", T.split_sentences(F.col("text"))).select("doc_id", *_digest(C.context_windows(F.col("s"), 2)))


@query(
    f"""SELECT doc_id, len(s) AS n, md5(array_to_string(b, '|')) AS before_digest, md5(array_to_string(a, '|')) AS after_digest FROM (
    SELECT doc_id, s, list_transform(range(1, len(s) + 1), lambda i: array_to_string(list_slice(s, greatest(i - 1, 1), i), '. ') || '. ') AS b,
        list_transform(range(1, len(s) + 1), lambda i: array_to_string(list_slice(s, i, least(i + 1, len(s))), '. ') || '. ') AS a
    FROM (SELECT doc_id, {SENTS3} AS s FROM documents WHERE text IS NOT NULL))"""
)
def pair_windows(spark, folder):
    rows = docs(spark, folder).withColumn("s", T.split_sentences(F.col("text"), 3)).withColumn("w", C.pair_windows(F.col("s"), 1))
    return rows.select("doc_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("w.before", "|")).alias("before_digest"), F.md5(F.array_join("w.after", "|")).alias("after_digest"))


@query(
    f"""SELECT doc_id, len(g) AS n, md5(array_to_string(g, '|')) AS digest FROM (
    SELECT doc_id, list_transform(range(1, greatest(len(s) - 1, 1)), lambda i: array_to_string(list_slice(s, i, i + 2), ' ')) AS g FROM (SELECT doc_id, {SENTS3} AS s FROM documents WHERE text IS NOT NULL))"""
)
def sliding_ngrams(spark, folder):
    rows = docs(spark, folder).withColumn("s", T.split_sentences(F.col("text"), 3))
    return rows.select("doc_id", *_digest(F.transform(T.ngrams(F.col("s"), 3), lambda g: F.array_join(g, " "))))
