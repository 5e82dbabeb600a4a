"""Queries of the training-data operators: name -> (spark, folder) -> DataFrame, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archiveloom.llm.duplicates import collapse_duplicates, duplicate_members
from archiveloom.llm.language import language_segments, mislabelled, record_languages
from archiveloom.llm.markup import clean_markup
from archiveloom.llm.mixing import mixture, shares
from archiveloom.llm.packing import pack, packing_report
from archiveloom.llm.quality import text_quality
from archiveloom.llm.scans import repair_scans
from archiveloom.llm.splitting import split_oversized
from archiveloom.llm.stuffing import spam_scores
from archiveloom.llm.subjects import assigned, composition, subject_scores
from archiveloom.llm.tokens import token_sizes
from archiveloom.session import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# 1. Missing or wrong language labels


@query()
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return mislabelled(table(spark, folder, "archive_records"), table(spark, folder, "lang_samples"))


@query()
def p1_segments(spark: SparkSession, folder: str) -> DataFrame:
    return language_segments(table(spark, folder, "archive_records"), table(spark, folder, "lang_samples"))


@query()
def p1_languages(spark: SparkSession, folder: str) -> DataFrame:
    return record_languages(language_segments(table(spark, folder, "archive_records"), table(spark, folder, "lang_samples")))


# 2. Subject area of each document


def _subject_scores(spark: SparkSession, folder: str) -> DataFrame:
    return subject_scores(table(spark, folder, "qa_corpus"), table(spark, folder, "subject_seeds"))


@query()
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return assigned(_subject_scores(spark, folder)).select("node_id", "subject")


@query()
def p2_composition(spark: SparkSession, folder: str) -> DataFrame:
    return composition(settle(_subject_scores(spark, folder)), table(spark, folder, "subject_areas"))


# 3. Duplicates hidden by formatting differences

_LETTERS = r"replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g'), 'ß', 'ss')"
_FIELD = r"(?s)^\s*(\p{L}[^:=\n]{0,60}?)\s*[:=]\s*(\S.*?)\s*$"


def _fields(parts: str) -> str:
    one = f"{_LETTERS.format(f"regexp_extract(p, '{_FIELD}', 1)")} || chr(1) || {_LETTERS.format(f"regexp_extract(p, '{_FIELD}', 2)")}"
    whole = rf"len({parts}) >= 2 AND len(list_filter({parts}, lambda p: NOT (regexp_matches(p, '{_FIELD}') AND regexp_matches(p, '[:=].*[\p{{L}}\p{{N}}]')))) = 0"
    return f"CASE WHEN {whole} THEN array_to_string(list_sort(list_distinct(list_transform({parts}, lambda p: {one}))), chr(2)) END"


_DUPLICATES = rf"""
WITH d AS (SELECT doc_id, text, {_LETTERS.format("text")} AS seq, regexp_replace(text, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS bare FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
p AS (SELECT *, CASE WHEN regexp_matches(bare, '[;|]') THEN list_filter(regexp_split_to_array(regexp_replace(bare, '[\r\n]+', ' ', 'g'), '\s*[;|]\s*'), lambda x: trim(x) <> '') END AS m,
    list_filter(regexp_split_to_array(bare, '\s*[\r\n]+\s*'), lambda x: trim(x) <> '') AS l FROM d WHERE seq <> ''),
c AS (SELECT doc_id, seq, coalesce({_fields("m")}, {_fields("l")}) AS card FROM p),
k AS (SELECT doc_id, coalesce(chr(3) || max(card) OVER (PARTITION BY seq), seq) AS k FROM c),
g AS (SELECT k, min(doc_id) AS keep_id, count(*) AS copies FROM k GROUP BY k)"""


@query(_DUPLICATES + " SELECT keep_id, doc_id AS copy_id FROM k JOIN g USING (k) WHERE doc_id <> keep_id")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_members(table(spark, folder, "documents"))


@query(_DUPLICATES + " SELECT keep_id, copies FROM g")
def p3_copies(spark: SparkSession, folder: str) -> DataFrame:
    return collapse_duplicates(table(spark, folder, "documents"))


# 4. Markup residue


@query()
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return clean_markup(table(spark, folder, "archive_records")).where("n_pieces > 0").select("rec_no").distinct()


@query()
def p4_clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return clean_markup(table(spark, folder, "archive_records"))


# 5. Noise in text from scanned pages


def _repaired(spark: SparkSession, folder: str) -> DataFrame:
    return repair_scans(table(spark, folder, "archive_records"), table(spark, folder, "common_words"))


@query()
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _repaired(spark, folder).where("n_broken + n_misread + n_furniture > 0").select("rec_no").distinct()


@query()
def p5_repaired_text(spark: SparkSession, folder: str) -> DataFrame:
    return _repaired(spark, folder)


# 6. Per-document text quality statistics


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return text_quality(table(spark, folder, "archive_records"), table(spark, folder, "common_words"))


@query()
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _quality(spark, folder).where("kind <> 'prose'").select("rec_no", "kind").distinct()


@query()
def p6_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _quality(spark, folder)


# 7. Splitting oversized items


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    archive = split_oversized(table(spark, folder, "archive_records"), "rec_no", "content").withColumn("src", F.lit("archive_records"))
    return archive.unionByName(split_oversized(table(spark, folder, "documents"), "doc_id", "text").withColumn("src", F.lit("documents")))


@query("""
SELECT 'archive_records' AS src, rec_no AS item_key FROM archive_records WHERE length(content) > 2048
UNION ALL SELECT 'documents' AS src, doc_id AS item_key FROM documents WHERE length(text) > 2048""")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).where("n_pieces > 1 and piece_no = 0").select("src", "item_key")


@query()
def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


# 8. Filling fixed-capacity containers


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack(settle(token_sizes(table(spark, folder, "documents"))), table(spark, folder, "containers"))


@query()
def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


@query()
def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing_report(_packed(spark, folder))


# 9. Mixing sources to target weights


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(settle(token_sizes(table(spark, folder, "documents"), keep=("source",))), table(spark, folder, "mix_targets"))


@query()
def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)


@query()
def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return shares(settle(_mixed(spark, folder)), table(spark, folder, "mix_targets"))


# 10. Keyword-stuffed and link-list pages


@query()
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam_scores(table(spark, folder, "documents")).where("spam").select("doc_id")


@query()
def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    return spam_scores(table(spark, folder, "documents"))
