"""Documents out of raw files: sections, corpus records, paged pages with running titles, articles of wiki lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archiveloom.functions import text as T

# Marks in a file's name that tell its kind (the first that fits counts, so that a name with two of them is no error), the
# footer of communications, and the rule line of tables in reports.
KINDS = (("CAP", "communication"), ("CIRC", "circular"), ("CDP", "sections"), ("RA", "sections"), ("annual-report", "report"))
FOOTER = r"(?s)COMMUNICATION TO THE.*?\n.*? N'EXISTE PAS\n"
REPORT_RULE = "-" * 56


def file_kind(name: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for mark, kind in KINDS:
        out = out.when(F.contains(name, F.lit(mark)), F.lit(kind))
    return F.coalesce(out, F.lit("whole"))


def sections(df: DataFrame, name: str, text: str, longer_than: int = 100) -> DataFrame:
    """Rows (name, kind, pos, title, body): the sections of each file after its kind's rules. Null names count as whole files; null
    texts have no sections; a file of no known kind is one section."""
    rows = df.select(F.col(name).alias("name"), F.col(text).alias("raw")).where("raw is not null").withColumn("kind", file_kind(F.coalesce(F.col("name"), F.lit(""))))
    untitled = lambda parts: F.transform(parts, lambda x, i: F.struct(i.alias("pos"), F.lit(None).cast("string").alias("title"), x.alias("body")))
    titled = F.filter(T.titled_sections(F.col("raw")), lambda s: F.length(s["body"]) > longer_than)
    found = (
        F.when(F.col("kind") == "communication", untitled(T.dot_line_sections(F.col("raw"), FOOTER, longer_than)))
        .when(F.col("kind") == "circular", untitled(T.dot_line_sections(F.col("raw"), None, longer_than)))
        .when(F.col("kind") == "sections", titled)
        .when(F.col("kind") == "report", F.filter(titled, lambda s: ~F.contains(s["body"], F.lit(REPORT_RULE))))
        .otherwise(untitled(F.array(F.col("raw"))))
    )
    kept = F.transform(found, lambda s, i: F.struct(i.alias("pos"), s["title"].alias("title"), s["body"].alias("body")))
    return rows.select("name", "kind", F.explode(kept).alias("s")).select("name", "kind", "s.pos", "s.title", "s.body")


def corpus_records(parts: DataFrame, drop_first: bool = True) -> DataFrame:
    """Rows (title, id, content) of sections: the first section of a file goes, as do tables, texts that clean to nothing, and untitled
    parts that say 'content' or 'consider' too often; the heading stays at the front of its text."""
    body = F.col("body")
    keep = (~F.contains(body, F.lit(T.TABLE_RULE))) & (T.clean_text(body) != "")
    often = F.col("title").isNull() & (T.occurs_often(body, "content") | T.occurs_often(body, "consider"))
    keep = keep & ~often & ((F.col("pos") > 0) if drop_first else F.lit(True))
    return parts.where(keep).select(F.col("name").alias("title"), F.col("pos").alias("id"), F.concat(F.coalesce("title", F.lit("")), body).alias("content"))


def paged_documents(lines: DataFrame, file: str, page: str, pos: str, kind: str, info: str) -> DataFrame:
    """Rows (file, page, pos, title, text): each distinct text of a page once, under the last title before its first place ('' before
    any). ``kind`` is 'title' or 'text'; the title starts anew on each page."""
    rows = lines.select(F.col(file).alias("file"), F.col(page).alias("page"), F.col(pos).alias("pos"), F.col(kind).alias("kind"), F.col(info).alias("info"))
    on_page = Window.partitionBy("file", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    title = F.coalesce(F.last(F.when(F.col("kind") == "title", F.col("info")), ignorenulls=True).over(on_page), F.lit(""))
    texts = rows.withColumn("title", title).where("kind = 'text'")
    first = F.row_number().over(Window.partitionBy("file", "page", "info").orderBy("pos"))
    return texts.withColumn("nth", first).where("nth = 1").select("file", "page", "pos", "title", F.col("info").alias("text"))


def wiki_articles(lines: DataFrame, file: str = "file", line_no: str = "line_no", line: str = "line", last_line: int | None = None) -> DataFrame:
    """Rows (file, article_no, first_line, n_lines, text): a new article begins with the blank line before a first-level heading.

    Whole files, unless ``last_line`` (counted from 0 within each file) is given: the look ahead crosses it, the lines after it don't
    count. One window per file.
    """
    w = Window.partitionBy("file").orderBy("line_no")
    rows = lines.select(F.col(file).alias("file"), F.col(line_no).alias("line_no"), F.col(line).alias("line"))
    nth, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy("file"))
    cut = F.lead("line", 1).over(w).isin(" \n", "") & T.is_wiki_title(F.lead("line", 2).over(w)) & (nth < n - 2)
    rows = rows.withColumn("nth", nth).withColumn("cut", F.coalesce(cut, F.lit(False)).cast("int"))
    if last_line is not None:
        rows = rows.where(F.col("nth") <= last_line)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("article_no", F.coalesce(F.sum("cut").over(before), F.lit(0)).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return rows.groupBy("file", "article_no").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("text"))
