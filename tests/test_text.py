import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archiveloom.functions import text as T
from archiveloom.operators import extraction as X


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text, garbled", [("a b c d e", True), ("a b c d", False), ("a, b c d e", False), ("le la de un été", False), ("xx yy zz aa bb", True), ("", False)])
def test_garbled(spark, text, garbled):
    assert one(spark, text, T.is_garbled) is garbled


def test_clean_text(spark):
    assert one(spark, "The road is open. a b c d e f. It rained!", T.clean_text) == "The road is open. It rained!"
    assert one(spark, None, T.clean_text) is None


def test_sentences(spark):
    assert one(spark, "One.\nTwo?\n\nThree! Four.\n", T.split_sentences) == ["One", "Two", "Three! Four"]
    assert one(spark, "Hi.\nA.\nEnd.", lambda c: T.split_sentences(c, 3)) == ["End."]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("aB .?!\n#", max_size=40))
def test_split_like_regular_expressions(spark, text):
    assert one(spark, text, T.split_sentences) == [x for x in re.split(r"[.?!]\n+", text) if x]


def test_titled_sections(spark):
    rows = one(spark, "pre\n# A\nbody a\n# B\n# C\nbody c\n# A\nagain\n", T.titled_sections)
    assert [(r["title"], r["body"]) for r in rows] == [("", "pre"), ("# A", "again"), ("# B", "# C\nbody c")]
    assert one(spark, "", T.titled_sections) == [] and one(spark, "# A\nx", T.titled_sections)[0]["title"] == ""


@pytest.mark.parametrize("line, title", [(" = Title = \n", True), (" = Title = ", True), (" = = Sub = = \n", False), ("= Title =", False), ("", False)])
def test_wiki_title(spark, line, title):
    assert one(spark, line, T.is_wiki_title) is title


def test_words(spark):
    assert one(spark, "Content, content content  CONTENT content", lambda c: T.occurs_often(c, "content")) is True
    assert one(spark, "content content", lambda c: T.occurs_often(c, "content")) is False
    assert one(spark, "Les Évêques étaient là, the 4 bishops", lambda c: T.simple_tokens(c, ["the", "etaient"])) == ["eveques", "bishops"]
    assert one(spark, "The cat sat on it", lambda c: T.topic_tokens(c, ["the"])) == ["cat", "sat"]
    assert [one(spark, t, T.title_language) for t in ("CAP_ENG.md", "annual-report-1", "a-en-b", "CAP_X.md")] == ["ENG", "ENG", "ENG", "FR"]
    assert one(spark, "a", lambda c: T.ngrams(F.array(c, c), 3)) == [] and one(spark, "a", lambda c: T.ngrams(F.array(c, c, c), 3)) == [["a"] * 3]


def test_dot_lines(spark):
    long = "x" * 101
    text = f"{long}\n.\nshort\n.\nCOMMUNICATION TO THE PRESS\nn. N'EXISTE PAS\n{long.upper()}"
    assert one(spark, text, lambda c: T.dot_line_sections(c, X.FOOTER)) == [long, long]


def test_answers(spark):
    assert one(spark, "assistant:  yes ", T.response_text) == "yes"
    assert one(spark, "1. Why?\nno\n2) How?\n?\n3 When?", lambda c: T.bulletless_questions(c, 2)) == ["Why?", "How?"]


def test_wiki_articles(spark):
    lines = [" = A = \n", "x\n", " \n", " = B = \n", "y\n"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)] + [("g", 0, "only")], "file string, line_no bigint, line string")
    got = sorted((r["file"], r["article_no"], r["text"]) for r in X.wiki_articles(df).collect())
    assert got == [("f", 0, " = A = \nx\n"), ("f", 1, " \n = B = \ny\n"), ("g", 0, "only")]
    cut = X.wiki_articles(df, last_line=2).collect()
    assert sorted((r["file"], r["n_lines"]) for r in cut) == [("f", 1), ("f", 2), ("g", 1)]
    assert X.wiki_articles(df.limit(0)).collect() == []


def test_paged_documents(spark):
    rows = [("f", "1", 0, "text", "a"), ("f", "1", 1, "title", "T"), ("f", "1", 2, "text", "b"), ("f", "1", 3, "text", "a"), ("f", "2", 0, "text", "c")]
    df = spark.createDataFrame(rows, "file string, page string, pos int, kind string, info string")
    got = sorted((r["page"], r["pos"], r["title"], r["text"]) for r in X.paged_documents(df, "file", "page", "pos", "kind", "info").collect())
    assert got == [("1", 0, "", "a"), ("1", 2, "T", "b"), ("2", 0, "", "c")]


def test_corpus_records(spark):
    body = "The wells were repaired before the rains came, and the road to the harbour was opened again in the spring. "
    rows = [("CDP_1.md", f"{body}\n# One\n{body}\n# Two\n{body}\n# Table\n{body}|----------|\n"), ("other.md", "content content content"), (None, body), ("CAP_CIRC.md", f"{body}\n.\n{body}"), ("x", None)]
    df = spark.createDataFrame(rows, "title string, content string")
    got = X.corpus_records(X.sections(df, "title", "content"), drop_first=True).collect()
    assert sorted((r["title"], r["id"]) for r in got) == [("CAP_CIRC.md", 1), ("CDP_1.md", 1), ("CDP_1.md", 2)]
    assert {r["content"][:5] for r in got if r["title"] == "CDP_1.md"} == {"# One", "# Two"}
    kept = X.corpus_records(X.sections(df, "title", "content"), drop_first=False).collect()
    assert {r["title"] for r in kept} == {"CAP_CIRC.md", "CDP_1.md", None}


def test_wiki_articles_of_a_long_file(spark):
    """Lines after the 80,000th count too."""
    from archiveloom.operators.extraction import wiki_articles

    lines = spark.range(80_010).select(F.lit("f").alias("file"), F.col("id").alias("line_no"), F.when(F.col("id") == 80_004, " = Last = \n").when(F.col("id") == 80_003, " \n").otherwise("x\n").alias("line"))
    got = sorted((r["article_no"], r["first_line"], r["n_lines"]) for r in wiki_articles(lines).collect())
    assert sum(n for *_, n in got) == 80_010 and [x[:2] for x in got] == [(0, 0), (1, 80_003)]
