"""Structure out of the text that models answer with. A text that can't be parsed gives null or nothing, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archiveloom.functions.text import strip

FENCE = "```"


def string_list(text: Column) -> Column:
    """The first bracketed list of quoted strings; a missing end bracket is added. Null if there is none."""
    bare = strip(text)
    inner = F.regexp_extract(bare, r"(?s)(\[\s*[\"'].*?[\"']\s*(?:\]|$))", 1)
    found = F.when(F.startswith(bare, F.lit("[")), bare).otherwise(inner)
    closed = F.when(F.endswith(found, F.lit("]")), found).otherwise(F.concat(found, F.lit("]")))
    return F.when(found != "", F.from_json(closed, "array<string>"))


def fenced_triples(text: Column) -> Column:
    """``entities_and_triples`` of the first fenced JSON object; an unfinished one is cut at its last whole entry and closed."""
    after = F.get(F.split(text, FENCE + "json", 2), F.lit(1))
    body = F.get(F.split(after, FENCE, 2), F.lit(0))
    whole = F.contains(after, F.lit(FENCE))
    head = F.regexp_extract(body, r'(?s)^(.*)",', 1)
    mended = F.when(whole, body).otherwise(F.concat(head, F.lit('"]}')))
    return F.from_json(mended, "struct<entities_and_triples:array<string>>")["entities_and_triples"]


def triplets(rows: DataFrame, key: str, lines: str, most: int = 5) -> DataFrame:
    """Rows (key, pos, subject, predicate, object) of an array of lines: '[i] PREDICATE [j]' between entities 'd' named by '[k], KIND:name'.

    The first line of a number names it; a triplet of an unnamed entity is left out; the first ``most`` stay.
    """
    each = rows.select(F.col(key), F.posexplode(lines).alias("pos", "line")).withColumn("line", strip(F.col("line")))
    named = each.where(F.col("line").rlike(r"^\[\d+\],")).select(key, F.regexp_extract("line", r"^\[(\d+)\],", 1).alias("no"), strip(F.get(F.split("line", ":"), F.lit(1))).alias("name"), "pos")
    names = named.groupBy(key, "no").agg(F.min_by("name", "pos").alias("name")).where("name <> ''")
    said = each.where(F.col("line").rlike(r"^\[\d+\]\s+\S+\s+\[\d+\]")).select(
        key, "pos", *[F.regexp_extract("line", r"^\[(\d+)\]\s+(\S+)\s+\[(\d+)\]", i).alias(c) for i, c in ((1, "a"), (2, "p"), (3, "b"))]
    )
    subject, object_ = names.select(key, F.col("no").alias("a"), F.col("name").alias("subject")), names.select(key, F.col("no").alias("b"), F.col("name").alias("object"))
    full = said.join(subject, [key, "a"]).join(object_, [key, "b"])
    nth = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return full.withColumn("nth", nth).where(F.col("nth") <= most).select(key, "pos", "subject", F.initcap(F.lower(F.replace("p", F.lit("_"), F.lit(" ")))).alias("predicate"), "object")


_FIELD = r'"([^"]*?)"'
_GAP = r"\$\$\$\$"


def delimited_entities(text: Column) -> Column:
    """array<struct<name, kind, description>> of every quoted ("entity"$$$$...) record."""
    pattern = rf'\("entity"{_GAP}{_FIELD}{_GAP}{_FIELD}{_GAP}{_FIELD}\)'
    g = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    return F.arrays_zip(*[c.alias(n) for c, n in zip(g, ("name", "kind", "description"))])


def delimited_relations(text: Column) -> Column:
    """array<struct<source, target, relation, description>> of every quoted ("relationship"$$$$...) record."""
    pattern = rf'\("relationship"{_GAP}{_FIELD}{_GAP}{_FIELD}{_GAP}{_FIELD}{_GAP}{_FIELD}\)'
    g = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2, 3, 4)]
    return F.arrays_zip(*[c.alias(n) for c, n in zip(g, ("source", "target", "relation", "description"))])


def summary_graph(rows: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Entities (key, entity) and edges (key, src, dst, label) of sectioned summaries: names under 'Entities:', 'a -> label -> b' under
    'Relationships:'. An edge's last label stays, whichever way it is written."""
    each = rows.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).withColumn("line", strip(F.col("line")))
    mark = F.when(F.col("line").isin("### Entities:", "**Entities:**"), "e").when(F.col("line").isin("### Relationships:", "**Relationships:**"), "r")
    part = F.last(mark, ignorenulls=True).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    body = each.withColumn("part", part).where(mark.isNull() & (F.col("line") != ""))
    entities = body.where("part = 'e'").select(key, strip(F.replace(F.regexp_replace("line", r"^\d\.", ""), F.lit("**"), F.lit(""))).alias("entity")).where("entity <> ''").distinct()
    ends = F.transform(F.split("line", "->"), strip)
    edges = body.where("part = 'r'").withColumn("x", ends).where(F.size("x") >= 2).select(
        key, "pos", F.element_at("x", 1).alias("a"), F.element_at("x", -1).alias("b"), F.array_join(F.slice("x", 2, F.greatest(F.size("x") - 2, F.lit(0))), " -> ").alias("label")
    )
    pair = edges.select(key, "pos", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "label")
    return entities, pair.groupBy(key, "src", "dst").agg(F.max_by("label", "pos").alias("label"))
