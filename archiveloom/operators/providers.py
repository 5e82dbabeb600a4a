"""Model calls as providers. A generator is any function from a list of prompts to a list of answers; it is loaded once per worker and sees Arrow
batches. The default is a template that answers from the prompt itself, so that pipelines can be run and checked without a model."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archiveloom.functions import text as T
from archiveloom.operators import parsing
from archiveloom.session import settle, ship

Generator = Callable[[list[str]], list[str]]
_LONG = re.compile(r"\p{L}{6,}")


def echo(prompts: list[str]) -> list[str]:
    """Answers with what follows the prompt's last colon and line end."""
    return ["assistant: " + p.rsplit(":\n", 1)[-1].strip() for p in prompts]


def listing(prompts: list[str]) -> list[str]:
    """A stand-in that answers with the sentences of what follows the prompt's first colon and line end, as a list of quoted strings."""
    sentences = lambda p: [x for x in re.split(r"(?<=[.?!])[ \t\n\x0b\f\r]+", p.split(":\n", 1)[-1]) if x]
    return [json.dumps(sentences(p), ensure_ascii=False) for p in prompts]


def naming(prompts: list[str]) -> list[str]:
    """A stand-in for an extractor: the first two different long words of the text, as entities and one relation, in the quoted records of :mod:`parsing`."""
    out = []
    for p in prompts:
        words = list(dict.fromkeys(_LONG.findall(p.split(":\n", 1)[-1])))[:2]
        records = [f'("entity"$$$$"{w}"$$$$"WORD"$$$$"a word")' for w in words]
        out.append("".join(records + ([f'("relationship"$$$$"{words[0]}"$$$$"{words[1]}"$$$$"beside"$$$$"in one text")'] if len(words) == 2 else [])))
    return out


def numbering(prompts: list[str]) -> list[str]:
    """A stand-in for an extractor: the same two words as numbered entities and a triple, in fenced JSON."""
    out = []
    for p in prompts:
        words = list(dict.fromkeys(_LONG.findall(p.split(":\n", 1)[-1])))[:2]
        lines = [f"[{i}], WORD:{w}" for i, w in enumerate(words, 1)] + (["[1] STANDS_BESIDE [2]"] if len(words) == 2 else [])
        out.append("```json\n" + json.dumps({"entities_and_triples": lines}, ensure_ascii=False) + "\n```")
    return out


def agreeing(prompts: list[str]) -> list[str]:
    """A stand-in for a judge: yes if the last line of the prompt shares a long word with the lines before it."""
    out = []
    for p in prompts:
        told, answer = p.split(":\n", 1)[-1].rsplit("\n", 1) if "\n" in p.split(":\n", 1)[-1] else ("", p)
        out.append("yes" if set(_LONG.findall(told.lower())) & set(_LONG.findall(answer.lower())) else "no")
    return out


def generate(prompt: Column, loader: Callable[[], Generator] = lambda: echo) -> Column:
    """The answer to each prompt (null for null), without its role mark."""
    ship()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader()
        for batch in batches:
            there = batch.notna()
            answers = iter(model(batch[there].tolist()))
            yield pd.Series([next(answers) if x else None for x in there], index=batch.index, dtype=object)

    # one call for each prompt, however often its answer is used
    return T.response_text(run.asNondeterministic()(prompt))


def prompt(instruction: str, text: Column) -> Column:
    return F.concat(F.lit(instruction + ":\n"), text)


def propositions(text: Column, loader: Callable[[], Generator] = lambda: echo) -> Column:
    """A text's statements, each standing alone, as the list that the model answers with; null if it answers with none."""
    return parsing.string_list(generate(prompt("Split the text into simple statements that stand alone. Answer with a list of quoted strings", text), loader))


def segments(text: Column, words: int = 500, loader: Callable[[], Generator] = lambda: echo) -> Column:
    """A text's segments of at most so many words, as the list that the model answers with."""
    return parsing.string_list(generate(prompt(f"Part the text into segments of at most {words} words. Answer with a list of quoted strings", text), loader))


def questions(df: DataFrame, key: str, text: str, most: int = 2, loader: Callable[[], Generator] = lambda: echo) -> DataFrame:
    """Rows (qid, key, question): questions that a text answers, a few of each."""
    asked = T.bulletless_questions(generate(prompt(f"Write {most} questions that the text answers, one a line", F.col(text)), loader), most)
    rows = df.select(F.col(key), F.posexplode(asked).alias("nth", "question"))
    return rows.select(F.md5(F.concat_ws("\u0001", F.col(key).cast("string"), F.col("nth").cast("string"), "question")).alias("qid"), key, "question")


def topic_tag(text: Column, loader: Callable[[], Generator] = lambda: echo) -> Column:
    """A text's topic: the first line of the answer that isn't empty without its numbering; null if there is none (the row stays)."""
    lines = F.transform(F.split(generate(prompt("Name the topic of the text", text), loader), "\n"), lambda x: T.strip(F.regexp_replace(x, r"^\d+[).\s]", "")))
    return F.get(F.filter(lines, lambda x: x != ""), F.lit(0))


def passes(question: Column, answer: Column, what: str = "faithful", loader: Callable[[], Generator] = lambda: echo) -> Column:
    """A judge's verdict: whether its answer holds 'yes'; null for null."""
    return F.contains(F.lower(generate(prompt(f"Is the answer {what}? Say yes or no", F.concat_ws("\n", question, answer)), loader)), F.lit("yes"))


# Kinds of entities and relations that an extractor is asked for.
ENTITY_KINDS, RELATION_KINDS = ("ORGANISATION", "PERSON", "PLACE", "DATE", "EVENT"), ("LOCATED_IN", "PART_OF", "FOUNDED_IN", "WORKS_FOR")


def extract_triplets(df: DataFrame, key: str, text: str, most: int = 5, loader: Callable[[], Generator] = lambda: numbering) -> DataFrame:
    """Rows (key, pos, subject, predicate, object): the triples that a model finds in each text; an answer that can't be parsed gives none."""
    ask = f"Name entities of the kinds {', '.join(ENTITY_KINDS)} and their relations ({', '.join(RELATION_KINDS)}) in the text. Answer with fenced JSON"
    answered = df.select(F.col(key), parsing.fenced_triples(generate(prompt(ask, F.col(text)), loader)).alias("lines")).where("lines is not null")
    return parsing.triplets(settle(answered), key, "lines", most)


def extract_graph(df: DataFrame, key: str, text: str, loader: Callable[[], Generator] = lambda: naming) -> tuple[DataFrame, DataFrame]:
    """Entities (key, name, kind, description) and relations (key, source, target, relation, description) that a model finds in each text; an answer that
    can't be parsed gives none."""
    answered = settle(df.select(F.col(key), generate(prompt("Name the entities of the text and how they are related, as quoted records", F.col(text)), loader).alias("answer")))
    entities = answered.select(key, F.explode(parsing.delimited_entities(F.col("answer"))).alias("e")).select(key, "e.*")
    return entities, answered.select(key, F.explode(parsing.delimited_relations(F.col("answer"))).alias("r")).select(key, "r.*")


def query_engine(queries: DataFrame, corpus: DataFrame, retrieve: Callable[..., DataFrame], k: int = 3, loader: Callable[[], Generator] = lambda: echo) -> DataFrame:
    """Rows (qid, answer, node_ids): the ``k`` texts that ``retrieve`` finds for each question, in order of rank, and the answer a model makes of them. A
    question for which nothing is found has no row."""
    found = retrieve(queries, corpus, k).join(corpus.select("node_id", F.col("text").alias("passage")), "node_id")
    ranked = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "node_id", "passage"))).alias("found"))  # k at most
    told = ranked.join(queries.select("qid", F.col("text").alias("question")), "qid")
    ask = F.concat(F.lit("Answer the question from the passages.\nQuestion: "), "question", F.lit("\nPassages:\n"), F.array_join(F.transform("found", lambda x: x["passage"]), "\n\n"))
    return told.select("qid", generate(ask, loader).alias("answer"), F.transform("found", lambda x: x["node_id"]).alias("node_ids"))


def judged_answers(answers: DataFrame, question: str, answer: str, passages: str, loader: Callable[[], Generator] = lambda: agreeing) -> DataFrame:
    """``answers`` with ``faithful`` (the answer follows from the passages) and ``relevant`` (it answers the question): a judge's verdicts, null for null."""
    return answers.withColumn("faithful", passes(F.col(passages), F.col(answer), "faithful to the passages", loader)).withColumn("relevant", passes(F.col(question), F.col(answer), "relevant to the question", loader))


def answer_communities(texts: DataFrame, question: str, loader: Callable[[], Generator] = lambda: echo) -> DataFrame:
    """One row (answer): each community's text is asked on its own, then the answers are combined, first within parts of a
    bounded number, until one is left."""
    rows = texts.select(F.col("community").cast("string").alias("at"), generate(prompt(question, F.col("text")), loader).alias("answer"))
    while (n := rows.count()) > 1:
        parts = max(1, n // 50)  # each round leaves a fiftieth or less
        rows = rows.groupBy(F.pmod(F.xxhash64("at"), F.lit(parts)).cast("string").alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "answer"))), lambda x: x["answer"]), "\n").alias("all"))
        rows = rows.select("at", generate(prompt("Combine the answers into one", F.col("all")), loader).alias("answer"))
        rows = settle(rows)
    return rows.select("answer")
