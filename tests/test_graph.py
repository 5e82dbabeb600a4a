import random

import pytest

from archiveloom.operators import graph as G
from archiveloom.operators import parsing as P
from archiveloom.operators import providers
from pyspark.sql import functions as F


def components(pairs):
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in root}


@pytest.mark.parametrize("seed, n, m", [(1, 60, 40), (2, 200, 220), (3, 30, 10)])
def test_components(spark, seed, n, m):
    rng = random.Random(seed)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(1000 + i, 1001 + i) for i in range(40)]
    edges = G.simple_graph(spark.createDataFrame([(a, b, "x", i) for i, (a, b) in enumerate(pairs)], "src bigint, dst bigint, label string, pos int"))
    got = {r["vertex"]: r["component"] for r in G.connected_components(edges).collect()}
    assert got == components([p for p in pairs if p[0] != p[1]])


def test_components_of_nothing(spark):
    edges = spark.createDataFrame([], "src string, dst string, label string")
    assert G.connected_components(edges).collect() == []
    lone = spark.createDataFrame([("z",)], "vertex string")
    assert [tuple(r) for r in G.connected_components(edges, lone).collect()] == [("z", "z")]


def test_simple_graph(spark):
    rows = [("a", "b", "one", 1), ("b", "a", "two", 2), ("a", "a", "loop", 3), (None, "a", "x", 4)]
    assert [tuple(r) for r in G.simple_graph(spark.createDataFrame(rows, "src string, dst string, label string, pos int")).collect()] == [("a", "b", "two")]


def clique(names):
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def test_communities(spark):
    pairs = clique("abcd") + clique("wxyz") + [("d", "w")] + [("p", "q")]
    edges = spark.createDataFrame([(a, b, "x") for a, b in pairs], "src string, dst string, label string")
    rows = G.communities(edges).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["community"], set()).add(r["vertex"])
    assert sorted(map("".join, map(sorted, groups.values()))) == ["abcd", "pq", "wxyz"]
    assert G.modularity_communities(clique("abcdefgh") + clique("stuv") + [("a", "s")], 5)
    found = G.label_propagation(edges.where("src in ('p', 'q')"))
    assert found.count() == 2
    big = {r["vertex"]: r["community"] for r in G.communities(edges, largest=3).collect()}
    assert set(big) == set("abcdwxyzpq")


def test_community_texts(spark):
    edges = spark.createDataFrame([("a", "b", "near"), ("b", "c", "far")], "src string, dst string, label string")
    members = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "vertex string, community int")
    assert sorted(r["line"] for r in G.community_lines(edges, members).collect()) == ["a -> b -> near", "b -> a -> near"]
    texts = G.community_texts(G.community_lines(edges, members), most=1).collect()
    assert sorted((r["part"], r["text"]) for r in texts) == [(0, "a -> b -> near."), (1, "b -> a -> near.")]
    assert G.capped(edges.withColumn("k", F.lit(1)), "k", "src", 1).count() == 1


def parsed(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text, items", [('["a", "b"]', ["a", "b"]), ("Here: ['a', 'b'] ok", ["a", "b"]), ('["a", "b"', ["a", "b"]), ("none", None), ("", None), ("[oops", None), (None, None)])
def test_string_list(spark, text, items):
    assert parsed(spark, text, P.string_list) == items


def test_fenced(spark):
    assert parsed(spark, 'x\n```json\n{"entities_and_triples": ["a", "b"]}\n```\ny', P.fenced_triples) == ["a", "b"]
    assert parsed(spark, '```json\n{"entities_and_triples": ["a", "b", "unfinish', P.fenced_triples) == ["a", "b"]
    assert parsed(spark, "nothing", P.fenced_triples) is None


def test_triplets(spark):
    df = spark.createDataFrame([(1, ["[1], ORG:Red", "[2], LOC:Geneva", "[1] LOCATED_IN [2]", "[1] NEAR [9]"]), (2, [])], "k int, lines array<string>")
    assert [tuple(r)[2:] for r in P.triplets(df, "k", "lines").collect()] == [("Red", "Located In", "Geneva")]


def test_delimited(spark):
    text = '("entity"$$$$"A"$$$$"T"$$$$"d")("entity"$$$$A$$$$T$$$$d)("relationship"$$$$"A"$$$$"B"$$$$"r"$$$$"x")'
    assert [tuple(x) for x in parsed(spark, text, P.delimited_entities)] == [("A", "T", "d")]
    assert [tuple(x) for x in parsed(spark, text, P.delimited_relations)] == [("A", "B", "r", "x")]


def test_summary_graph(spark):
    text = "### Entities:\n1. **A**\n2. B\n### Relationships:\nA -> knows -> B\nB -> is near -> A\nA -> B -> C -> D\nlonely"
    entities, edges = P.summary_graph(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t")
    assert sorted(r["entity"] for r in entities.collect()) == ["A", "B"]
    assert sorted((r["src"], r["dst"], r["label"]) for r in edges.collect()) == [("A", "B", "is near"), ("A", "D", "B -> C")]


def test_providers(spark):
    df = spark.createDataFrame([(1, "Why?\nHow?"), (2, None), (3, "no")], "k int, t string")
    assert sorted((r["k"], r["question"]) for r in providers.questions(df, "k", "t").collect()) == [(1, "How?"), (1, "Why?")]
    tags = {r["k"]: r["y"] for r in df.select("k", providers.topic_tag(F.col("t")).alias("y")).collect()}
    assert tags == {1: "Why?", 2: None, 3: "no"}
    assert parsed(spark, '["a", "b"]', providers.propositions) == ["a", "b"] and parsed(spark, '["a"]', providers.segments) == ["a"]
    verdict = df.select("k", providers.passes(F.col("t"), F.lit("yes")).alias("y")).collect()
    assert [r["y"] for r in verdict] == [True, True, True]
    texts = spark.createDataFrame([(str(i), f"answer {i}") for i in range(120)], "community string, text string")
    assert len(providers.answer_communities(texts, "What").collect()) == 1


def test_communities_are_the_same_at_any_size(spark):
    rng = random.Random(7)
    star = [("hub", f"leaf{i}") for i in range(8)]
    other = {(f"q{rng.randrange(7)}", f"n{rng.randrange(3)}") for _ in range(12)}
    edges = spark.createDataFrame([(a, b, "x") for a, b in star + sorted(other)], "src string, dst string, label string")
    small, large = ({r["vertex"]: r["community"] for r in G.communities(edges, limit=3, largest=n).collect()} for n in (100_000, 3))
    assert small == large
    assert all(large[v] == v for v in set(large.values()))
    assert max(list(large.values()).count(c) for c in set(large.values())) <= 3
    whole = {r["vertex"]: r["community"] for r in G.communities(edges, largest=3).collect()}
    assert len({whole[v] for e in star for v in e}) == 1


@pytest.mark.parametrize("pairs", [clique(range(12)), [(0, i) for i in range(1, 41)], clique(range(7)) + clique(range(10, 17)) + [(0, 10)]])
@pytest.mark.parametrize("limit", [3, 5])
def test_the_limit_holds(pairs, limit):
    """Cliques and stars too, which modularity alone leaves whole."""
    found = G.modularity_communities(pairs, limit)
    sizes = {}
    for v, c in found.items():
        sizes[c] = sizes.get(c, 0) + 1
    assert max(sizes.values()) <= limit and set(found) == {v for p in pairs for v in p}


def test_the_limit_holds_over_the_cluster(spark):
    pairs = clique(range(5)) + [(10, i) for i in range(11, 16)]
    edges = spark.createDataFrame([(a, b, "x") for a, b in pairs], "src bigint, dst bigint, label string")
    assert {r["vertex"]: r["community"] for r in G.communities(edges, limit=3, largest=3).collect()} == G.modularity_communities(pairs, 3)
