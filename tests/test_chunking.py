import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archiveloom.functions.vectors import cosine, hashed, l2
from archiveloom.operators import chunking as C

TEXT = "The wells were repaired in the spring of that year.\nNo one could say why the road was closed again?\nBoats came late!\nThe harbour opened in May, after long talks with the guards of the port.\nRopes and lamps were sent to the hills.\nThe end"


def fold(s, d, breaks, joint=" ", end="", falling=False, merge=False):
    """The fold in plain Python."""
    start, chunks = 0, []
    for b in breaks:
        t = joint.join(s[start : b + 1]) + end
        if len(t) < C.SHORT:
            if chunks and ((d[start - 1] > d[b]) if falling else (d[start - 1] < d[b])):
                chunks[-1] += t
                start = b + 1
        else:
            chunks.append(t)
            start = b + 1
    if start < len(s):
        t = joint.join(s[start:])
        if merge and len(t) < C.SHORT and chunks:
            chunks[-1] += t
        else:
            chunks.append(t)
    return chunks


def run_fold(spark, s, d, breaks, **kw):
    df = spark.createDataFrame([(s, d, breaks)], "s array<string>, d array<double>, b array<int>")
    return df.select(C.assemble(F.col("s"), F.col("d"), F.col("b"), **kw).alias("c")).first()["c"]


def test_fold_fixture(spark):
    s = [c * n for c, n in zip("abcde", (40, 80, 120, 30, 90))]
    d = [0.9, 0.1, 0.8, 0.7]
    assert [len(x) for x in run_fold(spark, s, d, [0, 2, 3])] == [242, 121]
    d[3] = 0.85
    assert [len(x) for x in run_fold(spark, s, d, [0, 2, 3])] == [272, 90]


@pytest.mark.parametrize("kw", [{}, {"joint": ". ", "end": ". ", "merge_tail": True}, {"joint": ". ", "end": ". ", "merge_tail": True, "falling": True}])
def test_fold_against_plain_python(spark, kw):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(60):
        n = int(rng.integers(1, 12))
        s = ["w" * int(k) for k in rng.integers(1, 130, n)]
        d = [float(x) for x in rng.integers(0, 5, max(0, n - 1)) / 4]
        rows.append((s, d, [i for i in range(n - 1) if rng.random() < 0.5]))
    df = spark.createDataFrame(rows, "s array<string>, d array<double>, b array<int>")
    got = df.select(C.assemble(F.col("s"), F.col("d"), F.col("b"), **kw).alias("c")).collect()
    for (s, d, b), r in zip(rows, got):
        assert r["c"] == fold(s, d, b, kw.get("joint", " "), kw.get("end", ""), kw.get("falling", False), kw.get("merge_tail", False))


def test_percentile_and_breaks(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.3, 0.4],), ([0.5],), ([],)], "d array<double>")
    got = df.select(C.percentile(F.col("d"), 95).alias("t"), C.breaks_above(F.col("d"), C.percentile(F.col("d"), 95)).alias("b")).collect()
    assert got[0]["t"] == pytest.approx(0.385) and got[0]["b"] == [3] and got[1]["b"] == [] and got[2]["t"] is None and not got[2]["b"]
    rng = np.random.default_rng(0)
    values = [[float(x) for x in rng.random(int(k))] for k in rng.integers(1, 30, 40)]
    got = spark.createDataFrame([(v,) for v in values], "d array<double>").select(C.percentile(F.col("d"), 90).alias("t")).collect()
    assert np.allclose([r["t"] for r in got], [np.percentile(v, 90) for v in values], atol=1e-12)


def test_windows(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "s array<string>")
    r = df.select(C.context_windows(F.col("s"), 1).alias("w"), C.pair_windows(F.col("s"), 1).alias("p")).first()
    assert r["w"] == ["a b", "a b c", "b c"]
    assert [tuple(x) for x in r["p"]] == [("a. ", "a. b. "), ("a. b. ", "b. c. "), ("b. c. ", "c. ")]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(cosine(F.col("a"), F.col("b")).alias("c"), cosine(F.col("a"), F.col("z")).alias("n"), l2(F.col("a"), F.col("b")).alias("l")).first()
    assert r["c"] == pytest.approx(0.5**0.5) and r["n"] == 0 and r["l"] == 1
    assert not hashed(["", "?!"]).any() and (hashed(["Wells wells"]) == 2 * hashed(["wells"])).all()


@pytest.mark.parametrize("strategy", C.STRATEGIES)
def test_every_strategy(spark, strategy):
    rows = [(1, TEXT), (2, "one line"), (3, None), (4, ""), (5, "\n".join([TEXT] * 30)), (1, TEXT)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("chunk", F.lit("clash")).withColumn("sents", F.lit(1))
    options = {"threshold": 0.3} if strategy == "chain" else {}
    a = sorted(map(tuple, C.chunk(df, strategy, **options).collect()))
    b = sorted(map(tuple, C.chunk(df.repartition(3), strategy, **options).collect()))
    assert a == b and {r[0] for r in a} == {1, 2, 5}
    letters = lambda t: "".join(c for c in t if c.isalpha())
    if strategy not in ("char", "recursive"):  # these overlap
        one = "".join(letters(c) for d, _, c in a if d == 5)
        assert one == letters(rows[4][1])
    assert C.chunk(df.limit(0), strategy, **options).collect() == []


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        C.chunk(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), "semantic2")


def test_split_group():
    assert C.split_group(["a" * 60, "b" * 60, "c" * 60, "d" * 60], [0.1, 0.9, 0.2], 100) == ["a" * 60 + " " + "b" * 60, "c" * 60 + " " + "d" * 60]
    assert C.split_group(["a" * 500, "b"], [0.3], 100) == ["a" * 500 + " b"]


def test_chain_cuts_far_sentences():
    s = ["wells pumps water " * 6, "wells pumps water " * 6, "boats ropes lamps " * 6, "boats ropes lamps " * 6]
    assert C.chain(s, hashed, 0.3) == [". ".join(s[:2]) + ". ", ". ".join(s[2:]) + ". "]


@settings(max_examples=80, deadline=None)
@given(st.text("ab \n", max_size=300), st.integers(5, 60))
def test_recursive_pieces(text, size):
    pieces = C.recursive_pieces(text, size, 4)
    assert all(0 < len(p) <= size for p in pieces)
    assert set("".join(pieces)) - {" ", "\n"} == set(text) - {" ", "\n"}


def test_routing_and_nodes(spark):
    df = spark.createDataFrame([(1, "x" * 150), (2, "y" * 500), (3, "word " * 400)], "doc_id bigint, text string")
    got = C.size_routed(df, C.chunk_tokens).collect()
    assert {r["doc_id"] for r in got} == {2, 3} and [r["chunk"] for r in got if r["doc_id"] == 2] == ["y" * 500]
    ids = [r["node_id"] for r in C.nodes(C.chunk_tokens(df)).collect()]
    assert len(set(ids)) == len(ids) and all(len(i) == 64 for i in ids)


def test_sentences_overlap(spark):
    df = spark.createDataFrame([(1, "One two. Three. Four five six. Seven. Eight nine ten.")], "doc_id bigint, text string")
    got = [r["chunk"] for r in C.chunk_sentences(df, size=25, overlap=8).orderBy("chunk_no").collect()]
    assert got == ["One two. Three.", "Three. Four five six.", "Seven. Eight nine ten."]
    assert [r["chunk"] for r in C.chunk_sentences(df, size=25).orderBy("chunk_no").collect()] == ["One two. Three.", "Four five six. Seven.", "Eight nine ten."]


def test_chain_against_whole_texts():
    """The incremental vectors give the cuts that embedding every growing text anew gives."""
    rng = np.random.default_rng(4)
    words = "wells pumps water boats ropes lamps roads hills rain port".split()
    for _ in range(60):
        s = [" ".join(rng.choice(words[3 * int(rng.integers(3)) :], int(rng.integers(2, 14)))) for _ in range(int(rng.integers(2, 9)))]
        gaps, chunks, start = [], [], 0
        for i in range(len(s) - 1):
            a, b = hashed([". ".join(s[start : i + 1])])[0], hashed([" ".join(s[i + 1 : i + 3])])[0]
            size = ((a * a).sum() * (b * b).sum()) ** 0.5
            gap = 1 - (a @ b / size if size else 0)
            gaps.append(gap)
            if gap > 0.3:
                text = ". ".join(s[start : i + 1]) + ". "
                if len(text) >= C.SHORT:
                    chunks.append(text)
                elif chunks and gaps[i - 1] < gap:
                    chunks[-1] += text
                else:
                    continue
                start = i + 1
        text = ". ".join(s[start:]) + ". "
        if len(text) < C.SHORT and chunks:
            chunks[-1] += text
        else:
            chunks.append(text)
        assert C.chain(s, hashed, 0.3) == chunks


def test_cap_on_every_group(spark):
    rng = np.random.default_rng(7)
    words = "wells pumps water boats ropes lamps roads hills rain port".split()
    text = "".join(" ".join(rng.choice(words, 12)) + ".\n" for _ in range(80))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    sents = [x for x in text.split(".\n") if x]
    capped = [r["chunk"] for r in C.chunk_semantic_capped(df, limit=400, cap="all").orderBy("chunk_no").collect()]
    assert all(len(c) <= 400 or sum(s in c for s in sents) <= 2 for c in capped)
    free = [r["chunk"] for r in C.chunk_semantic_capped(df, limit=10**6).orderBy("chunk_no").collect()]
    assert free == [r["chunk"] for r in C.chunk_semantic(df, p=90).orderBy("chunk_no").collect()]


def walk(sents, model, threshold):
    """The chained strategy by definition: the running text is embedded anew for each sentence."""
    near = lambda a, b: 1 - (float(a @ b) / (a @ a * (b @ b)) ** 0.5 if a @ a and b @ b else 0.0)
    chunks, text, gaps = [], "", []
    for i in range(len(sents) - 1):
        text += sents[i] + ". "
        gaps.append(near(model([text])[0], model([". ".join(sents[i + 1 : i + 3])])[0]))
        if gaps[i] > threshold:
            if len(text) >= 100:
                chunks.append(text)
            elif chunks and i and gaps[i - 1] < gaps[i]:
                chunks[-1] += text
            else:
                continue
            text = ""
    text += sents[-1] + ". "
    if len(text) < 100 and chunks:
        chunks[-1] += text
    else:
        chunks.append(text)
    return chunks


def letters(texts):
    """An embedder that isn't additive: the shares of letters, and the length."""
    import numpy as np

    return np.array([[t.lower().count(c) / (len(t) + 1) for c in "etaoinshr"] + [len(t) ** 0.5 / 40] for t in texts])


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("threshold", [0.01, 0.05, 0.3])
def test_chain_by_definition(seed, threshold):
    import random

    from archiveloom.functions.vectors import hashed
    from archiveloom.operators.chunking import chain

    rng = random.Random(seed)
    words = "wells ropes lamps boats pumps roads carts tents bricks seeds the of near".split()
    sents = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(2, 25))]
    for model in (hashed, letters):
        assert chain(sents, model, threshold) == walk(sents, model, threshold)


def test_every_strategy_has_a_name(spark):
    from archiveloom.functions.vectors import embedder, register_embedder
    from archiveloom.operators.chunking import STRATEGIES, chunk, longer_than

    df = spark.createDataFrame([(1, "The wells were dry.\nThe road was long.\n" * 9), (2, "short"), (3, ""), (4, None)], "doc_id bigint, text string")
    for name in STRATEGIES:
        got = chunk(df, name).collect()
        assert {r["doc_id"] for r in got} == {1, 2} and all(r["chunk"] for r in got)
    assert longer_than(chunk(df, "char"), 100).count() == 1
    register_embedder("letters", lambda: letters)
    assert embedder("letters")() is letters and chunk(df, "chain", loader=embedder("hashed")).count() >= 2
    with pytest.raises(ValueError):
        embedder("none such")


def test_models_part_long_paragraphs(spark):
    from pyspark.sql import functions as F

    from archiveloom.operators import providers
    from archiveloom.operators.chunking import chunk_combined, chunk_listed

    text = "Short one.\n = Wells = \n" + " ".join(f"Sentence {i} tells of the wells and of the road." for i in range(12))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    listed = lambda t: providers.segments(t, loader=lambda: providers.listing)
    parts = [r["chunk"] for r in chunk_listed(df, size=100, listed=listed).orderBy("chunk_no").collect()]
    assert len(parts) == 13 and parts[0] == "Short one."
    assert [r["chunk"] for r in chunk_listed(df, size=100).orderBy("chunk_no").collect()][0] == "Short one."  # a model without a list leaves it whole
    made = chunk_combined(df, size=100, listed=lambda t: providers.propositions(t, loader=lambda: providers.listing))
    assert made.agg(F.max("chunk_no") + 1).first()[0] == made.count() and made.count() < 13


def test_topics_of_a_model_cut_where_they_change(spark):
    from archiveloom.operators.chunking import chunk_topics
    from archiveloom.operators.topics import lda_topics, run_topics

    sport = "The runners crossed the stadium while swimmers trained.\n"
    water = "The boreholes supplied cisterns and pumping stations.\n"
    df = spark.createDataFrame([(i, sport * 6 + water * 6) for i in range(12)], "doc_id bigint, text string")
    sets = run_topics(df, "doc_id", "text", ["the", "and"], topics=2, rounds=30)
    assert {len(r["sets"]) for r in sets.collect()} == {12}
    chunks = chunk_topics(df, assigned=sets)
    assert chunks.where("doc_id = 0").count() >= 1 and chunks.select("doc_id").distinct().count() == 12
    fixed = spark.createDataFrame([(0, [[0]] * 6 + [[1]] * 6)], "doc_id bigint, sets array<array<int>>")
    cut = [r["chunk"] for r in chunk_topics(df.where("doc_id = 0"), assigned=fixed).orderBy("chunk_no").collect()]
    assert len(cut) == 2 and "runners" in cut[0] and "runners" not in cut[1]
    words = {r["word"] for r in lda_topics(df, "text", ["the", "and"], topics=2, words=4).collect()}
    assert words <= set("runners crossed stadium while swimmers trained boreholes supplied cisterns pumping stations".split()) and len(words) >= 4
    # more words than any fixed vocabulary would hold, and none is dropped
    many = spark.range(400).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, 99), x -> concat('word', chr(cast(97 + x % 26 as int)), chr(cast(97 + id % 26 as int)), chr(cast(97 + id div 26 as int))))) as text")
    assert lda_topics(many, "text", [], topics=2, words=3, rounds=2).count() == 6
