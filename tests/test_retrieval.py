import numpy as np
import pytest
from pyspark.sql import functions as F

from archiveloom.operators import metrics as M
from archiveloom.operators import reporting as R
from archiveloom.operators import retrieval as S


def test_dense_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (200, 8)).astype(float)
    x[5] = 0
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    corpus = spark.createDataFrame([*rows, (900, None)], "node_id bigint, vec array<double>")
    queries = spark.createDataFrame([*rows[::20], (901, None)], "qid bigint, vec array<double>")
    size = np.linalg.norm(x, axis=1)
    cos = np.round(np.divide(x @ x.T, np.outer(size, size), out=np.zeros((200, 200)), where=np.outer(size, size) > 0), 9)
    far = np.round(-np.linalg.norm(x[:, None] - x[None], axis=2), 9)
    for metric, score in (("cosine", cos), ("l2", far)):
        got = {(r["qid"], r["rank"]): r["node_id"] for r in S.dense_topk(queries, corpus, 4, metric, skip_self=True).collect()}
        for q in range(0, 200, 20):
            order = sorted((i for i in range(200) if i != q), key=lambda i: (-score[q, i], i))[:4]
            assert [got[q, k] for k in range(1, 5)] == order
    assert S.dense_topk(queries.limit(0), corpus, 3).collect() == [] and S.dense_topk(queries, corpus.limit(0), 3).collect() == []


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(S, "QUERY_BLOCK", 3)
    rows = [(i, [float(i), 1.0]) for i in range(10)]
    corpus = spark.createDataFrame(rows, "node_id bigint, vec array<double>")
    got = S.dense_topk(corpus.withColumnRenamed("node_id", "qid"), corpus, 1).collect()
    assert sorted((r["qid"], r["node_id"]) for r in got) == [(i, i) for i in range(10)]


def test_bm25_against_the_formula(spark):
    texts = {"a": "wells and pumps and wells", "b": "boats and ropes", "c": "the wells of the port", "d": None, "e": "", "f": "boats and ropes"}
    corpus = spark.createDataFrame(list(texts.items()), "node_id string, text string")
    queries = spark.createDataFrame([("q1", "Wells, wells of boats?"), ("q2", "nothing here"), ("q3", None), ("q4", "ropes")], "qid string, text string")
    words = {k: t.split() for k, t in texts.items() if t is not None}
    n, avg = len(words), sum(map(len, words.values())) / len(words)

    def score(q, d):
        out = 0
        for t in set(q):
            df = sum(t in w for w in words.values())
            tf = words[d].count(t)
            if tf:
                out += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words[d]) / avg))
        return out

    got = S.bm25_topk(queries, corpus, 3).collect()
    want = {d: score(["wells", "of", "boats"], d) for d in words}
    assert {r["node_id"]: r["score"] for r in got if r["qid"] == "q1"} == {d: pytest.approx(s) for d, s in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:3]}
    assert [(r["node_id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"]) if r["qid"] == "q4"] == [("b", 1), ("f", 2)]
    assert {r["qid"] for r in got} == {"q1", "q4"}
    again = S.rerank(S.bm25_topk(queries, corpus, 3), queries, corpus, top=1, keep_score=True).collect()
    assert {r["qid"]: r["node_id"] for r in again} == {"q1": "c", "q4": "b"}
    assert S.bm25_topk(queries, corpus.limit(0)).collect() == [] and S.bm25_topk(queries.limit(0), corpus).collect() == []
    assert {(r["node_id"], r["term"]): r["tf"] for r in S.postings(corpus).collect()}["a", "wells"] == 2


def test_maxsim_and_graph(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[0.5, 0.0], [0.2, 0.9]])], "q array<array<double>>, t array<array<double>>")
    assert df.select(S.maxsim(F.col("q"), F.col("t")).alias("s")).first()["s"] == pytest.approx(1.4)
    edges = spark.createDataFrame([("Wells", "Port", "n1"), ("Boats", "Port", "n2")], "src string, dst string, node_id string")
    asked = spark.createDataFrame([("q", "Which wells are at the port?")], "qid string, text string")
    assert [(r["node_id"], r["rank"]) for r in sorted(S.graph_topk(asked, edges).collect(), key=lambda r: r["rank"])] == [("n1", 1), ("n2", 2)]


def test_metrics(spark):
    rows = [("1", ["x"], ["a", "x", "b"]), ("2", ["x", "y"], ["x", "b", "y"]), ("3", ["x"], None), ("4", [], ["a"]), ("5", None, None), ("6", ["x"], ["x", "x"])]
    df = spark.createDataFrame([(*r, "r") for r in rows], "qid string, expected_ids array<string>, retrieved_ids array<string>, retriever string")
    got = {r["qid"]: r for r in M.retriever_metrics(df).collect()}
    one = got["1"]
    assert (one["hit_rate"], one["mrr"], one["recall"], one["ap"]) == (1, 0.5, 1, 0.5) and one["precision"] == pytest.approx(1 / 3) and one["ndcg"] == pytest.approx(0.6309, abs=1e-4)
    assert got["2"]["ap"] == pytest.approx((1 + 2 / 3) / 2) and got["3"]["hit_rate"] == 0 and got["3"]["ndcg"] == 0 and got["4"]["recall"] is None and got["5"]["mrr"] == 0 and got["6"]["precision"] == 1
    assert all(r["hit_rate"] >= r["mrr"] for r in got.values())
    assert M.metrics_mean(M.retriever_metrics(df)).first()["n_queries"] == 6


def test_judged_keeps_queries_without_results(spark):
    q = spark.createDataFrame([("1", "a"), ("2", "b")], "qid string, text string")
    found = spark.createDataFrame([("1", "n2", 2), ("1", "n1", 1)], "qid string, node_id string, rank int")
    rel = spark.createDataFrame([("1", "n1"), ("2", "n3")], "qid string, node_id string")
    got = {r["qid"]: r for r in M.judged(found, q, rel).collect()}
    assert got["1"]["retrieved_ids"] == ["n1", "n2"] and got["2"]["retrieved_ids"] is None and got["2"]["expected_ids"] == ["n3"]


def test_helpers(spark):
    q = spark.createDataFrame([("1", "Question: a"), ("2", "```x"), ("3", "import y"), ("4", "Why?"), ("5", None)], "qid string, text string")
    good, rel = M.select_qa(q, spark.createDataFrame([("4", "n"), ("1", "n")], "qid string, node_id string"))
    assert [r["qid"] for r in good.collect()] == ["4"] and [r["qid"] for r in rel.collect()] == ["4"]
    nodes = spark.createDataFrame([("n", ("CAP_ENG.md", "1")), ("m", (None, "2"))], "id_ string, metadata struct<title:string,doc_id:string>")
    evals = spark.createDataFrame([("1", ["n"], ["n"]), ("2", ["m"], ["n"]), ("3", ["gone"], None)], "qid string, expected_ids array<string>, retrieved_ids array<string>")
    assert sorted((r["language"], round(r["accuracy"], 6), r["n"]) for r in M.language_accuracy(evals, nodes).collect()) == [("ALL", 0.333333, 3), ("ENG", 1.0, 1), ("FR", 0.0, 2)]
    assert M.pass_rate(spark.createDataFrame([(True,), (None,)], "p boolean"), F.col("p")).first()["pass_rate"] == 0.5
    rows = spark.range(1000)
    assert M.sample_rows(rows, "id", 500).count() == 500 and M.sample_rows(rows, "id", 5).collect() == M.sample_rows(rows.repartition(7), "id", 5).collect()
    assert [r["id"] for r in M.rows_from(rows, "id", 10, 12).collect()] == [10, 11]


def test_reports(spark):
    df = spark.createDataFrame([("m", 1, 0.4), ("m", 2, 0.5), ("m", 3, 0.8)], "metric string, stage int, score double")
    got = [(r["gain"], r["gain_share"]) for r in R.increments(df, "metric", "stage", "score").orderBy("stage").collect()]
    assert got == [(0.4, 50.0), (pytest.approx(0.1), 12.5), (pytest.approx(0.3), 37.5)]
    scale = df.select(R.rescaled(F.col("score"), F.lit(0.4), F.lit(0.8), 10, 0).alias("x"), R.rescaled(F.col("score"), F.lit(0.5), F.lit(0.8)).alias("y")).collect()
    assert [r["x"] for r in scale] == [10, pytest.approx(7.5), 0] and scale[0]["y"] is None
    wide = R.wide(df, "metric", "stage", "score", [1, 2, 3])
    assert R.long(wide.select("metric", *[F.col(str(i)).alias(f"s{i}") for i in (1, 2, 3)]), "metric", ["s1", "s2", "s3"]).count() == 3


def test_maxsim_of_all_queries(spark, monkeypatch):
    monkeypatch.setattr(S, "MANY_BLOCK", 3)
    rng = np.random.default_rng(4)
    texts = {i: rng.integers(-3, 4, (1 + i % 4, 5)).astype(float) for i in range(40)}
    corpus = spark.createDataFrame([*((i, x.tolist()) for i, x in texts.items()), (900, []), (901, None)], "node_id bigint, vecs array<array<double>>")
    asked = corpus.where("node_id % 5 = 0").withColumnRenamed("node_id", "qid")
    got = {(r["qid"], r["rank"]): (r["node_id"], r["score"]) for r in S.maxsim_topk(asked, corpus, 3, skip_self=True).collect()}
    score = lambda q, t: float((texts[q] @ texts[t].T).max(axis=1).sum())
    want = {}
    for q in range(0, 40, 5):
        for k, t in enumerate(sorted((t for t in texts if t != q), key=lambda t: (-score(q, t), t))[:3], 1):
            want[q, k] = t, score(q, t)
    assert got == want
    assert S.maxsim_topk(asked.limit(0), corpus).collect() == []
    found = spark.createDataFrame([("q", "a", 2.0, 1), ("q", "b", 1.0, 2)], "qid string, node_id string, score double, rank int")
    again = S.rerank(found, spark.createDataFrame([("q", "wells of boats")], "qid string, text string"), spark.createDataFrame([("a", "wells"), ("b", "boats of wells")], "node_id string, text string"), S.maxsim_score, keep_score=True)
    assert [(r["node_id"], r["rank"], r["retrieval_score"]) for r in again.orderBy("rank").collect()] == [("b", 1, 1.0), ("a", 2, 2.0)]


def test_best_rows_in_bounded_memory(monkeypatch):
    """Blocks of any size and early drops give the ranking of a whole sort, ties by id."""
    import numpy as np

    from archiveloom.operators import retrieval

    rng = np.random.default_rng(3)
    scores, ids = rng.integers(0, 9, (700, 13)) / 8.0, rng.permutation(700)
    scores[rng.random(scores.shape) < 0.1] = -np.inf
    monkeypatch.setattr(retrieval, "CANDIDATES", 50)
    best = retrieval._Best(list("abcdefghijklm"), 4)
    for part in retrieval._steps(700, 100_000):
        best.add(scores[part, :8], ids[part])
        best.add(scores[part, 8:], ids[part], 8)
    got = {q: list(zip(g["score"], g["node_id"])) for frame in best.rows() for q, g in frame.groupby("qid")}
    for j, q in enumerate("abcdefghijklm"):
        order = sorted((-s, i) for s, i in zip(scores[:, j], ids) if s > -np.inf)[:4]
        assert got[q] == [(-s, i) for s, i in order]


def test_nodes_by_named_entities(spark, monkeypatch):
    """All pairs counted one by one give the same rows, whatever the sizes of maps and blocks; ids, queries and texts may be null or come twice."""
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(40)]
    pick = lambda n: [words[i] for i in np.minimum(rng.geometric(0.1, n) - 1, 39)]
    nodes = [(f"n{rng.integers(300):03}" if i % 50 else None, [*pick(rng.integers(0, 9)), None]) for i in range(600)] + [("n000", ["n000", *words] * 3), ("n001", None)]
    asked = [(f"q{i % 110}" if i % 40 else None, " ".join(pick(rng.integers(0, 12))).upper() + "? N000") for i in range(120)] + [("q1", None), ("q2", " ".join(words * 2)), ("q3", "absent"), ("q5", "word3 n001")]
    has, count = {}, {}
    for node, entities in nodes:
        has.setdefault(node, set()).update(e for e in entities or [] if e)
    for qid, text in asked:
        for w in set((text or "").lower().replace("?", "").split()):
            for node in has:
                if w in has[node]:
                    count[qid, node] = count.get((qid, node), 0) + 1
    want = {}
    for qid in {q for q, _ in count}:
        order = sorted((-n, node is None, node or "", node) for (q, node), n in count.items() if q == qid)[:3]
        want |= {(qid, rank): (o[3], float(-o[0])) for rank, o in enumerate(order, 1)}
    given = spark.createDataFrame(nodes, "node_id string, entities array<string>").repartition(7), spark.createDataFrame(asked, "qid string, text string")
    for most, block in ((1 << 14, 1 << 18), (70, 11)):
        monkeypatch.setattr(S, "MAP_NODES", most)
        monkeypatch.setattr(S, "SET_BLOCK", block)
        got = S.named_topk(given[1], given[0]).collect()
        assert {(r["qid"], r["rank"]): (r["node_id"], r["score"]) for r in got} == want and len(got) == len(want)
    assert S.named_topk(given[1].limit(0), given[0]).collect() == [] and S.named_topk(given[1], given[0].limit(0)).collect() == []


def test_no_rows_for_pairs_of_queries_and_nodes(spark):
    """Queries and nodes that share a word aren't joined by it: no words are made rows, and queries meet their answers in the only join."""
    edges = spark.createDataFrame([("wells", f"port{i}", f"n{i:03}") for i in range(200)], "src string, dst string, node_id string")
    asked = spark.createDataFrame([(f"q{i}", f"wells of port{i % 7}") for i in range(200)], "qid string, text string")
    found = S.graph_topk(asked, edges)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 1
    assert {(r["qid"], r["rank"]): (r["node_id"], r["score"]) for r in found.collect()} == {(f"q{i}", rank): x for i in range(200) for rank, x in enumerate([(f"n{i % 7:03}", 2.0), *[(f"n{j:03}", 1.0) for j in range(3) if j != i % 7][:2]], 1)}


@pytest.mark.parametrize("most, size, pairs, step", [(1 << 14, 1 << 26, 1 << 22, 1 << 14), (70, 64, 30, 1), (500, 300, 1 << 22, 7), (3, 1 << 26, 40, 100)])
def test_maps_of_any_size(monkeypatch, most, size, pairs, step):
    """Nodes in parts of any size, rows of one node in several batches, and words that a set holds twice."""
    import pyarrow as pa

    monkeypatch.setattr(S, "MAP_BYTES", size)
    monkeypatch.setattr(S, "MAP_PAIRS", pairs)
    monkeypatch.setattr(S, "MAP_STEP", step)
    monkeypatch.setattr(S, "MAP_NODES", most)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(30)]
    nodes = sorted((int(rng.integers(700)), [words[i] for i in rng.integers(0, 30, rng.integers(0, 7))]) for _ in range(1500))
    sets = [[int(i) for i in rng.integers(0, 30, rng.integers(1, 40 if j % 9 == 0 else 6))] for j in range(60)]
    has = {}
    for node, entities in nodes:
        has.setdefault(node, set()).update(entities)
    batches = [pa.RecordBatch.from_arrays([pa.array([f"{n:03}" for n, _ in nodes[i : i + 13]]), pa.array([e for _, e in nodes[i : i + 13]], pa.list_(pa.string()))], ["node_id", "entities"]) for i in range(0, 1500, 13)]
    best = S._Named(np.concatenate(sets), np.array([len(s) for s in sets]), 30, 4)
    for found, ids in S._named_nodes(batches, pa.array(words), most):
        best.add(found, ids)
    for j, s in enumerate(sets):
        order = sorted((-sum(words[c] in e for c in s), n) for n, e in has.items())[:4]
        assert [(-int(x), int(n)) for x, n in zip(best.scores[j], best.ids[j]) if x] == [o for o in order if o[0]]


def test_graph_retrieval_answers_every_question(spark, tmp_path):
    """Whatever its id, a question that names a node's words has its nodes."""
    from archiveloom.plans import QUERIES

    spark.createDataFrame([("n1", "Harbour cranes, harbour lights"), ("n2", "Cranes and ropes"), ("n3", None)], "node_id string, text string").write.parquet(f"{tmp_path}/qa_corpus.parquet")
    ids = [f"{i:08x}-0" for i in range(1, 41)]
    spark.createDataFrame([*((q, "Which harbour has cranes?") for q in ids), ("00000000-1", None), ("00000000-2", "Why?"), (None, "n2")], "qid string, text string").write.parquet(f"{tmp_path}/qa_queries.parquet")
    got = sorted(tuple(r) for r in QUERIES["graph_retrieval"](spark, str(tmp_path)).where("qid is not null").collect())
    assert got == [(q, *row) for q in ids for row in (("n1", 2.0, 1), ("n2", 1.0, 2))]
    assert [tuple(r) for r in QUERIES["graph_retrieval"](spark, str(tmp_path)).where("qid is null").collect()] == [(None, "n2", 1.0, 1)]
