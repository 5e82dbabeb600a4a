"""Exact top-k retrieval. Queries come in blocks of bounded size; each block is broadcast and held against all rows in numpy, partition by
partition, and only each partition's best k travel. No pairs are shuffled and nothing is joined crosswise."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from archiveloom.functions.vectors import hashed
from archiveloom.session import ship, spread

QUERY_BLOCK = 8192
#: Scores that a task holds at once (queries times rows), and candidates it keeps before it drops all but the best of each query.
SCORES, CANDIDATES = 1 << 21, 1 << 20
#: Scores are ranked after rounding, so that sums taken in another order rank alike; ties go to the smaller id.
DIGITS = 9
K1, B = 1.5, 0.75
WORDS = r"([\p{L}\p{N}]+)"


def _best(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "node_id")
    return rows.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, columns: list[str], most: int | None = None) -> Iterator[list]:
    """The query set on the driver, a block at a time."""
    most = most or QUERY_BLOCK
    block = []
    for row in queries.select(*columns).toLocalIterator():
        block.append(row)
        if len(block) == most:
            yield block
            block = []
    if block:
        yield block


class _Best:
    """The k best rows of each query among those seen so far (ties by id), in memory of a fixed size for a block of queries."""

    def __init__(self, qids: list | np.ndarray, k: int):
        self.qids, self.k = np.array(qids, dtype=object), k
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, first: int = 0) -> None:
        """Scores of rows (ids) by queries from ``first`` on; minus infinity is no result."""
        if not scores.size:
            return
        scores = np.round(scores, DIGITS)
        least = np.full(scores.shape[1], -np.inf) if len(ids) <= self.k else np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k]
        row, query = np.nonzero((scores >= least) & (scores > -np.inf))
        self.held.append((query + first, ids[row], scores[row, query]))
        self.n += len(row)
        if self.n > CANDIDATES:
            self._drop()

    def _drop(self) -> None:
        query, ids, scores = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        begin = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        rank = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
        kept = rank < self.k
        self.held = [(query[kept], ids[kept], scores[kept])]
        self.n = int(kept.sum())

    def rows(self) -> Iterator[pd.DataFrame]:
        if self.n:
            self._drop()
            query, ids, scores = self.held[0]
            for at in range(0, len(query), 65_536):
                part = slice(at, at + 65_536)
                yield pd.DataFrame({"qid": self.qids[query[part]], "node_id": ids[part], "score": scores[part]})


def _steps(n: int, width: int) -> Iterator[slice]:
    """Parts of ``n`` rows, each of so many that rows times ``width`` stay within SCORES."""
    step = max(1, SCORES // max(1, width))
    return (slice(i, i + step) for i in range(0, n, step))


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = 3, metric: str = "cosine", skip_self: bool = False) -> DataFrame:
    """Rows (qid, node_id, score, rank) of queries (qid, vec) against corpus (node_id, vec). ``metric``: cosine (0 for a zero vector) or l2 (the
    score is the negative distance). Null vectors are left out; ``skip_self`` leaves out node_id = qid."""
    ship(corpus.sparkSession)
    sc = corpus.sparkSession.sparkContext
    rows = spread(corpus.where("node_id is not null and vec is not null").select("node_id", F.col("vec").cast("array<double>").alias("vec")))
    kind = rows.schema["node_id"].dataType.simpleString()
    qkind = queries.schema["qid"].dataType.simpleString()
    parts = []
    for block in _blocks(queries.where("qid is not null and vec is not null"), ["qid", "vec"]):
        qids = np.array([r["qid"] for r in block], dtype=object)
        given = sc.broadcast((qids, np.array([r["vec"] for r in block], dtype=np.float64)))

        def score(batches: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            qids, q = given.value
            if metric == "cosine":
                size = np.linalg.norm(q, axis=1, keepdims=True)
                q = np.divide(q, size, out=np.zeros_like(q), where=size > 0)
            best = _Best(qids, k)
            for pdf in batches:
                for part in _steps(len(pdf), len(qids)):
                    ids, x = pdf["node_id"].to_numpy()[part], np.stack(pdf["vec"].to_numpy()[part])
                    if metric == "cosine":
                        size = np.linalg.norm(x, axis=1, keepdims=True)
                        s = np.divide(x, size, out=np.zeros_like(x), where=size > 0) @ q.T
                    else:
                        s = -np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * x @ q.T))
                    if skip_self:
                        s[ids[:, None] == qids[None, :]] = -np.inf
                    best.add(s, ids)
            yield from best.rows()

        parts.append(_best(rows.mapInPandas(score, f"qid {qkind}, node_id {kind}, score double"), k))
    empty = corpus.sparkSession.createDataFrame([], f"qid {qkind}, node_id {kind}, score double, rank int")
    return reduce(DataFrame.unionByName, parts) if parts else empty


def postings(corpus: DataFrame) -> DataFrame:
    """The keyword index: rows (node_id, term, tf, dl) of corpus (node_id, text)."""
    words = corpus.where("node_id is not null and text is not null").select("node_id", F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(1)).alias("w"))
    return words.select("node_id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("node_id", "dl", "term").agg(F.count("*").alias("tf")).select("node_id", "term", "tf", "dl")


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """Rows (qid, node_id, score, rank) of queries (qid, text) against corpus (node_id, text), both with unique ids, by Okapi BM25 with idf =
    ln(1 + (N - df + 0.5) / (df + 0.5)). Repeated words of a query count once. Rows without a common word aren't results."""
    spark = corpus.sparkSession
    ship(spark)
    rows = spread(corpus.where("node_id is not null and text is not null").select("node_id", "text"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(1))
    stats = rows.select(F.count("*").alias("n"), F.avg(F.size(words)).alias("avgdl")).first()
    asked = queries.where("qid is not null and text is not null").select("qid", F.array_distinct(words).alias("terms"))
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    df = rows.select("node_id", F.explode(F.array_distinct(words)).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    kinds = queries.schema["qid"].dataType.simpleString(), corpus.schema["node_id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"qid {kinds[0]}, node_id {kinds[1]}, score double, rank int")
    idf_all = asked.select("qid", F.explode("terms").alias("term")).join(df, "term").groupBy("qid").agg(F.collect_list(F.struct("term", "df")).alias("terms"))
    parts = []
    for block in _blocks(idf_all, ["qid", "terms"]):
        at: dict[str, int] = {}
        idf: list[float] = []
        cells = []
        for j, r in enumerate(block):
            for t in r["terms"]:
                if t["term"] not in at:
                    at[t["term"]] = len(idf)
                    idf.append(float(np.log(1 + (stats["n"] - t["df"] + 0.5) / (t["df"] + 0.5))))
                cells.append((at[t["term"]], j))
        given = spark.sparkContext.broadcast(([r["qid"] for r in block], at, np.array(idf), np.array(cells), float(stats["avgdl"] or 1.0)))

        def score(batches: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            import regex

            word = regex.compile(WORDS)
            qids, at, idf, cells, avgdl = given.value
            step, best = 512, _Best(qids, k)
            for pdf in batches:
                for span in _steps(len(pdf), max(len(idf), step)):
                    part = pdf.iloc[span]
                    ids = part["node_id"].to_numpy()
                    tf = np.zeros((len(part), len(idf)))
                    dl = np.zeros(len(part))
                    for i, t in enumerate(part["text"]):
                        w = word.findall(t.lower())
                        dl[i] = len(w)
                        for x in w:
                            if (c := at.get(x)) is not None:
                                tf[i, c] += 1
                    weight = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[:, None] / avgdl))
                    for q0 in range(0, len(qids), step):
                        own = cells[(cells[:, 1] >= q0) & (cells[:, 1] < q0 + step)]
                        q = np.zeros((len(idf), min(step, len(qids) - q0)))
                        q[own[:, 0], own[:, 1] - q0] = 1
                        s = weight @ q
                        s[s <= 0] = -np.inf
                        best.add(s, ids, q0)
            yield from best.rows()

        parts.append(_best(rows.mapInPandas(score, f"qid {kinds[0]}, node_id {kinds[1]}, score double"), k))
    return reduce(DataFrame.unionByName, parts) if parts else empty


def overlap_score(query: Column, text: Column) -> Column:
    """The default reranker: Jaccard overlap of the word sets."""
    a, b = (F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(WORDS), F.lit(1))) for x in (query, text))
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(F.size(F.array_union(a, b)) > 0, both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def rerank(found: DataFrame, queries: DataFrame, corpus: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_score, top: int = 3, keep_score: bool = False) -> DataFrame:
    """The second stage of a cascade: the few candidates of each query scored anew by a dearer scorer."""
    pairs = found.join(queries.select("qid", F.col("text").alias("q_text")), "qid").join(corpus.select("node_id", F.col("text").alias("n_text")), "node_id")
    again = F.round(scorer(F.col("q_text"), F.col("n_text")), DIGITS)
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "node_id")
    rows = pairs.withColumn("retrieval_score", F.col("score")).withColumn("score", again).withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= top)
    return rows.select("qid", "node_id", "score", "rank", *(["retrieval_score"] if keep_score else []))


def maxsim(query_vectors: Column, text_vectors: Column) -> Column:
    """Late interaction: the sum over the query's vectors of the best dot product with the text's (array<array<double>> each)."""
    from archiveloom.functions.vectors import dot

    best = lambda q: F.array_max(F.transform(text_vectors, lambda t: dot(q, t)))
    return F.aggregate(query_vectors, F.lit(0.0), lambda acc, q: acc + F.coalesce(best(q), F.lit(0.0)))


#: Queries and texts that are held against each other at once, each of several vectors.
MANY_BLOCK, MANY_STEP = 1024, 128


def maxsim_topk(queries: DataFrame, corpus: DataFrame, k: int = 3, skip_self: bool = False) -> DataFrame:
    """Rows (qid, node_id, score, rank) by late interaction of queries (qid, vecs) with corpus (node_id, vecs), array<array<double>> each. Rows
    without vectors are left out, as are null vectors; ``skip_self`` leaves out node_id = qid."""
    spark = corpus.sparkSession
    ship(spark)
    there = lambda df, key: df.where(F.col(key).isNotNull()).select(key, F.filter(F.col("vecs").cast("array<array<double>>"), lambda v: v.isNotNull()).alias("vecs")).where("size(vecs) > 0")
    rows = spread(there(corpus, "node_id"))
    kinds = queries.schema["qid"].dataType.simpleString(), rows.schema["node_id"].dataType.simpleString()

    def held(block: list) -> DataFrame:
        given = spark.sparkContext.broadcast((np.array([r["qid"] for r in block], dtype=object), [np.array(r["vecs"], dtype=np.float64) for r in block]))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, asked = given.value
            best = _Best(qids, k)
            starts = lambda xs: np.cumsum([0, *map(len, xs[:-1])])
            for pdf in batches:
                ids, texts = pdf["node_id"].to_numpy(), [np.stack(v) for v in pdf["vecs"]]
                for q0 in range(0, len(asked), MANY_STEP):
                    own = asked[q0 : q0 + MANY_STEP]
                    q, s = np.concatenate(own).T, []
                    for t0 in range(0, len(texts), MANY_STEP):
                        some = texts[t0 : t0 + MANY_STEP]
                        s.append(np.add.reduceat(np.maximum.reduceat(np.concatenate(some) @ q, starts(some), axis=0), starts(own), axis=1))
                    s = np.concatenate(s) if s else np.zeros((0, len(own)))
                    if skip_self:
                        s[ids[:, None] == qids[None, q0 : q0 + MANY_STEP]] = -np.inf
                    best.add(s, ids, q0)
            yield from best.rows()

        return _best(rows.mapInPandas(score, f"qid {kinds[0]}, node_id {kinds[1]}, score double"), k)

    parts = [held(block) for block in _blocks(there(queries, "qid"), ["qid", "vecs"], MANY_BLOCK)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"qid {kinds[0]}, node_id {kinds[1]}, score double, rank int")


def maxsim_score(query: Column, text: Column, loader: Callable = lambda: hashed) -> Column:
    """A reranker by late interaction: :func:`maxsim` of the vectors of the query's words with those of the text's (0 where either has none)."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import regex

        word, model = regex.compile(WORDS), loader()
        for qs, ts in batches:
            out = []
            for q, t in zip(qs, ts):
                a, b = word.findall((q or "").lower()), list(dict.fromkeys(word.findall((t or "").lower())))
                out.append(float((model(a) @ model(b).T).max(axis=1).sum()) if a and b else 0.0)
            yield pd.Series(out, index=qs.index)

    return run(query, text)


#: Sets of words that are broadcast at once; nodes of a bitmap, its bytes at most, pairs of node and word that wait for it, and words of 64 nodes counted at once.
SET_BLOCK, MAP_NODES, MAP_BYTES, MAP_PAIRS, MAP_STEP = 1 << 18, 1 << 13, 1 << 26, 1 << 22, 1 << 16


class _Named:
    """The k best nodes of each set of words, by how many of its words they have, over nodes that come in the order of their ids (ties to the
    earlier). Each word has a bitmap of the nodes that have it; those of a set are added up in binary, 64 nodes at a time."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, n_words: int, k: int):
        """``codes``: the words of all sets, one set after another, of ``sizes`` words each."""
        self.codes, self.of, self.n_words, self.k = codes, np.repeat(np.arange(len(sizes)), sizes), n_words, k
        self.scores = np.zeros((len(sizes), k), dtype=np.int32)
        self.ids = np.full((len(sizes), k), None, dtype=object)

    def add(self, pairs: np.ndarray, ids: np.ndarray) -> None:
        """Nodes ``ids`` that come after all before; ``pairs`` are node number times n_words plus word, each once and in order."""
        word = pairs % self.n_words
        present, local = np.unique(word, return_inverse=True)
        if len(ids) > 64 and (len(ids) > MAP_NODES or len(present) * len(ids) > 8 * MAP_BYTES):
            half = len(ids) // 2
            cut = np.searchsorted(pairs, half * self.n_words)
            self.add(pairs[:cut], ids[:half])
            return self.add(pairs[cut:] - half * self.n_words, ids[half:])
        if not len(pairs):
            return
        node, width = pairs // self.n_words, (len(ids) + 63) // 64
        maps = np.zeros((len(present) + 1) * width * 8, dtype=np.uint8)  # the last row has no nodes
        np.add.at(maps, local * (width * 8) + node // 8, (1 << (node % 8)).astype(np.uint8))
        maps = maps.view("<u8").reshape(len(present) + 1, width)
        row_of = np.full(self.n_words, -1)
        row_of[present] = np.arange(len(present))
        rows = row_of[self.codes]
        sets, rows = self.of[rows >= 0], rows[rows >= 0]
        sizes = np.bincount(sets, minlength=len(self.scores))
        starts = np.cumsum(sizes) - sizes
        asked = np.flatnonzero(sizes > self.scores[:, -1])  # else none of these nodes can come before the k there are
        asked = asked[np.argsort(sizes[asked], kind="stable")]
        step = max(1, MAP_STEP // width)
        for some in (asked[i : i + step] for i in range(0, len(asked), step)):
            nth = np.arange(sizes[some[-1]])
            own = nth < sizes[some][:, None]
            at = np.full(own.shape, len(present))
            at[own] = rows[(starts[some][:, None] + nth)[own]]
            self._count(some, maps, at, ids)

    def _count(self, sets: np.ndarray, maps: np.ndarray, at: np.ndarray, ids: np.ndarray) -> None:
        planes: list[np.ndarray] = []
        for j in range(at.shape[1]):
            carry = maps[at[:, j]]
            for n, plane in enumerate(planes):
                both = plane & carry
                planes[n] = plane ^ carry
                carry = both
            if (j + 1) & j == 0:  # a power of two needs a digit more
                planes.append(carry)
        left = planes[0].copy()
        for plane in planes[1:]:
            left |= plane
        need, found = np.full(len(sets), self.k), []
        least = self.scores[sets, -1]
        live = np.arange(len(sets))
        while len(live):  # the nodes of the next lower score, until there are k
            best, score = left[live], np.zeros(len(live), dtype=np.int32)
            for n in reversed(range(len(planes))):
                on = best & planes[n][live]
                some = on.any(axis=1)
                best = np.where(some[:, None], on, best & ~planes[n][live])
                score += some.astype(np.int32) << n
            good = score > least[live]
            live, best, score = live[good], best[good], score[good]
            if not len(live):
                break
            left[live] &= ~best
            which, cell = np.nonzero(best)
            nth = np.arange(len(which)) - np.searchsorted(which, which)
            which, cell = which[nth < self.k], cell[nth < self.k]
            bits, hits = best[which, cell], []
            for _ in range(self.k):
                on = np.flatnonzero(bits)
                if not len(on):
                    break
                low = bits[on] & (~bits[on] + np.uint64(1))
                hits.append((which[on], cell[on] * 64 + np.log2(low.astype(np.float64)).astype(np.int64)))
                bits[on] ^= low
            which, node = (np.concatenate(x) for x in zip(*hits))
            order = np.lexsort((node, which))
            which, node = which[order], node[order]
            nth = np.arange(len(which)) - np.searchsorted(which, which)
            taken = nth < need[live][which]
            which, node, nth = which[taken], node[taken], nth[taken]
            found.append((live[which], self.k - need[live[which]] + nth, node, score[which]))
            need[live] -= np.bincount(which, minlength=len(live))
            live = live[need[live] > 0]
        if not found:
            return
        which, place, node, score = (np.concatenate(x) for x in zip(*found))
        scores, names = np.zeros((len(sets), self.k), dtype=np.int32), np.full((len(sets), self.k), None, dtype=object)
        scores[which, place], names[which, place] = score, ids[node]
        scores, names = np.concatenate([self.scores[sets], scores], axis=1), np.concatenate([self.ids[sets], names], axis=1)
        order = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
        self.scores[sets], self.ids[sets] = np.take_along_axis(scores, order, axis=1), np.take_along_axis(names, order, axis=1)


def _named_nodes(batches: Iterator[pa.RecordBatch], words: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows (node_id, entities) in the order of node_id: pairs of nodes and words, and the nodes' ids, for ``most`` nodes or more at a time."""
    ids: list = []
    held: list[np.ndarray] = []
    n = 0
    for batch in batches:
        batch = batch.filter(batch.column(1).is_valid())
        names, lists = batch.column(0).to_pylist(), batch.column(1)
        if not names:
            continue
        names = np.array([None, *names], dtype=object)[1:]
        new = np.append(not ids or names[0] != ids[-1], names[1:] != names[:-1]).astype(bool)
        node = len(ids) - 1 + np.cumsum(new)
        ids.extend(names[new])
        code = pc.index_in(lists.flatten(), value_set=words, skip_nulls=True)
        known = code.is_valid().to_numpy(zero_copy_only=False)
        parent = pc.list_parent_indices(lists).to_numpy()
        held.append(np.unique(node[parent[known]] * len(words) + code.drop_null().to_numpy()))
        n += len(held[-1])
        if n > MAP_PAIRS or len(ids) > most:
            held = [np.unique(np.concatenate(held))]
            n = len(held[0])
        if (n > MAP_PAIRS or len(ids) > most) and len(ids) > 1:
            last = (len(ids) - 1) * len(words)  # the last node may go on in the next batch
            cut = np.searchsorted(held[0], last)
            yield held[0][:cut], np.array([None, *ids[:-1]], dtype=object)[1:]
            ids, held = ids[-1:], [held[0][cut:] - last]
            n = len(held[0])
    if n:
        yield np.unique(np.concatenate(held)), np.array([None, *ids], dtype=object)[1:]


def named_topk(queries: DataFrame, nodes: DataFrame, k: int = 3) -> DataFrame:
    """Nodes by the number of their entities that the query names: nodes (node_id, entities array<string>), queries (qid, text); a node may have several
    rows, and so may a query, whose words then count once for each. Nodes without a common word aren't results; a null id comes last in ties.

    Queries of the same words are answered once: their sets of words are broadcast, each task holds all of them against its nodes and only its best k
    of each set travel, so that there are never rows for the pairs of queries and nodes; a digest stands for the set."""
    spark = nodes.sparkSession
    ship(spark)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(1)))
    texts = queries.select("qid", F.array_join(words, " ").alias("terms")).groupBy("qid").agg(F.collect_list(F.nullif("terms", F.lit(""))).alias("texts")).where("size(texts) > 0")
    asked = texts.select("qid", F.array_join(F.array_sort(F.split(F.array_join("texts", " "), " ")), " ").alias("terms"))
    parts = max(1, spark.sparkContext.defaultParallelism)
    rows = nodes.select("node_id", "entities").repartition(parts, "node_id").sortWithinPartitions(F.col("node_id").asc_nulls_last())
    kinds = queries.schema["qid"].dataType.simpleString(), nodes.schema["node_id"].dataType.simpleString()
    kind = to_arrow_type(nodes.schema["node_id"].dataType)

    def held(block: list) -> DataFrame:
        at: dict[str, int] = {}
        codes = [[at.setdefault(t, len(at)) for t in r["terms"].split(" ")] for r in block]
        sizes = np.array([len(c) for c in codes])
        given = spark.sparkContext.broadcast(([md5(r["terms"].encode()).digest() for r in block], np.concatenate(codes), sizes, list(at)))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            digests, codes, sizes, words = given.value
            best = _Named(codes, sizes, len(words), k)
            for pairs, ids in _named_nodes(batches, pa.array(words, pa.string()), MAP_NODES):
                best.add(pairs, ids)
            for i in range(0, len(digests), 1 << 15):
                there = best.scores[i : i + (1 << 15)]
                own, place = np.nonzero(there)
                columns = pa.array(digests[i : i + (1 << 15)], pa.binary()).take(pa.array(own)), pa.array(best.ids[i + own, place].tolist(), kind), pa.array(there[own, place])
                yield pa.RecordBatch.from_arrays(list(columns), ["digest", "node_id", "hits"])

        return rows.mapInArrow(score, f"digest binary, node_id {kinds[1]}, hits int")

    found = [held(block) for block in _blocks(asked.select("terms").distinct(), ["terms"], SET_BLOCK)]
    if not found:
        return spark.createDataFrame([], f"qid {kinds[0]}, node_id {kinds[1]}, score double, rank int")
    w = Window.partitionBy("digest").orderBy(F.col("hits").desc(), F.col("node_id").asc_nulls_last())
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
    return asked.select("qid", F.unhex(F.md5("terms")).alias("digest")).join(best, "digest").select("qid", "node_id", F.col("hits").cast("double").alias("score"), "rank")


def graph_topk(queries: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """Nodes by the number of their edges' entities (src or dst) that the query names: edges (src, dst, node_id), queries (qid, text)."""
    return named_topk(queries, edges.select("node_id", F.array(F.lower("src"), F.lower("dst")).alias("entities")), k)
