"""Chunking strategies. Each takes (doc_id, text) and gives (doc_id, chunk_no, chunk), so that they can stand in for one another.

Distances are taken in one Arrow call per batch of documents; windows, thresholds, breaks and the fold that assembles the
chunks are Column expressions on arrays, so no strategy shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archiveloom.functions import text as T
from archiveloom.functions.vectors import Embedder, hashed
from archiveloom.operators.providers import propositions, segments
from archiveloom.session import spread

SHORT = 100


# ---- context windows ---------------------------------------------------------------------------------------------------------


def context_windows(sents: Column, around: int = 1) -> Column:
    """Each sentence with so many on either side, joined by spaces."""
    return F.transform(sents, lambda x, i: F.array_join(F.slice(sents, F.greatest(i - around, F.lit(0)) + 1, F.least(i, F.lit(around)) + around + 1), " "))


def pair_windows(sents: Column, around: int = 1) -> Column:
    """array<struct<before, after>>: up to a sentence and from it on, each sentence followed by '. '."""
    run = lambda first, n: F.concat(F.array_join(F.slice(sents, first, n), ". "), F.lit(". "))
    return F.transform(sents, lambda x, i: F.struct(run(F.greatest(i - around, F.lit(0)) + 1, F.least(i, F.lit(around)) + 1).alias("before"), run(i + 1, F.lit(around + 1)).alias("after")))


# ---- distances ---------------------------------------------------------------------------------------------------------------


def _cosine_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    return 1 - np.divide((a * b).sum(1), size, out=np.zeros(len(a)), where=size > 0)


def distances(left: Column, right: Column, loader: Callable[[], Embedder] = lambda: hashed) -> Column:
    """Cosine distance of each text of ``left`` but the last to the next text of ``right`` (array<string> each)."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = loader()
        for a, b in batches:
            out = []
            for x, y in zip(a, b):
                x, y = list(x) if x is not None else [], list(y) if y is not None else []
                out.append(_cosine_distances(model(x[:-1]), model(y[1:])) if len(x) > 1 else np.zeros(0))
            yield pd.Series(out, index=a.index, dtype=object)

    # not to be worked out anew in each place that the distances are used
    return run.asNondeterministic()(left, right)


def percentile(values: Column, p: float) -> Column:
    """Linear percentile of an array, computed step by step so that every engine gets the same bits. Null for an empty array."""
    at = (F.size(values) - 1) * F.lit(p / 100)
    low = F.floor(at).cast("int")

    def between(ordered: Column) -> Column:
        a, b = F.get(ordered, low), F.coalesce(F.get(ordered, low + 1), F.get(ordered, low))
        return a + (b - a) * (at - low)

    return T.let(F.array_sort(values), between)


def breaks_above(values: Column, threshold: Column) -> Column:
    """Positions (from 0) of the values strictly above a threshold."""
    return T.let(threshold, lambda t: F.filter(F.transform(values, lambda d, i: F.when(d > t, i)), lambda i: i.isNotNull()))


# ---- the fold ----------------------------------------------------------------------------------------------------------------


def assemble(sents: Column, values: Column, breaks: Column, joint: str = " ", end: str = "", falling: bool = False, merge_tail: bool = False) -> Column:
    """Chunks of the sentences between breaks.

    A short piece before any chunk flows into the next; a later one goes to the chunk before it, without a space, if the value
    before it is below the one at the break (above, if ``falling``), and flows on otherwise. What is left at the end is a chunk of
    its own, unless it is short and ``merge_tail``.
    """
    empty = F.struct(F.lit(0).alias("start"), F.array().cast("array<string>").alias("chunks"))
    last = lambda c: F.element_at(c, -1)
    grown = lambda c, t: F.concat(F.slice(c, 1, F.size(c) - 1), F.array(F.concat(last(c), t)))

    def step(acc: Column, b: Column) -> Column:
        start, chunks = acc["start"], acc["chunks"]
        text = F.concat(F.array_join(F.slice(sents, start + 1, b - start + 1), joint), F.lit(end))
        short = F.length(text) < SHORT
        x, y = F.get(values, start - 1), F.get(values, b)
        nearer = (x > y) if falling else (x < y)
        glue = short & (F.size(chunks) > 0) & nearer
        return F.when(~short | glue, F.struct((b + 1).alias("start"), F.when(short, grown(chunks, text)).otherwise(F.concat(chunks, F.array(text))).alias("chunks"))).otherwise(acc)

    def finish(acc: Column) -> Column:
        start, chunks = acc["start"], acc["chunks"]
        text = F.array_join(F.slice(sents, start + 1, F.greatest(F.size(sents) - start, F.lit(0))), joint)
        tail = F.concat(chunks, F.array(text))
        if merge_tail:
            tail = F.when((F.length(text) < SHORT) & (F.size(chunks) > 0), grown(chunks, text)).otherwise(tail)
        return F.when(start < F.size(sents), tail).otherwise(chunks)

    return F.aggregate(breaks, empty, step, finish)


def _numbered(df: DataFrame, chunks: Column) -> DataFrame:
    return df.select("doc_id", F.posexplode(chunks).alias("chunk_no", "chunk"))


def _whole_if_few(sents: Column, text: Column, chunks: Column, least: int = 2) -> Column:
    return F.when(F.size(sents) < least, F.array(text)).otherwise(chunks)


def _docs(df: DataFrame, key: str, text: str) -> DataFrame:
    return spread(df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("doc_id"), F.col(text).alias("text")))


def semantic_distances(df: DataFrame, key: str = "doc_id", text: str = "text", around: int = 1, pairs: bool = False, loader: Callable[[], Embedder] = lambda: hashed) -> DataFrame:
    """Rows (doc_id, text, sents, d): the sentences of each document and the distances between neighbours."""
    rows = _docs(df, key, text).withColumn("sents", T.split_sentences(F.col("text"), 3 if pairs else 1))
    if pairs:
        rows = rows.withColumn("w", pair_windows(F.col("sents"), around))
        return rows.withColumn("d", distances(F.col("w.before"), F.col("w.after"), loader)).drop("w")
    rows = rows.withColumn("w", context_windows(F.col("sents"), around))
    return rows.withColumn("d", distances(F.col("w"), F.col("w"), loader)).drop("w")


def chunk_semantic(df: DataFrame, key: str = "doc_id", text: str = "text", p: float = 95, around: int = 1, loader: Callable[[], Embedder] = lambda: hashed) -> DataFrame:
    """Cuts where the distance of neighbouring sentences (with their context) is above its percentile in the document."""
    rows = semantic_distances(df, key, text, around, False, loader)
    s, d = F.col("sents"), F.col("d")
    return _numbered(rows, _whole_if_few(s, F.col("text"), assemble(s, d, breaks_above(d, percentile(d, p)))))


def chunk_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", p: float = 90, around: int = 1, loader: Callable[[], Embedder] = lambda: hashed) -> DataFrame:
    """As :func:`chunk_semantic`, with the distance of what comes before to what comes after; sentences joined by '. '."""
    rows = semantic_distances(df, key, text, around, True, loader)
    s, d = F.col("sents"), F.col("d")
    return _numbered(rows, _whole_if_few(s, F.col("text"), assemble(s, d, breaks_above(d, percentile(d, p)), ". ", ". ", merge_tail=True)))


def split_group(texts: list[str], d: list[float], limit: int, joint: str = " ") -> list[str]:
    """A group of sentences in parts: cut after the greatest distance (the last one aside), again and again, while a part is longer than
    the limit and has two distances or more."""
    done, todo = [], [(0, len(texts))]
    while todo:
        a, b = todo.pop()
        inner = d[a : b - 1]
        if len(joint.join(texts[a:b])) <= limit or len(inner) < 2:
            done.append(joint.join(texts[a:b]))
            continue
        cut = a + int(np.argmax(inner[:-1])) + 1
        todo += [(cut, b), (a, cut)]
    return done


def chunk_semantic_capped(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 1024, p: float = 90, around: int = 1, cap: str = "tail", loader: Callable[[], Embedder] = lambda: hashed) -> DataFrame:
    """:func:`chunk_semantic` with a size limit on the last group (``cap='tail'``) or on every one (``'all'``)."""
    rows = semantic_distances(df, key, text, around, False, loader)
    d = F.col("d")
    rows = rows.withColumn("b", breaks_above(d, percentile(d, p)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, whole, s, dist, b in zip(pdf["doc_id"], pdf["text"], pdf["sents"], pdf["d"], pdf["b"]):
                s, dist = list(s), list(dist)
                if len(s) < 2:
                    out.append((doc, 0, whole))
                    continue
                ends, chunks = set(b), []
                for first, last, glued in walked(len(s), lambda _, i: i in ends, lambda x, y: len(" ".join(s[x:y])), lambda at, i: dist[at - 1] < dist[i]):
                    if glued:
                        chunks[-1] += " ".join(s[first:last])
                    elif cap == "all" or last == len(s):
                        chunks += split_group(s[first:last], dist[first : last - 1], limit)
                    else:
                        chunks.append(" ".join(s[first:last]))
                out += [(doc, k, c) for k, c in enumerate(chunks)]
            yield pd.DataFrame(out, columns=["doc_id", "chunk_no", "chunk"])

    return rows.select("doc_id", "text", "sents", "d", "b").mapInPandas(run, f"doc_id {df.schema[key].dataType.simpleString()}, chunk_no int, chunk string")


def walked(n: int, cuts: Callable[[int, int], bool], size: Callable[[int, int], int], nearer: Callable[[int, int], bool]) -> Iterator[tuple[int, int, bool]]:
    """Groups (first, end, glued) of ``n`` sentences, where a cut may depend on where its group began: ``cuts(first, i)`` after sentence i.

    A short group flows into the next one, or is glued to the one before it if that is ``nearer(first, i)``; what is left is the last group.
    """
    first, any_ = 0, False
    for i in range(n - 1):
        if not cuts(first, i):
            continue
        short = size(first, i + 1) < SHORT
        if not short or any_ and nearer(first, i):
            yield first, i + 1, short
            first, any_ = i + 1, True
    if first < n:
        yield first, n, False


def chain(sents: list[str], model: Embedder, threshold: float) -> list[str]:
    """Cuts where the text so far is further than the threshold from the next two sentences. An embedder marked additive sums the vectors of the
    sentences so far; any other embeds the running text anew at each step."""
    n = len(sents)
    joined = lambda a, b: ". ".join(sents[a:b]) + ". "
    if getattr(model, "additive", False):
        own = model(sents)
        ahead = own + np.vstack([own[1:], np.zeros((1, own.shape[1]))])
        before = np.vstack([np.zeros((1, own.shape[1])), np.cumsum(own, axis=0)])
        so_far = lambda first, i: before[i + 1] - before[first]
    else:
        ahead = model([". ".join(sents[i : i + 2]) for i in range(n)])
        so_far = lambda first, i: model([joined(first, i + 1)])[0]
    gaps: list[float] = []

    def cuts(first: int, i: int) -> bool:
        gaps.append(float(_cosine_distances(so_far(first, i)[None], ahead[i + 1][None])[0]))
        return gaps[i] > threshold

    chunks: list[str] = []
    for first, end, glued in walked(n, cuts, lambda a, b: len(joined(a, b)), lambda first, i: i > 0 and gaps[i - 1] < gaps[i]):
        text = joined(first, end)
        if chunks and (glued or end == n and len(text) < SHORT):
            chunks[-1] += text
        else:
            chunks.append(text)
    return chunks


def chunk_chain(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3, loader: Callable[[], Embedder] = lambda: hashed) -> DataFrame:
    """The chained strategy: each cut depends on the cuts before it, so a document is walked in one call."""
    rows = _docs(df, key, text).withColumn("sents", T.split_sentences(F.col("text"), 3))

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = loader()
        for whole, s in batches:
            yield pd.Series([chain(list(x), model, threshold) if len(x) > 1 else [t] for t, x in zip(whole, s)], index=whole.index, dtype=object)

    return _numbered(rows, run(F.col("text"), F.col("sents")))


def topic_sets(sents: Column, stop: list[str], topics: int = 16, top: int = 3) -> Column:
    """The leading topics of each run of three sentences (the last two alone), as sets of topic numbers.

    The default topics are buckets of hashed words, taken by count; a topic model's assignments can stand in for them.
    """
    bucket = lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % topics

    def leading(s: Column) -> Column:
        counted = lambda at: F.transform(F.array_distinct(at), lambda k: F.struct((-F.size(F.filter(at, lambda x: x == k))).alias("n"), k.alias("k")))
        return F.transform(F.slice(F.array_sort(T.let(F.transform(T.topic_tokens(s, stop), bucket), counted)), 1, top), lambda x: x["k"])

    n = F.size(sents)
    runs = lambda each: F.transform(each, lambda x, i: F.when(i < n - 2, F.array_distinct(F.flatten(F.slice(each, i + 1, 3)))).otherwise(x))
    return T.let(F.transform(sents, leading), runs)


def coherence(sets: Column) -> Column:
    """Cosine of the membership vectors of neighbouring sets; 0 beside an empty set."""
    near = lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a).cast("double") * F.size(b))).otherwise(F.lit(0.0))
    return F.when(F.size(sets) > 1, F.transform(F.sequence(F.lit(0), F.size(sets) - 2), lambda i: near(F.get(sets, i), F.get(sets, i + 1)))).otherwise(F.array().cast("array<double>"))


def chunk_topics(df: DataFrame, key: str = "doc_id", text: str = "text", stop: list[str] | None = None, threshold: float = 0.5, assigned: DataFrame | None = None) -> DataFrame:
    """Cuts where the topics of neighbouring runs of sentences cohere less than the threshold. ``assigned`` (doc_id, sets) holds a topic model's topics of each
    run (as :func:`archiveloom.operators.topics.run_topics` gives them); without it words in hashed buckets stand for topics."""
    rows = _docs(df, key, text).withColumn("sents", T.split_sentences(F.col("text"), 3))
    rows = rows.withColumn("sets", topic_sets(F.col("sents"), stop or [])) if assigned is None else rows.join(assigned.select("doc_id", "sets"), "doc_id", "left")
    rows = rows.withColumn("c", coherence(F.coalesce("sets", F.array().cast("array<array<int>>"))))
    s, c = F.col("sents"), F.col("c")
    below = F.filter(F.transform(c, lambda x, i: F.when(x < threshold, i)), lambda i: i.isNotNull())
    return _numbered(rows, _whole_if_few(s, F.col("text"), assemble(s, c, below, ". ", ". ", falling=True, merge_tail=True), 3))


def _paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (doc_id, at, para): the paragraphs of each text with their headings in line, in order."""
    rows = _docs(df, key, text)
    return rows.select("doc_id", F.posexplode(T.paragraphs(T.inline_headings(F.col("text")))).alias("at", "para"))


def _renumbered(parts: DataFrame) -> DataFrame:
    """Rows (doc_id, chunk_no, chunk) of rows (doc_id, at, chunks): numbered through each text."""
    each = parts.select("doc_id", "at", F.posexplode("chunks").alias("within", "chunk"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "within")) - 1
    return each.select("doc_id", nth.cast("int").alias("chunk_no"), "chunk")


def chunk_combined(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1024, p: float = 95, around: int = 1, listed: Callable[[Column], Column] = propositions, loader: Callable[[], Embedder] = lambda: hashed) -> DataFrame:
    """Paragraphs up to ``size`` characters stay whole; longer ones are turned into statements by a model (``listed``), whose runs are cut as in
    :func:`chunk_semantic`. A paragraph for which the model gives no list stays whole."""
    rows = _paragraphs(df, key, text)
    rows = rows.withColumn("sents", F.when(F.length("para") > size, listed(F.when(F.length("para") > size, F.col("para")))))
    rows = rows.withColumn("sents", F.coalesce("sents", F.array("para"))).withColumn("w", context_windows(F.col("sents"), around))
    d = F.col("d")
    rows = rows.withColumn("d", distances(F.col("w"), F.col("w"), loader))
    chunks = assemble(F.col("sents"), d, breaks_above(d, percentile(d, p)))
    return _renumbered(rows.withColumn("chunks", F.when(F.size("sents") < 2, F.col("sents")).otherwise(chunks)))


def chunk_listed(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2048, listed: Callable[[Column], Column] = segments) -> DataFrame:
    """Paragraphs up to ``size`` characters stay whole; longer ones are parted by a model (``listed``), or stay whole where it gives no list."""
    rows = _paragraphs(df, key, text)
    answer = listed(F.when(F.length("para") > size, F.col("para")))
    return _renumbered(rows.withColumn("chunks", F.coalesce(F.when(F.length("para") > size, answer), F.array("para"))))


def size_routed(df: DataFrame, chunker: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text", drop: int = 200, whole: int = 1024) -> DataFrame:
    """Texts up to ``drop`` characters go, those below ``whole`` stay whole, the rest is chunked: the cheap filter comes before the model."""
    rows = df.where(F.length(text) > drop)
    short = rows.where(F.length(text) < whole).select(F.col(key).alias("doc_id"), F.lit(0).alias("chunk_no"), F.col(text).alias("chunk"))
    return short.unionByName(chunker(rows.where(F.length(text) >= whole)))


# ---- splitters ---------------------------------------------------------------------------------------------------------------


def chunk_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 128, overlap: int = 20) -> DataFrame:
    """Runs of so many white-space words with an overlap; the last run ends the text."""
    words = F.filter(F.split(F.col("text"), r"(?U)\s+"), lambda x: x != "")
    rows = _docs(df, key, text).withColumn("w", words).where(F.size("w") > 0)
    n = F.size("w")
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return _numbered(rows, F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, size), " ")))


def chunk_sentences(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1024, overlap: int = 0) -> DataFrame:
    """Whole sentences packed greedily up to so many characters; a longer sentence stands alone. A chunk begins with as many sentences
    of the one before it as the overlap and the size have room for."""
    rows = _docs(df, key, text).withColumn("s", T.sentences(F.col("text"))).where(F.size("s") > 0)
    s = F.col("s")
    run = lambda a, b: F.array_join(F.slice(s, a + 1, b - a + 1), " ")
    first = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))

    def step(acc: Column, i: Column) -> Column:
        last = F.element_at(acc, -1)
        back = F.lit(0)
        if overlap:
            # a sentence and the space after it take two characters at least
            near = F.sequence(F.lit(1), F.greatest(F.least(i - last["a"], F.lit(overlap // 2 + 1)), F.lit(1)))
            back = F.size(F.filter(near, lambda j: (j <= i - last["a"]) & (F.length(run(i - j, i - 1)) <= overlap) & (F.length(run(i - j, i)) <= size)))
        fits = F.length(run(last["a"], i)) <= size
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), i.alias("b"))))
        return F.when(fits, grown).otherwise(F.concat(acc, F.array(F.struct((i - back).alias("a"), i.alias("b")))))

    rest = F.when(F.size(s) > 1, F.sequence(F.lit(1), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
    return _numbered(rows, F.transform(F.aggregate(rest, first, step), lambda x: run(x["a"], x["b"])))


def recursive_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most ``size`` characters: split at the first separator that occurs, merged back up to the size with an overlap of whole
    parts, parts that are still too long split at the next separator."""
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :] if sep else ()
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run and (joined := sep.join(run).strip()):
            out.append(joined)

    for part in text.split(sep) if sep else list(text):
        if not part:
            continue
        if len(part) > size:
            flush()
            run.clear()
            out += recursive_pieces(part, size, overlap, rest or ("",))
            continue
        if run and len(sep.join([*run, part])) > size:
            flush()
            while run and (len(sep.join(run)) > overlap or len(sep.join([*run, part])) > size):
                run.pop(0)
        run.append(part)
    flush()
    return out


def chunk_recursive(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1024, overlap: int = 20) -> DataFrame:
    """The recursive character splitter over paragraphs, lines, words, characters."""
    rows = _docs(df, key, text)
    cut = F.pandas_udf(lambda s: pd.Series([recursive_pieces(t, size, overlap) for t in s], index=s.index, dtype=object), "array<string>")
    return _numbered(rows, cut(F.col("text")))


def longer_than(chunks: DataFrame, least: int = 100) -> DataFrame:
    """Chunks of more than so many characters; the others go, and the rest keep their numbers."""
    return chunks.where(F.length("chunk") > least)


def nodes(chunks: DataFrame) -> DataFrame:
    """Rows (node_id, doc_id, chunk_no, text): indexable nodes with ids that follow from their content."""
    node_id = F.sha2(F.concat_ws("\u0001", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string"), "chunk"), 256)
    return chunks.select(node_id.alias("node_id"), "doc_id", "chunk_no", F.col("chunk").alias("text"))


STRATEGIES = {
    "char": chunk_tokens, "sentence": chunk_sentences, "recursive": chunk_recursive, "semantic": chunk_semantic, "semantic_max": chunk_semantic_capped,
    "semantic_pairs": chunk_pairs, "chain": chunk_chain, "topic": chunk_topics, "combined": chunk_combined, "llm": chunk_listed,
}


def chunk(df: DataFrame, strategy: str = "semantic_pairs", **options) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy](df, **options)
