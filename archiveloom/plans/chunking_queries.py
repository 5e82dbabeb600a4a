"""Queries of the chunking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from archiveloom.operators import chunking as C
from archiveloom.operators import providers as P
from archiveloom.operators import topics
from archiveloom.plans.registry import query, table
from archiveloom.plans.text_queries import MARKED_SENTS, SENTS, SENTS3, SPACE, STRIP, WIKI, docs, stop_words, wiki_text


def _distances_sql(pairs: bool, sents: str | None = None) -> str:
    """Common tables up to ``dist`` (doc_id, i, d): the distance of sentence i (from 1) to the next, by hashed word vectors. ``sents`` may give other
    rows (doc_id, text, s)."""
    sents = sents or f"SELECT doc_id, text, {SENTS3 if pairs else SENTS} AS s FROM documents WHERE text IS NOT NULL AND text <> ''"
    if pairs:
        sides = """SELECT doc_id, i, 'l' AS side, array_to_string(list_slice(s, greatest(i - 1, 1), i), '. ') || '. ' AS w FROM idx WHERE i < n
            UNION ALL SELECT doc_id, i - 1 AS i, 'r' AS side, array_to_string(list_slice(s, i, least(i + 1, n)), '. ') || '. ' AS w FROM idx WHERE i > 1"""
    else:
        sides = """SELECT doc_id, i, 'l' AS side, array_to_string(list_slice(s, greatest(i - 1, 1), least(i + 1, n)), ' ') AS w FROM idx WHERE i < n
            UNION ALL SELECT doc_id, i - 1 AS i, 'r' AS side, array_to_string(list_slice(s, greatest(i - 1, 1), least(i + 1, n)), ' ') AS w FROM idx WHERE i > 1"""
    return rf"""
WITH RECURSIVE sents AS ({sents}),
idx AS (SELECT doc_id, s, len(s) AS n, unnest(range(1, len(s) + 1)) AS i FROM sents),
sides AS ({sides}),
words AS (SELECT doc_id, i, side, ('0x' || substr(md5(t), 1, 4))::INT AS h FROM (SELECT doc_id, i, side, unnest(regexp_extract_all(lower(w), '[\p{{L}}\p{{N}}]+')) AS t FROM sides)),
vecs AS (SELECT doc_id, i, side, h % 64 AS dim, sum(1 - 2 * ((h // 64) % 2))::BIGINT AS v FROM words GROUP BY ALL),
norms AS (SELECT doc_id, i, side, sum(v * v)::DOUBLE AS q FROM vecs GROUP BY ALL),
dots AS (SELECT a.doc_id, a.i, sum(a.v * b.v)::DOUBLE AS dot FROM vecs a JOIN vecs b ON a.doc_id = b.doc_id AND a.i = b.i AND a.dim = b.dim AND a.side = 'l' AND b.side = 'r' GROUP BY ALL),
dist AS (
    SELECT idx.doc_id, idx.i, 1 - CASE WHEN coalesce(l.q, 0) * coalesce(r.q, 0) > 0 THEN coalesce(dots.dot, 0) / sqrt(l.q * r.q) ELSE 0 END AS d
    FROM idx LEFT JOIN norms l ON l.doc_id = idx.doc_id AND l.i = idx.i AND l.side = 'l' LEFT JOIN norms r ON r.doc_id = idx.doc_id AND r.i = idx.i AND r.side = 'r'
    LEFT JOIN dots ON dots.doc_id = idx.doc_id AND dots.i = idx.i WHERE idx.i < idx.n
)"""


def _breaks_sql(pairs: bool, p: float, sents: str | None = None) -> str:
    """Further tables up to ``brk`` (doc_id, s, d, b): break positions (from 0) above the percentile."""
    return (
        _distances_sql(pairs, sents)
        + f""", arr AS (SELECT doc_id, list(d ORDER BY i) AS d, list_sort(list(d)) AS o FROM dist GROUP BY doc_id),
thr AS (SELECT doc_id, d, o[low + 1] + (coalesce(o[low + 2], o[low + 1]) - o[low + 1]) * (q - low) AS t FROM (SELECT *, (len(d) - 1) * ({p} / 100.0)::DOUBLE AS q, floor((len(d) - 1) * ({p} / 100.0)::DOUBLE)::BIGINT AS low FROM arr)),
brk AS (SELECT doc_id, d, list_filter(range(len(d)), lambda i: d[i + 1] > t) AS b FROM thr)"""
    )


def _fold_sql(joint: str, end: str, falling: bool, merge_tail: bool, least: int) -> str:
    """The fold over ``sents`` (doc_id, text, s) and ``brk`` (doc_id, d, b)."""
    tail = "CASE WHEN len(tl) < 100 AND len(chunks) > 0 THEN list_append(chunks[:len(chunks) - 1], chunks[len(chunks)] || tl) ELSE list_append(chunks, tl) END" if merge_tail else "list_append(chunks, tl)"
    piece = f"array_to_string(list_slice(s.s, f.start + 1, b.b[f.k + 1] + 1), '{joint}') || '{end}'"
    return f""", fold AS (
    SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS start, []::VARCHAR[] AS chunks FROM brk
    UNION ALL
    SELECT doc_id, k + 1, CASE WHEN NOT short OR glue THEN cut + 1 ELSE start END,
        CASE WHEN NOT short THEN list_append(chunks, t) WHEN glue THEN list_append(chunks[:len(chunks) - 1], chunks[len(chunks)] || t) ELSE chunks END
    FROM (
        SELECT f.doc_id, f.k, f.start, f.chunks, b.b[f.k + 1] AS cut, {piece} AS t, len({piece}) < 100 AS short,
            len({piece}) < 100 AND len(f.chunks) > 0 AND coalesce(b.d[f.start] {">" if falling else "<"} b.d[b.b[f.k + 1] + 1], false) AS glue
        FROM fold f JOIN brk b USING (doc_id) JOIN sents s USING (doc_id) WHERE f.k < len(b.b)
    )
), ended AS (
    SELECT f.doc_id, CASE WHEN f.start < len(s.s) THEN {tail} ELSE chunks END AS chunks
    FROM (SELECT f.*, array_to_string(list_slice(s.s, f.start + 1, len(s.s)), '{joint}') AS tl FROM fold f JOIN brk b USING (doc_id) JOIN sents s USING (doc_id) WHERE f.k = len(b.b) AND len(s.s) >= {least}) f JOIN sents s USING (doc_id)
    UNION ALL SELECT doc_id, [text] AS chunks FROM sents WHERE len(s) < {least}
)"""


#: What is shown of the chunks in ``ended``.
ENDED = " SELECT doc_id, unnest(range(len(chunks))) AS chunk_no, len(unnest(chunks)) AS n_chars, md5(unnest(chunks)) AS digest FROM ended"


def _chunks_sql(pairs: bool, p: float) -> str:
    return _breaks_sql(pairs, p) + (_fold_sql(". ", ". ", False, True, 2) if pairs else _fold_sql(" ", "", False, False, 2)) + ENDED


TOPIC_CHUNKS = (
    rf"""
WITH RECURSIVE stops AS (SELECT list(DISTINCT word) AS stops FROM common_words),
sents AS (SELECT doc_id, text, {SENTS3} AS s FROM documents WHERE text IS NOT NULL AND text <> ''),
idx AS (SELECT doc_id, len(s) AS n, unnest(range(len(s))) AS i, unnest(s) AS sentence FROM sents),
words AS (SELECT doc_id, i, unnest(list_filter(regexp_extract_all(lower(sentence), '[\p{{L}}]+'), lambda w: len(w) >= 3 AND NOT list_contains(stops, w))) AS w FROM idx, stops),
counted AS (SELECT doc_id, i, ('0x' || substr(md5(w), 1, 4))::INT % 16 AS k, count(*) AS c FROM words GROUP BY ALL),
foremost AS (SELECT doc_id, i, k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY c DESC, k) AS nth FROM counted) WHERE nth <= 3),
members AS (SELECT DISTINCT idx.doc_id, idx.i, l.k FROM idx JOIN foremost l ON l.doc_id = idx.doc_id AND l.i BETWEEN idx.i AND CASE WHEN idx.i < idx.n - 2 THEN idx.i + 2 ELSE idx.i END),
sizes AS (SELECT doc_id, i, count(*)::DOUBLE AS q FROM members GROUP BY ALL),
shared AS (SELECT a.doc_id, a.i, count(*)::DOUBLE AS x FROM members a JOIN members b ON a.doc_id = b.doc_id AND b.i = a.i + 1 AND a.k = b.k GROUP BY ALL),
coherent AS (
    SELECT idx.doc_id, idx.i, CASE WHEN a.q > 0 AND b.q > 0 THEN coalesce(x, 0) / sqrt(a.q * b.q) ELSE 0 END AS c FROM idx LEFT JOIN sizes a ON a.doc_id = idx.doc_id AND a.i = idx.i
    LEFT JOIN sizes b ON b.doc_id = idx.doc_id AND b.i = idx.i + 1 LEFT JOIN shared ON shared.doc_id = idx.doc_id AND shared.i = idx.i WHERE idx.i < idx.n - 1
),
brk AS (SELECT doc_id, d, list_filter(range(len(d)), lambda i: d[i + 1] < 0.5) AS b FROM (SELECT doc_id, list(c ORDER BY i) AS d FROM coherent GROUP BY doc_id))"""
    + _fold_sql(". ", ". ", True, True, 3)
    + ENDED
)


def _report(chunks):
    return chunks.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.length("chunk").cast("bigint").alias("n_chars"), F.md5("chunk").alias("digest"))


def _summed(rows):
    d = F.col("d")
    total = F.aggregate(d, F.lit(0.0), lambda s, x: s + x)
    return rows.where(F.size("d") > 0).select("doc_id", F.size("d").cast("bigint").alias("n"), F.round(total, 6).alias("total"), F.round(F.array_max("d"), 6).alias("largest"))


SUMMED = " SELECT doc_id, count(*) AS n, round(sum(d), 6) AS total, round(max(d), 6) AS largest FROM dist GROUP BY doc_id"


@query(_distances_sql(False) + SUMMED)
def cosine_consecutive(spark, folder):
    return _summed(C.semantic_distances(docs(spark, folder)))


@query(_distances_sql(True) + SUMMED)
def cosine_pairs(spark, folder):
    return _summed(C.semantic_distances(docs(spark, folder), pairs=True))


def _breaks(rows, threshold):
    return rows.select("doc_id", F.explode(C.breaks_above(F.col("d"), threshold)).alias("break_at")).withColumn("break_at", F.col("break_at").cast("bigint"))


@query(_breaks_sql(False, 90) + " SELECT doc_id, unnest(b) AS break_at FROM brk")
def breakpoints_p90(spark, folder):
    return _breaks(C.semantic_distances(docs(spark, folder)), C.percentile(F.col("d"), 90))


@query(_breaks_sql(False, 95) + " SELECT doc_id, unnest(b) AS break_at FROM brk")
def breakpoints_p95(spark, folder):
    return _breaks(C.semantic_distances(docs(spark, folder)), C.percentile(F.col("d"), 95))


@query(_distances_sql(False) + " SELECT doc_id, i - 1 AS break_at FROM dist WHERE d > 0.3")
def breakpoints_absolute(spark, folder):
    return _breaks(C.semantic_distances(docs(spark, folder)), F.lit(0.3))


@query(_chunks_sql(False, 95))
def chunks_semantic(spark, folder):
    return _report(C.chunk_semantic(docs(spark, folder)))


@query(_chunks_sql(True, 90))
def chunks_pairs(spark, folder):
    return _report(C.chunk_pairs(docs(spark, folder)))


@query(f"SELECT * FROM ({_chunks_sql(False, 95)}) WHERE n_chars > 100")
def chunks_semantic_filtered(spark, folder):
    """The semantic strategy with its filter of short chunks."""
    return _report(C.longer_than(C.chunk_semantic(docs(spark, folder))))


#: The semantic strategy up to its last group, which is cut after its greatest distance (the last one aside) until its parts have 1,024 characters or two distances.
CAPPED_CHUNKS = (
    _breaks_sql(False, 90)
    + _fold_sql(" ", "", False, False, 2)
    + """, tails AS (SELECT f.doc_id, f.start AS a, len(s.s)::BIGINT AS b FROM fold f JOIN brk k USING (doc_id) JOIN sents s USING (doc_id) WHERE f.k = len(k.b) AND len(s.s) >= 2 AND f.start < len(s.s)),
parts AS (
    SELECT doc_id, a, b, false AS done FROM tails
    UNION ALL
    SELECT doc_id, unnest(CASE WHEN whole THEN [a] ELSE [a, cut] END) AS a, unnest(CASE WHEN whole THEN [b] ELSE [cut, b] END) AS b, whole AS done FROM (
        SELECT *, a + list_position(inner_, list_max(inner_)) AS cut FROM (
            SELECT p.doc_id, p.a, p.b, len(array_to_string(list_slice(s.s, p.a + 1, p.b), ' ')) <= 1024 OR p.b - 1 - p.a < 2 AS whole, list_slice(k.d, p.a + 1, p.b - 2) AS inner_
            FROM parts p JOIN sents s USING (doc_id) JOIN brk k USING (doc_id) WHERE NOT p.done))
), capped AS (
    SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM tails t WHERE t.doc_id = e.doc_id) THEN chunks[:len(chunks) - 1] ELSE chunks END AS chunks FROM ended e
), every AS (
    SELECT doc_id, 0 AS late, unnest(range(len(chunks)))::BIGINT AS pos, unnest(chunks) AS c FROM capped
    UNION ALL SELECT p.doc_id, 1, p.a, array_to_string(list_slice(s.s, p.a + 1, p.b), ' ') FROM parts p JOIN sents s USING (doc_id) WHERE p.done
)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY late, pos) - 1 AS chunk_no, len(c) AS n_chars, md5(c) AS digest FROM every"""
)


@query(CAPPED_CHUNKS)
def chunks_semantic_max(spark, folder):
    return _report(C.chunk_semantic_capped(docs(spark, folder)))


CHAINED_CHUNKS = rf"""
WITH RECURSIVE sents AS (SELECT doc_id, text, {SENTS3} AS s FROM documents WHERE text IS NOT NULL AND text <> ''),
idx AS (SELECT doc_id, len(s) AS n, unnest(range(len(s))) AS i, unnest(s) AS sentence FROM sents WHERE len(s) >= 2),
words AS (SELECT doc_id, i, ('0x' || substr(md5(t), 1, 4))::INT AS h FROM (SELECT doc_id, i, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}]+')) AS t FROM idx)),
sums AS (SELECT doc_id, i, h % 64 AS dim, sum(1 - 2 * ((h // 64) % 2))::BIGINT AS v FROM words GROUP BY ALL),
own AS (SELECT idx.doc_id, idx.i, any_value(idx.n) AS n, list(coalesce(v, 0) ORDER BY dims.dim) AS v FROM idx CROSS JOIN (SELECT unnest(range(64)) AS dim) dims LEFT JOIN sums ON sums.doc_id = idx.doc_id AND sums.i = idx.i AND sums.dim = dims.dim GROUP BY idx.doc_id, idx.i),
ahead AS (SELECT a.doc_id, a.i, CASE WHEN b.v IS NULL THEN a.v ELSE list_transform(range(1, 65), lambda x: a.v[x] + b.v[x]) END AS v FROM own a LEFT JOIN own b ON b.doc_id = a.doc_id AND b.i = a.i + 1),
step AS (SELECT o.doc_id, o.i, o.n, o.v AS own, a.v AS next FROM own o JOIN ahead a ON a.doc_id = o.doc_id AND a.i = o.i + 1),
fold AS (
    SELECT DISTINCT doc_id, 0::BIGINT AS i, 0::BIGINT AS start, list_transform(range(64), lambda x: 0::BIGINT) AS so_far, NULL::DOUBLE AS last_gap, []::VARCHAR[] AS chunks FROM idx
    UNION ALL
    SELECT doc_id, i + 1, CASE WHEN cut THEN i + 1 ELSE start END, CASE WHEN cut THEN list_transform(range(64), lambda x: 0::BIGINT) ELSE so_far END, gap,
        CASE WHEN cut AND NOT short THEN list_append(chunks, t) WHEN cut THEN list_append(chunks[:len(chunks) - 1], chunks[len(chunks)] || t) ELSE chunks END
    FROM (
        SELECT *, gap > 0.3 AND (NOT short OR (len(chunks) > 0 AND i > 0 AND last_gap < gap)) AS cut FROM (
            SELECT m.*, len(t) < 100 AS short, 1 - CASE WHEN q > 0 THEN dot / sqrt(q) ELSE 0 END AS gap FROM (
                SELECT doc_id, i, start, last_gap, chunks, so_far, array_to_string(list_slice(sent, start + 1, i + 1), '. ') || '. ' AS t,
                    list_sum(list_transform(range(1, 65), lambda x: so_far[x] * next[x]))::DOUBLE AS dot,
                    list_sum(list_transform(so_far, lambda x: x * x))::DOUBLE * list_sum(list_transform(next, lambda x: x * x))::DOUBLE AS q
                FROM (SELECT f.doc_id, f.i, f.start, f.last_gap, f.chunks, s.s AS sent, k.next, list_transform(range(1, 65), lambda x: f.so_far[x] + k.own[x]) AS so_far
                    FROM fold f JOIN step k USING (doc_id, i) JOIN sents s USING (doc_id))) m))
), ended AS (
    SELECT doc_id, CASE WHEN len(t) < 100 AND len(chunks) > 0 THEN list_append(chunks[:len(chunks) - 1], chunks[len(chunks)] || t) ELSE list_append(chunks, t) END AS chunks
    FROM (SELECT f.doc_id, f.chunks, array_to_string(list_slice(s.s, f.start + 1, len(s.s)), '. ') || '. ' AS t FROM fold f JOIN sents s USING (doc_id) WHERE f.i = len(s.s) - 1)
    UNION ALL SELECT doc_id, [text] AS chunks FROM sents WHERE len(s) < 2
)"""


@query(CHAINED_CHUNKS + ENDED)
def chunks_chain(spark, folder):
    return _report(C.chunk_chain(docs(spark, folder)))


@query(TOPIC_CHUNKS)
def chunks_topic(spark, folder):
    return _report(C.chunk_topics(docs(spark, folder), stop=stop_words(spark, folder)))


@query()
def chunks_lda(spark, folder):
    """The topic strategy with the topics of a topic model."""
    rows, stop = docs(spark, folder), stop_words(spark, folder)
    return _report(C.chunk_topics(rows, assigned=topics.run_topics(rows, "doc_id", "text", stop)))


TOKENS = rf"list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> '')"
TOKEN_CHUNKS = f"""SELECT doc_id, list_transform(range(0, greatest(len(w) - 21, 0) + 1, 108), lambda i: array_to_string(list_slice(w, i + 1, i + 128), ' ')) AS c
    FROM (SELECT doc_id, {TOKENS} AS w FROM documents WHERE text IS NOT NULL AND text <> '') WHERE len(w) > 0"""


@query(f"SELECT doc_id, unnest(range(len(c))) AS chunk_no, len(unnest(c)) AS n_chars, md5(unnest(c)) AS digest FROM ({TOKEN_CHUNKS})")
def chunks_token(spark, folder):
    return _report(C.chunk_tokens(docs(spark, folder)))


@query(
    rf"""
WITH RECURSIVE s AS (SELECT doc_id, {MARKED_SENTS} AS s FROM documents WHERE text IS NOT NULL AND text <> ''),
fold AS (
    SELECT doc_id, 1::BIGINT AS k, 0::BIGINT AS chunk_no, s[1] AS c FROM s WHERE len(s) > 0
    UNION ALL
    SELECT f.doc_id, f.k + 1, CASE WHEN len(f.c) + 1 + len(s.s[f.k + 1]) <= 1024 THEN f.chunk_no ELSE f.chunk_no + 1 END,
        CASE WHEN len(f.c) + 1 + len(s.s[f.k + 1]) <= 1024 THEN f.c || ' ' || s.s[f.k + 1] ELSE s.s[f.k + 1] END
    FROM fold f JOIN s USING (doc_id) WHERE f.k < len(s.s)
)
SELECT doc_id, chunk_no, len(c) AS n_chars, md5(c) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_no ORDER BY k DESC) AS nth FROM fold) WHERE nth = 1"""
)
def chunks_sentence(spark, folder):
    return _report(C.chunk_sentences(docs(spark, folder)))


@query()
def chunks_recursive(spark, folder):
    return _report(C.chunk_recursive(docs(spark, folder)))


@query(
    f"""
SELECT doc_id, 0::BIGINT AS chunk_no, len(text) AS n_chars, md5(text) AS digest FROM documents WHERE len(text) > 200 AND len(text) < 1024
UNION ALL SELECT doc_id, unnest(range(len(c))) AS chunk_no, len(unnest(c)) AS n_chars, md5(unnest(c)) AS digest FROM ({TOKEN_CHUNKS.replace("text <> ''", "len(text) >= 1024")})"""
)
def size_routing(spark, folder):
    return _report(C.size_routed(docs(spark, folder), C.chunk_tokens))


@query(f"SELECT sha256(doc_id::VARCHAR || chr(1) || k::VARCHAR || chr(1) || t) AS node_id, doc_id, k AS chunk_no, len(t) AS n_chars FROM (SELECT doc_id, unnest(range(len(c))) AS k, unnest(c) AS t FROM ({TOKEN_CHUNKS}))")
def nodes_from_chunks(spark, folder):
    made = C.nodes(C.chunk_tokens(docs(spark, folder)))
    return made.select("node_id", "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.length("text").cast("bigint").alias("n_chars"))


PARAS = f"SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS para FROM (SELECT doc_id, string_split(replace({WIKI}, '= ' || chr(10), ' : '), chr(10) || ' =') AS p FROM documents WHERE text IS NOT NULL AND text <> '')"


def _by_paragraph(spark, folder):
    return docs(spark, folder).select("doc_id", wiki_text().alias("text"))


def _listed(make):
    return lambda text: make(text, loader=lambda: P.listing)


@query(
    _breaks_sql(False, 95, f"SELECT doc_id || '/' || pos AS doc_id, s[1] AS text, s FROM (SELECT doc_id, pos, CASE WHEN len(para) > 300 THEN {MARKED_SENTS.replace('text', 'para')} ELSE [para] END AS s FROM ({PARAS}))")
    + _fold_sql(" ", "", False, False, 2)
    + """, parts AS (SELECT split_part(doc_id, '/', 1)::BIGINT AS doc_id, split_part(doc_id, '/', 2)::BIGINT AS pos, unnest(range(len(chunks))) AS within, unnest(chunks) AS c FROM ended)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, within) - 1 AS chunk_no, len(c) AS n_chars, md5(c) AS digest FROM parts"""
)
def chunks_combined(spark, folder):
    """Long paragraphs as the statements of a model (here a stand-in that lists their sentences), then semantic chunking of these."""
    return _report(C.chunk_combined(_by_paragraph(spark, folder), size=300, listed=_listed(P.propositions)))


@query(
    f"""WITH parts AS (SELECT doc_id, pos, unnest(range(len(s))) AS within, unnest(s) AS c FROM (SELECT doc_id, pos, CASE WHEN len(para) > 300 THEN {MARKED_SENTS.replace('text', 'para')} ELSE [para] END AS s FROM ({PARAS})))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, within) - 1 AS chunk_no, len(c) AS n_chars, md5(c) AS digest FROM parts"""
)
def chunks_llm(spark, folder):
    """Long paragraphs parted by a model (here a stand-in that lists their sentences)."""
    return _report(C.chunk(_by_paragraph(spark, folder), "llm", size=300, listed=_listed(P.segments)))


@query(
    rf'''
WITH l AS (SELECT qid AS source_id, list_transform(string_split('1. ' || text, chr(10)), lambda x: regexp_replace(x, {STRIP})) AS l FROM qa_queries WHERE text IS NOT NULL),
q AS (SELECT source_id, list_filter(list_transform(list_filter(l, lambda x: x LIKE '%?'), lambda x: regexp_replace(regexp_replace(x, '^\d+[).\s]', ''), {STRIP})), lambda x: x <> '')[:2] AS q FROM l),
n AS (SELECT source_id, unnest(range(len(q))) AS nth, unnest(q) AS question FROM q)
SELECT md5(source_id || chr(1) || nth::VARCHAR || chr(1) || question) AS qid, source_id, question FROM n'''
)
def generated_questions(spark, folder):
    asked = table(spark, folder, "qa_queries").where("text is not null").select("qid", F.concat(F.lit("1. "), F.col("text")).alias("text"))
    return P.questions(asked.withColumnRenamed("qid", "source_id"), "source_id", "text")


@query(
    rf'''
WITH l AS (SELECT doc_id, string_split(regexp_replace(string_split(text, ':' || chr(10))[-1], {STRIP}), chr(10)) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, list_filter(list_transform(l, lambda x: regexp_replace(regexp_replace(x, '^\d+[).\s]', ''), {STRIP})), lambda x: x <> '')[1] AS topic FROM l'''
)
def topic_tags(spark, folder):
    return docs(spark, folder).select("doc_id", P.topic_tag(F.col("text")).alias("topic"))
