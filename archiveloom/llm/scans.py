"""Problem 5: text from scanned pages, repaired into continuous paragraphs.

1. Words are counted over the whole corpus, page furniture (running headers, page numbers) aside and words broken over line ends joined.
2. Skip-gram vectors with negative sampling are learnt: those of the most frequent words, as contexts, from the counts of all their
   skip-gram pairs; those of any other word from its pairs with these contexts, by the same objective.
3. Rare words are linked to frequent ones that look the same when glyphs are reduced to strokes, by edits that scanning makes, if the frequent
   word's vector fits the contexts that the rare one stands in.
4. Each record is repaired with the corrections of its own words; of several, the one whose vector fits the words around it there.
   Then furniture goes and lines flow together.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archiveloom.llm.quality import known_words, line_kinds
from archiveloom.session import settle, spread

DIMENSIONS, WINDOW, SEED = 32, 2, 5
#: Most frequent words that are contexts, negative samples for each pair, and steps of the descent for contexts and for other words.
CONTEXTS, NEGATIVES, STEPS, WORD_STEPS = 1024, 5.0, 100, 60
#: A frequent word has at least this many times the occurrences of a rare one that is linked to it.
RATIO = 15
#: Least fit of a frequent word's vector to the contexts of a rare word: the mean logit of the pairs, which is about their pointwise mutual
#: information. What never stands in such contexts is far below.
FIT = -0.5
#: At most so many words can each stand for more than this fraction of all rows, which bounds what is broadcast.
HOT_WORDS = 10_000
#: Bits of the sieve for words that matter: so many for each of them, within bounds. More words only let more through.
SIEVE_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27

_DIGITS = r"[0-9OoIl]{0,3}[0-9][0-9OoIl]{0,3}"
_PAGE = rf"(?:\[\s*{_DIGITS}\s*\]|[-–—]\s*{_DIGITS}\s*[-–—]|{_DIGITS}\s*/\s*{_DIGITS}|(?:pages?|p\.|seite|s\.|página|pág\.|pagina|pag\.|стр\.?|страница)\s*{_DIGITS}(?:\s*/\s*{_DIGITS})?)"
_PAGE_LINE = re.compile(rf"\s*(?:{_PAGE}|\d{{1,4}})\s*", re.I)
_HEADER_LINE = re.compile(
    rf"\s*(?:{_PAGE}\s{{2,}})?(?P<head>[^\W\d_][\w'’.-]*(?: [\w'’.-]+){{0,7}})\s{{2,}}"
    rf"(?:(?:v[o0]l|n[o0]|nr|n°|núm|т|№)\.?\s*{_DIGITS}\w*|\d{{4}}|[-–—]\s*[^\W\d_][\w' -]{{2,30}}?)(?:\s{{2,}}{_PAGE})?\s*",
    re.I,
)
_SOME_DIGIT = re.compile(r"[0-9]")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_ATTRIBUTE = re.compile(r"\b[\w-]{1,40}=(?:\"[^\"\n]*\"|'[^'\n]*')")
_BREAK = re.compile(r"(?<![^\W_])(?P<left>[^\W_]+)(?P<mark>[-¬‐‑­])[ \t]*\n\s*(?P<right>[^\W_]+)")
_TOKEN = re.compile(r"[^\W_]+")
_COMPOUND = re.compile(r"(?<![^\W_])[^\W_]+(?:-[^\W_]+)+")
_MARKED = re.compile(r"\s*(?:[-–—•*·+>#|]|\d{1,3}[.)]\s|[a-z][.)]\s)")
_ENDED = re.compile(r"[.!?:;…][\"'»”)\]]*\s*$")


def is_furniture(line: str) -> bool:
    if len(line) > 300 or not line.strip() or not (_SOME_DIGIT.search(line) or "  " in line or "\t" in line):
        return False
    bare = _TAG.sub("", line) if "<" in line else line
    return bool(bare.strip()) and len(bare) <= 90 and bool(_PAGE_LINE.fullmatch(bare) or _HEADER_LINE.fullmatch(bare))


def without_furniture(text: str) -> tuple[str, int]:
    """The text without running headers and page numbers, and how many lines those were.

    A blank line or two beside a piece of furniture goes with it where the sentence before it hasn't ended.
    """
    lines = text.split("\n")
    looks = [is_furniture(x) for x in lines]
    if not any(looks):
        return text, 0
    worded = [len(_TOKEN.findall(x)) >= 3 for x in lines]
    flags = [x and (any(worded[max(0, i - 3) : i]) or any(worded[i + 1 : i + 4])) for i, x in enumerate(looks)]
    if not any(flags):
        return text, 0
    kept: list[str] = []
    skip_blank = False
    for line, out in zip(lines, flags):
        if out:
            while kept and not kept[-1].strip():
                kept.pop()
            skip_blank = bool(kept) and not _ENDED.search(kept[-1])
            if kept and not skip_blank:
                kept.append("")
            continue
        if not line.strip() and (skip_blank or kept and not kept[-1].strip()):
            continue
        skip_blank = False
        kept.append(line)
    return "\n".join(kept), sum(flags)


def joined(text: str) -> str:
    """Every word broken over a line end as one word (for counting; whether it was one is decided later)."""
    return _BREAK.sub(lambda m: m["left"] + m["right"] + "\n", text)


def prepared(text: str) -> str:
    """What the words are counted in."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "=" in text:
        text = _ATTRIBUTE.sub(" ", text)
    if "\n" in text:
        text = joined(without_furniture(text)[0])
    return text.lower()


# ---- words -------------------------------------------------------------------------------------------------------------------


def lexicon(rows: DataFrame) -> DataFrame:
    """Rows (word, n) over all of ``rows`` (body): every word and hyphened compound with its count."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for pdf in batches:
            for body in pdf["body"]:
                x = prepared(body)
                held.update(_TOKEN.findall(x))
                if "-" in x:
                    held.update(_COMPOUND.findall(x))
            if len(held) > 500_000:
                yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                held.clear()
        yield pd.DataFrame({"word": list(held), "n": list(held.values())}).astype({"word": object, "n": "int64"})

    return rows.mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# What scanning makes of glyphs (true, seen), Latin and Cyrillic.
MISREAD = {
    "o": ["0"], "l": ["1"], "i": ["l", "1"], "s": ["5"], "e": ["c"], "b": ["6", "8"], "g": ["9"], "n": ["ri"], "m": ["rn"], "rn": ["m"], "u": ["ii"], "h": ["li"],
    "d": ["cl"], "w": ["vv"], "о": ["0"], "н": ["п"], "и": ["u"], "т": ["m"], "б": ["6"], "з": ["3"], "ы": ["bl", "bi"],
}
# The same glyphs reduced to strokes, so that a word and what scanning makes of it have one key.
SAME_GLYPHS = ("0156896ijrtcонибзт", "olsbbgblllleoпub3m")
STROKES = (("ы", "bl"), ("w", "vv"), ("d", "el"), ("m", "lll"), ("n", "ll"), ("u", "ll"), ("h", "ll"))


def strokes(word: Column) -> Column:
    """A word with its glyphs reduced to strokes: equal for words that scanning could take for each other."""
    out = F.translate(word, *SAME_GLYPHS)
    for glyph, drawn in STROKES:
        out = F.replace(out, F.lit(glyph), F.lit(drawn))
    return out


def plausible(seen: str, true: str) -> bool:
    """Whether every difference is one that scanning makes."""
    reach = {(0, 0)}
    frontier = [(0, 0)]
    while frontier:
        i, j = frontier.pop()
        if (i, j) == (len(seen), len(true)):
            return True
        steps = [(1, 1)] if seen[i : i + 1] and seen[i : i + 1] == true[j : j + 1] else []
        for size in (1, 2):
            for form in MISREAD.get(true[j : j + size], ()):
                if len(true[j : j + size]) == size and seen.startswith(form, i):
                    steps.append((len(form), size))
        for di, dj in steps:
            if (at := (i + di, j + dj)) not in reach:
                reach.add(at)
                frontier.append(at)
    return False


def glyph_links(lex: DataFrame) -> DataFrame:
    """Rows (word, right, n, n_right): rare words beside the frequent words that scanning could have made them of."""
    long_enough = (F.length("word") >= 4) | ((F.length("word") == 3) & F.col("word").rlike("[0-9]"))
    plain = lex.where(long_enough & ~F.contains("word", F.lit("-")) & F.col("word").rlike(r"\p{L}.*\p{L}")).withColumn("key", strokes(F.col("word")))
    often = plain.where((F.col("n") >= RATIO) & F.col("word").rlike(r"^\p{L}+$")).select("key", F.col("word").alias("right"), F.col("n").alias("n_right"))
    pairs = plain.select("key", "word", "n").join(often, "key").where((F.col("word") != F.col("right")) & (F.col("n_right") >= RATIO * F.col("n")))
    likely = F.pandas_udf(lambda seen, true: pd.Series([plausible(x, y) for x, y in zip(seen, true)]), "boolean")
    return pairs.where(likely("word", "right")).select("word", "right", "n", "n_right")


# ---- skip-gram vectors -------------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _descend(found: list[np.ndarray], slopes: Callable, steps: int, rate: float) -> list[np.ndarray]:
    """Adaptive moment estimation: the parameters after so many full steps uphill."""
    first, second = [np.zeros_like(x) for x in found], [np.zeros_like(x) for x in found]
    for t in range(1, steps + 1):
        for i, g in enumerate(slopes(*found)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            found[i] = found[i] + rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return found


def context_vectors(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the contexts, and their shares as negative samples, from the counts of all pairs of them (contexts x contexts): skip-gram with
    negative sampling, its objective taken over the counts instead of pair by pair."""
    negative = pairs.sum(0) ** 0.75
    negative = negative / max(1e-12, negative.sum())
    n = pairs.sum(1, keepdims=True)
    share, weight = pairs / np.maximum(1, n), np.sqrt(n / max(1, n.max(initial=0)))

    def slopes(word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(word @ context.T)
        g = (share * (1 - p) - NEGATIVES * negative * p) * weight
        return g @ context, g.T @ word

    rng = np.random.default_rng(SEED)
    start = [rng.normal(0, 0.1, (len(pairs), DIMENSIONS)) for _ in range(2)]
    return _descend(start, slopes, STEPS, 0.05)[1], negative


def word_vectors(counts: np.ndarray, context: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Vectors of words from the counts of their pairs with the contexts (words x contexts), whose vectors stay as they are."""
    share = counts / np.maximum(1, counts.sum(1, keepdims=True))

    def slopes(word: np.ndarray) -> tuple[np.ndarray]:
        p = _sigmoid(word @ context.T)
        return ((share * (1 - p) - NEGATIVES * negative * p) @ context - 0.01 * word,)

    return _descend([np.zeros((len(counts), DIMENSIONS))], slopes, WORD_STEPS, 0.1)[0]


#: Bits of a count, below the number of its context in one whole number.
_COUNT_BITS = 40


def _counts(lists: pd.Series, size: int) -> np.ndarray:
    """Lists of contexts with their counts as rows of a matrix."""
    out = np.zeros((len(lists), size))
    for row, own in zip(out, lists):
        own = np.asarray(own, np.int64)
        row[own >> _COUNT_BITS] = own & ((1 << _COUNT_BITS) - 1)
    return out


# ---- repair ------------------------------------------------------------------------------------------------------------------


def _cased(model: str, word: str) -> str:
    if model.isupper() and len(model) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if model[:1].isupper() else word


def repaired(text: str, fixes: dict[str, str], known: set[str], prose: bool = True) -> tuple[str, int, int, int]:
    """The text in continuous paragraphs, with the number of broken words, misread words and pieces of furniture.

    ``fixes`` maps lower-case words to their corrections; ``known`` has the joined words and compounds of the text that the
    lexicon knows. A plain hyphen at a line end breaks a word if the joined word is known (or corrected) and the compound isn't.
    Where the text isn't ``prose`` (a list, a table) its lines stay as they are: a number alone may be an entry.
    """
    n_furniture = 0
    if prose:
        text, n_furniture = without_furniture(text)
    counts = [0, 0]

    def join(m: re.Match) -> str:
        left, right = m["left"], m["right"]
        whole, compound = (left + right).lower(), f"{left}-{right}".lower()
        if m["mark"] == "-":
            broken = len(left) > 1 and (whole in known or whole in fixes) and compound not in known
        else:
            broken = m["mark"] != "‑" or whole in known
        counts[0] += broken
        return f"{left}{right}" if broken else f"{left}-{right}" if prose else m.group()

    def fix(m: re.Match) -> str:
        word = m.group()
        right = fixes.get(word.lower())
        if right is None:
            return word
        counts[1] += 1
        return _cased(word, right)

    text = _BREAK.sub(join, text)
    if fixes:
        text = _TOKEN.sub(fix, text)
    if prose:
        text = _flowing(text)
        if counts[0] or n_furniture:
            text = re.sub(r"(?<=\S) {2,}", " ", text)
    return text, counts[0], counts[1], n_furniture


def _flowing(text: str) -> str:
    """Lines of one paragraph as one line; entries and rows keep theirs."""
    lines = text.split("\n")
    width = max((len(x) for x in lines), default=0)
    out: list[str] = []
    for line in lines:
        bare = line.strip()
        if out and out[-1] and bare and not _MARKED.match(line) and not _MARKED.match(out[-1]) and not re.search(r"\t|\s{3,}|\|", line) and len(out[-1].rsplit("\n", 1)[-1]) and (not _ENDED.search(out[-1]) or width <= 100):
            out[-1] = f"{out[-1]} {bare}"
        elif bare or out and out[-1]:
            out.append(bare if not _MARKED.match(line) else line.rstrip())
    return "\n".join(out)


# ---- the passes --------------------------------------------------------------------------------------------------------------


def _spots(word: Column, bits: int) -> Column:
    """The two places of a word in a sieve of so many bits."""
    return F.array(F.pmod(F.crc32(F.encode(word, "utf-8")), F.lit(bits)), F.pmod(F.crc32(F.encode(F.concat(word, F.lit("~")), "utf-8")), F.lit(bits)))


def sieve(words: DataFrame) -> tuple[int, np.ndarray]:
    """A Bloom filter of ``words`` (word): its bits, of a bounded number, packed."""
    n = words.count()
    bits = LEAST_BITS
    while bits < min(MOST_BITS, SIEVE_BITS * n):
        bits *= 2
    at = words.select(F.explode(F.transform(_spots(F.col("word"), bits), lambda h: h + 1)).alias("at")).select(F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("place"))
    packed = np.zeros(bits // 8, np.uint8)
    for r in at.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("map")).collect():  # a bucket is 32,768 bits
        start = (r["bucket"] - 1) * 4096  # buckets and their places are counted from number 1 on
        packed[start : start + 4096] = np.frombuffer(bytes(r["map"]), np.uint8)
    return bits, packed


def in_sieve(word: str, bits: int, packed: np.ndarray) -> bool:
    return all(packed[h >> 3] >> (h & 7) & 1 for h in (zlib.crc32(word.encode()) % bits, zlib.crc32((word + "~").encode()) % bits))


OBSERVED = "kind string, rec_no bigint, word string, at int, ctx int, m bigint, near array<int>"


def _observations(kind: str, **columns) -> pd.DataFrame:
    """Rows of OBSERVED of one kind, from the columns that it has."""
    n = len(next(iter(columns.values())))
    kinds = {"rec_no": "Int64", "word": object, "at": "Int32", "ctx": "Int32", "m": "Int64", "near": object}
    return pd.DataFrame({"kind": [kind] * n} | {c: pd.array(columns[c], dtype) if c in columns and dtype != object else columns.get(c, pd.Series([None] * n, dtype=dtype)) for c, dtype in kinds.items()})


def observed(texts: DataFrame, links: DataFrame, contexts: list[str]) -> DataFrame:
    """One pass over ``texts`` (rec_no, body). Rows of kind p: so many skip-gram pairs of two contexts; c: of a frequent word of ``links`` and a context; s: a
    rare one in a record, with the contexts beside it there; j: what a word broken over a line end may be, in a record."""
    size = len(contexts)
    sieves = [sieve(links.select(F.col(c).alias("word")).distinct()) for c in ("word", "right")]
    shared = texts.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(contexts)}, *sieves))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context, rare, frequent = shared.value
        # the words met so far: their numbers, and by number their context (-1 for none) and whether they are rare or frequent words of links
        number: dict[str, int] = {}
        names: list[str] = []
        marks = [array("q"), array("b"), array("b")]
        pairs = np.zeros(size * size)
        held_pairs: list[np.ndarray] = []

        def of_frequent() -> Iterator[pd.DataFrame]:
            key, m = np.unique(np.concatenate([*held_pairs, np.zeros(0, np.int64)]), return_counts=True)
            if len(key):
                yield _observations("c", word=[names[i] for i in (key // max(1, size)).tolist()], ctx=key % max(1, size), m=m)

        for pdf in batches:
            if len(number) > 500_000:
                number, names, marks = {}, [], [array("q"), array("b"), array("b")]
            ids: list[int] = []
            owners: list[int] = []
            broken: list[tuple] = []
            for row, (rec, body) in enumerate(zip(pdf["rec_no"], pdf["body"])):
                tokens = _TOKEN.findall(prepared(body))
                for t in set(tokens).difference(number):
                    number[t] = len(names)
                    names.append(t)
                    for mark, value in zip(marks, (context.get(t, -1), len(t) >= 3 and in_sieve(t, *rare), len(t) >= 3 and in_sieve(t, *frequent))):
                        mark.append(value)
                ids += map(number.__getitem__, tokens)
                ids += [-1] * WINDOW
                owners += [len(tokens) + WINDOW]
                if "\n" in body and _BREAK.search(body) and not pd.isna(rec):
                    broken += [(rec, w) for m in _BREAK.finditer(without_furniture(body)[0]) for w in ((m["left"] + m["right"]).lower(), f"{m['left']}-{m['right']}".lower())]
            # the words of the batch in one line, texts parted by gaps as wide as the window
            at = np.array(ids, np.int64)
            ctx, is_rare, is_frequent = (np.append(np.array(mark), none)[at] for mark, none in zip(marks, (-1, 0, 0)))
            beside: list[tuple[np.ndarray, np.ndarray]] = []
            for gap in range(1, WINDOW + 1):
                a, b = ctx[:-gap], ctx[gap:]
                both = (a >= 0) & (b >= 0)
                pairs += np.bincount(a[both] * size + b[both], minlength=size * size)
                for one, other in ((slice(None, -gap), slice(gap, None)), (slice(gap, None), slice(None, -gap))):
                    hit = np.flatnonzero((is_frequent[one] > 0) & (ctx[other] >= 0))
                    beside.append((at[one][hit], ctx[other][hit]))
            word, near = (np.concatenate(x) for x in zip(*beside))
            held_pairs.append(word * max(1, size) + near)
            if sum(map(len, held_pairs)) > 5_000_000 or len(number) > 500_000:
                yield from of_frequent()
                held_pairs.clear()
            spots = np.flatnonzero(is_rare > 0)
            recs = pdf["rec_no"].array[np.repeat(np.arange(len(owners)), owners)[spots]]
            seen: dict[tuple, list[int]] = {}
            for i, rec in zip(spots.tolist(), recs):
                if not pd.isna(rec):
                    around = ctx[max(0, i - WINDOW) : i].tolist() + ctx[i + 1 : i + 1 + WINDOW].tolist()
                    seen.setdefault((rec, names[at[i]]), []).extend(c for c in around if c >= 0)
            if seen:
                yield _observations("s", rec_no=[r for r, _ in seen], word=[w for _, w in seen], near=list(seen.values()))
            if broken:
                yield _observations("j", rec_no=[r for r, _ in broken], word=[w for _, w in broken])
        yield from of_frequent()
        held = pairs.reshape(size, size)
        held = held + held.T
        a, b = np.nonzero(held)
        if len(a):
            yield _observations("p", at=a, ctx=b, m=held[a, b].astype(np.int64))

    return texts.mapInPandas(look, OBSERVED)


def _by_word(rows: DataFrame, table: DataFrame, times: DataFrame) -> DataFrame:
    """``rows`` joined to ``table`` on word. Words that stand for more than a HOT_WORDS-th of the rows, by their ``times`` (word, n), are joined by a
    broadcast (there are HOT_WORDS at most), the others by a shuffle, in which no word is large."""
    bound = times.select(F.sum("n") / HOT_WORDS).first()[0] or 0.0
    hot = times.where(F.col("n") > bound).select("word").withColumn("hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), "word", "left")
    cold = marked.where("hot is null").drop("hot").join(table, "word")
    return cold.unionByName(marked.where("hot").drop("hot").join(F.broadcast(table.join(hot.select("word"), "word", "left_semi")), "word"))


def vectors(links: DataFrame, seen: DataFrame, contexts: int) -> tuple[DataFrame, np.ndarray]:
    """Rows (right, vec): the vectors of the frequent words of ``links``, and those of the contexts. ``seen`` are the rows of :func:`observed`."""
    pairs = np.zeros((contexts, contexts))
    held = seen.where("kind = 'p'").groupBy("at", "ctx").agg(F.sum("m").alias("m")).toArrow()  # a row for two contexts at most
    pairs[held["at"].to_numpy(), held["ctx"].to_numpy()] = held["m"].to_numpy()
    context, negative = context_vectors(pairs)
    shared = links.sparkSession.sparkContext.broadcast((context, negative))
    frequent = seen.where("kind = 'c'").join(links.select(F.col("right").alias("word")).distinct(), "word", "left_semi")
    # a list has an entry for each context at most
    held = frequent.groupBy("word", "ctx").agg(F.sum("m").alias("m")).groupBy("word").agg(F.collect_list(F.shiftleft(F.col("ctx").cast("bigint"), _COUNT_BITS).bitwiseOR(F.col("m"))).alias("ctxs"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context, negative = shared.value
        for pdf in batches:
            for first in range(0, len(pdf), 512):
                part = pdf.iloc[first : first + 512]
                yield pd.DataFrame({"right": part["word"], "vec": list(word_vectors(_counts(part["ctxs"], len(context)), context, negative))})

    return held.mapInPandas(learn, "right string, vec array<double>"), context


FITS = "rec_no bigint, word string, right string, n_right bigint, fit double, k int"


def fits(links: DataFrame, seen: DataFrame, contexts: int) -> DataFrame:
    """Rows (rec_no, word, right, n_right, fit, k): of each linked word in each record the sum of the logits of the frequent word's vector with the ``k`` contexts
    that stand beside it there (about their pointwise mutual information)."""
    learnt, context = vectors(links, seen, contexts)
    shared = links.sparkSession.sparkContext.broadcast(context)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = shared.value
        for pdf in batches:
            there = [0 if near is None or vec is None else len(near) for near, vec in zip(pdf["near"], pdf["vec"])]
            logits = [float((context[np.asarray(near, int)] @ np.asarray(vec)).sum()) + k * np.log(NEGATIVES) if k else 0.0 for near, vec, k in zip(pdf["near"], pdf["vec"], there)]
            yield pdf[["rec_no", "word", "right", "n_right"]].assign(fit=logits, k=np.array(there, np.int32))

    stand = seen.where("kind = 's'").select("rec_no", "word", "near")
    rows = _by_word(stand, links.join(learnt, "right", "left").select("word", "right", "n_right", "vec"), stand.groupBy("word").agg(F.count("*").alias("n")))
    return rows.mapInPandas(fit, FITS)


def corrections(fitted: DataFrame, least_fit: float = FIT) -> DataFrame:
    """Rows (rec_no, word, right): the corrected words of each record, of rows of :func:`fits`.

    Each record takes, of the frequent words linked to a rare one, that which fits best there. A link stands if the frequent word fits the contexts of all records that
    took it, on average; without any context it stands by its looks. A word that is corrected itself is no one's correction.
    """
    times = settle(fitted.groupBy("word").agg(F.count("*").alias("n")))

    def standing(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        took = rows.groupBy("rec_no", "word").agg(F.max_by(F.struct("right", "fit", "k"), F.struct("fit", "n_right", "right")).alias("b")).select("rec_no", "word", "b.*")
        pooled = took.groupBy("word", "right").agg(F.sum("fit").alias("fit"), F.sum("k").alias("k"))
        return took, pooled.where((F.col("k") == 0) | (F.col("fit") >= least_fit * F.col("k"))).select("word", F.col("right").alias("stands"))

    wrong = settle(standing(fitted)[1].select(F.col("word").alias("right")).distinct())
    # few links are left out, so this is looked up like the links themselves
    took, stands = standing(settle(fitted.join(wrong, "right", "left_anti")))
    return _by_word(took, settle(stands), times).where("right = stands").select("rec_no", "word", "right")


REPAIRED = "rec_no bigint, repaired_text string, n_broken int, n_misread int, n_furniture int, junk boolean"


def repair_scans(df: DataFrame, words: DataFrame, key: str = "rec_no", text: str = "content", least_fit: float = FIT) -> DataFrame:
    """One row per row of ``df``: the repaired text and what was repaired.

    Null stays null and empty stays empty, with zero counts. Junk (most of the characters, line by line as in problem 6) that would be
    changed isn't, and is marked; in lists and tables words are repaired and lines stay. Rows of a repeated key are
    repaired each by itself, with the corrections of all of them; rows with a null key come out with furniture and marked
    breaks repaired only. Other columns are ignored. ``words`` (word) is the fixed table of common words.
    """
    common = known_words(words)
    rows = spread(df.select(F.col(key).cast("bigint").alias("rec_no"), F.col(text).alias("body")))
    texts = rows.where(F.col("body").rlike(r"\p{L}"))
    lex = settle(lexicon(texts.select("body")))
    links = settle(glyph_links(lex))
    contexts = [r["word"] for r in lex.where(~F.contains("word", F.lit("-"))).orderBy(F.desc("n"), "word").limit(CONTEXTS).collect()]
    seen = settle(observed(texts, links, contexts))
    chosen = corrections(settle(fits(links, seen, len(contexts))), least_fit)
    broken = seen.where("kind = 'j'").select("rec_no", "word").distinct()
    times = settle(broken.groupBy("word").agg(F.count("*").alias("n")))
    joins = _by_word(broken, times.select("word").join(lex.where("n >= 3").select("word"), "word", "left_semi"), times)
    by_record = (
        chosen.select("rec_no", F.struct("word", "right").alias("fix"), F.lit(None).cast("string").alias("join"))
        .unionByName(joins.select("rec_no", F.lit(None).cast("struct<word:string,right:string>").alias("fix"), F.col("word").alias("join")))
        .groupBy("rec_no").agg(F.collect_list("fix").alias("fixes"), F.collect_set("join").alias("joins"))  # no more than the words of one record
    )

    def mend(body: str | None, own: dict[str, str], known: set[str]) -> tuple:
        if not body or "\n" not in body and not own:
            return body, 0, 0, 0, False
        out = repaired(body, own, known)
        if out == (body, 0, 0, 0):
            return *out, False
        total, _ = line_kinds(body, common)
        half = 0.5 * sum(total.values())
        if total["junk"] > half:
            return body, 0, 0, 0, True
        return *(out if total["prose"] > half else repaired(body, own, known, prose=False)), False

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["repaired_text", "n_broken", "n_misread", "n_furniture", "junk"]
        for pdf in batches:
            out = []
            for body, fixes, joins in zip(pdf["body"], pdf["fixes"], pdf["joins"]):
                out.append(mend(body, {} if fixes is None else {f["word"]: f["right"] for f in fixes}, set() if joins is None else set(joins)))
            made = pd.DataFrame(out, columns=names).astype({"n_broken": "int32", "n_misread": "int32", "n_furniture": "int32"})
            made.insert(0, "rec_no", pdf["rec_no"].array)
            yield made

    nothing = [F.lit(None).cast("array<struct<word:string,right:string>>").alias("fixes"), F.lit(None).cast("array<string>").alias("joins")]
    whole = rows.where("rec_no is not null").join(by_record, "rec_no", "left").select("rec_no", "body", "fixes", "joins").unionByName(rows.where("rec_no is null").select("rec_no", "body", *nothing))
    return whole.mapInPandas(repair, REPAIRED)
