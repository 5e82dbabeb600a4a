"""Problem 10: keyword-stuffed pages, link lists and runs of product tags.

Stage 1 measures the compression ratio of fixed-size blocks of every text and normalises it by the usual ratio of the
text's length and language, taken from all texts.  Extreme redundancy flags a page.  Stage 2 confirms flagged pages by low
density of sentence punctuation: less than half of the text stands in sentences that are closed by an end mark and don't
say the same again.  Neither stage decides alone: lists and cards have few sentences but aren't redundant, and some plain
pages are redundant but made of sentences.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archiveloom.session import settle, spread

BLOCK = 480
#: A page is flagged when three tenths of it compress to less than this part of the usual ratio.
REDUNDANT = 0.84
#: A page of less than this share in sentences is confirmed.
PUNCTUATED = 0.5
#: Texts that the ratio of the next wider group counts for: a length's ratio leans on its language's, a language's on that of all.
PRIOR = 30
#: Words of a sentence; longer runs of letters than LONGEST are no words.
FEWEST, MOST, LONGEST = 5, 70, 40
#: Words around a sentence, and the share of different ones among them below which it says the same again.
WINDOW, VARIED = 40, 0.45

_URL = re.compile(r"(?:https?://|www\.)[^\s)\]>]+", re.I)
_LINK_LINE = re.compile(r"(?m)^[^\n.;!?]{0,60}(?:https?://|www\.)\S+[^\n.;!?]{0,10}$", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W_]+)*")
_DIGIT = re.compile(r"\d")
_END = re.compile(r"(?<=[.!?;…])[\"'»”)\]]*\s+|\n\s*\n|\n(?=\s*(?:[-*•–>#\[|]|\d+[.)]\s))")
#: What stands before an address in a bibliography is punctuated within; a link's label isn't.
_PUNCTUATED = re.compile(r"\w\s?[.;!?]\s+\w")
#: Characters before an address that can belong to its entry.
ENTRY = 100


def block_ratio(text: str) -> float:
    """Compression ratio (bytes after, with digits, links and their labels masked, by bytes before) of the block at the character-weighted
    three-tenths point: as much of the text as that is at least so redundant."""
    n = max(1, round(len(text) / BLOCK))
    step = -(-len(text) // n)
    seen = []
    for i in range(0, len(text), step):
        block = text[i : i + step]
        size = len(block.encode())
        block = block.lower()
        if "http" in block or "www." in block:
            block = _URL.sub("http://0", _LINK_LINE.sub("http://0", block))
        seen.append((len(zlib.compress(_DIGIT.sub("0", block).encode(), 6)) / size, size))
    seen.sort()
    part, so_far = sum(k for _, k in seen) * 0.3, 0
    for ratio, k in seen:
        so_far += k
        if so_far >= part:
            return ratio
    return 1.0


def length_bin(text: str) -> int:
    """Half powers of two of the length."""
    n = len(text)
    k = n.bit_length()
    return 2 * k + (n >> max(0, k - 2) & 1)


def sentence_share(text: str) -> float:
    """Share of the visible characters that stand in sentences: closed by an end mark, of FEWEST to MOST words, without a link in them,
    and neither made of phrases that come back within them nor set among the same few words. Punctuated entries with an address
    (a bibliography's) count as sentences."""
    visible = len("".join(text.split()))
    if not visible:
        return 0.0
    good = 0
    text = text.lower()
    if "http" in text or "www." in text:
        rest, start = [], 0
        for m in _URL.finditer(text):
            label = text[max(start, m.start() - ENTRY) : m.start()]
            label = label[max(label.rfind("["), label.rfind("\n\n"), 0) :]
            if _PUNCTUATED.search(label):
                good += len("".join(label.split())) + len(m.group())
                rest.append(text[start : m.start() - len(label)])
            else:
                rest.append(text[start : m.end()])
            start = m.end()
        text = "\n\n".join([*rest, text[start:]])
    units, words = [], []
    for unit in _END.split(text):
        own = [w for w in _WORD.findall(unit) if len(w) <= LONGEST]
        if own:
            units.append((len(words), unit, own))
            words += own
    n = len(words)
    for at, unit, own in units:
        k = len(own)
        if not FEWEST <= k <= MOST or unit.rstrip(" \"'»”)]*-–—_\n\t")[-1:] not in ".!?;:…" or _URL.search(unit):
            continue
        pairs = set(zip(own, own[1:]))
        if len(pairs) < k - 1 and sum(c for c in Counter(zip(own, own[1:])).values() if c > 1) > 0.15 * k:
            continue
        low = max(0, min(at + k // 2 - WINDOW // 2, n - WINDOW))
        near = words[low : low + WINDOW]
        if len(set(near)) / len(near) / (WINDOW / len(near)) ** 0.25 >= VARIED:  # fewer words repeat less
            good += len("".join(unit.split()))
    return good / visible


SCORES = "doc_id bigint, lang string, length_bin int, ratio double, sentence_share double"


def spam_scores(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", redundant: float = REDUNDANT, punctuated: float = PUNCTUATED) -> DataFrame:
    """Rows (doc_id, lang, length_bin, ratio, sentence_share, usual, redundancy, flagged, spam) for every text with visible characters.

    ``ratio`` is the block-wise compression ratio, ``usual`` what all texts of that language and length have, ``redundancy`` their
    quotient, ``sentence_share`` the share of the text in sentences. Null, empty and blank texts give no row; equal keys give
    one row each; a null language is a language of its own; other columns are ignored.
    """
    docs = spread(df.where(F.col(text).rlike(r"\S")).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("body"), F.coalesce(F.col(lang), F.lit("")).alias("lang")))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bodies = pdf["body"].tolist()
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "lang": pdf["lang"], "length_bin": [length_bin(t) for t in bodies],
                "ratio": [block_ratio(t) for t in bodies], "sentence_share": [sentence_share(t) for t in bodies],
            })

    scored = settle(docs.mapInPandas(measure, SCORES))
    # the usual ratio of the text's language and length; never less than that of its language at any length, lest a length at which
    # all texts are spam passes for usual
    middle = lambda p: F.percentile_approx("ratio", p, 1000)
    leaning = lambda own, n, wider: (own * n + wider * PRIOR) / (n + PRIOR)
    of_length = scored.groupBy("lang", "length_bin").agg(middle(0.6).alias("a"), F.count("*").alias("n_a"))
    of_lang = scored.groupBy("lang").agg(middle(0.5).alias("b"), F.count("*").alias("n_b"))
    overall = F.lit(scored.select(middle(0.5)).scalar())
    of_lang = of_lang.select("lang", leaning(F.col("b"), F.col("n_b"), overall).alias("b"))
    usual = of_length.join(of_lang, "lang").select("lang", "length_bin", F.greatest(leaning(F.col("a"), F.col("n_a"), F.col("b")), "b").alias("usual"))
    out = scored.join(F.broadcast(usual), ["lang", "length_bin"]).withColumn("redundancy", F.col("ratio") / F.col("usual"))
    return out.withColumn("flagged", F.col("redundancy") < redundant).withColumn("spam", F.col("flagged") & (F.col("sentence_share") < punctuated))
