"""Problem 1: the language of each record, and of each stretch of a mixed one, with a confidence value.

Rank-order profiles: the n-grams of known texts are ranked per language; a sentence's own ranked n-grams are held against
each profile by the sum of out-of-place distances, and the nearest profile names the language.  Sentences of one record are
measured together in numpy, word by distinct word, so the cost is linear in the text.
"""

from __future__ import annotations

import html
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archiveloom.session import spread

LONGEST_GRAM = 4
PROFILE_SIZE = 800
#: Beyond this share of the greatest possible distance a sentence is in no known language.
STRANGE = 0.8
#: A sentence whose two nearest profiles are closer than this follows the clear sentences of its record.
UNSURE = 0.08
LEAST_WORDS = 4

# Codes and names of languages, by ISO 639-1 code. Names as in English, the language itself and the six others.
NAMES = {
    "en": "en eng english anglais inglés ingles englisch inglese inglês английский",
    "fr": "fr fre fra french français francais francés frances französisch franzosisch francese francês французский",
    "es": "es spa spanish espagnol español espanol castellano spanisch spagnolo espanhol испанский",
    "de": "de ger deu german allemand alemán aleman deutsch tedesco alemão alemao немецкий",
    "it": "it ita italian italien italiano italienisch итальянский",
    "pt": "pt por portuguese portugais portugués portugues portugiesisch portoghese português португальский",
    "ru": "ru rus russian russe ruso russisch russo русский",
}
# Labels that name no language.
NO_LANGUAGE = "und unknown unk undetermined undefined none null na nan n/a xx zxx mul mis qaa ? -"
# The months in German, whose days end in a full stop.
GERMAN_MONTHS = "januar|jänner|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember"

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = "no n0 nr vol v0l ref art cf pp"

_TAGS = re.compile(r"<[^<>\n]{0,300}>")
_TEX = re.compile(r"\\[\"'`^~=.c]\{?([A-Za-z])\}?")
_TEX_COMMAND = re.compile(r"\\[A-Za-z]+\*?|\\\W")
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+")
# nor does the one after an abbreviation, after a number at the start of a line, or at the end of a row of dots
_NOT_AFTER = r"(?<!\.\.\.\.)(?<!\n\d\.)(?<!\n\d\d\.)(?<!\n\d\d\d\.)" + "".join(rf"(?<!\b(?i:{a})\.)" for a in ABBREVIATIONS.split())
# a mark, a telegram's "stop" or a blank line; what begins with one set of characters is searched fast
_STOP = re.compile(
    rf"[.!?…sS\n](?:(?<=[.!?…]){_NOT_AFTER}(?:[\"'»”)\]*_]+)?(?=\s|$)(?!(?<=\b\d\.)\s+(?i:{GERMAN_MONTHS})\b)(?!(?<=\b\d\d\.)\s+(?i:{GERMAN_MONTHS})\b)|(?<=\s[sS])(?i:TOP)(?=\s)|(?<=\n)\s*\n)"
)
_WORD = re.compile(r"[^\W\d_]+")


def label_language(label: Column) -> Column:
    """The code a label names, with or without a region; '' where it names none; the bare label where it names another language."""
    bare = F.lower(F.trim(label))
    head = F.regexp_extract(bare, r"^([\p{L}?/-]+?)(?:[-_ (].*)?$", 1)
    out = F.when(label.isNull() | (bare == "") | bare.isin(NO_LANGUAGE.split()) | head.isin(NO_LANGUAGE.split()) | ~bare.rlike(r"\p{L}"), F.lit(""))
    for code, names in NAMES.items():
        out = out.when(bare.isin(names.split()) | head.isin(names.split()), F.lit(code))
    return out.otherwise(bare)


def plain(text: str) -> str:
    """Text without tags, entities, addresses and commands, for the measuring only."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAGS.sub(" ", text)
    if "\\" in text:
        text = _TEX_COMMAND.sub(" ", _TEX.sub(r"\1", text))
    return _ADDRESS.sub(" ", text)


def sentences(text: str) -> list[tuple[str, bool]]:
    """Sentences in order, each with whether it ends as one does. Single line ends are plain space."""
    out, start = [], 0
    for m in _STOP.finditer(text):
        piece = text[start : m.end()]
        if (flat := " ".join(piece.split())):
            out.append((flat, not m.group().startswith("\n")))
        start = m.end()
    if (flat := " ".join(text[start:].split())):
        out.append((flat, False))
    return out


def _grams(word: str) -> list[str]:
    padded = f"_{word}_"
    n = len(padded)
    return [padded[i : i + k] for k in range(1, LONGEST_GRAM + 1) for i in range(n - k + 1) if padded[i : i + k] != "_"]


def ranked(words: list[str]) -> list[str]:
    """N-grams from the most frequent on; ties stay in order of first occurrence."""
    counts = Counter(chain.from_iterable(map(_grams, words)))
    return [g for g, _ in sorted(counts.items(), key=itemgetter(1), reverse=True)]


#: N-grams that are ranked at once, and n-grams known to a worker before it forgets them.
_AT_ONCE, _REMEMBERED = 1 << 19, 1 << 20


class _Lexicon:
    """The numbered n-grams of the words that a worker has met. Those of the profiles come first, so that their numbers are their rows."""

    def __init__(self, row: dict[str, int]):
        self.known = row
        self.forget()

    def forget(self) -> None:
        self.number = dict(self.known)
        self.words: dict[str, int] = {}
        self.flat = array("i")
        self.start = array("q", [0])

    def ids(self, words: list[str]) -> list[int]:
        at = self.words
        try:
            return list(map(at.__getitem__, words))
        except KeyError:
            number = self.number
            for w in words:
                if w not in at:
                    at[w] = len(at)
                    self.flat.extend([number.setdefault(g, len(number) + 1) for g in _grams(w)])
                    self.start.append(len(self.flat))
        return list(map(at.__getitem__, words))


@dataclass(frozen=True)
class Profiles:
    """Ranks of n-grams by language: row ``row[gram]`` of ``place`` has one rank per language, far beyond PROFILE_SIZE where it is out of the
    profile; row 0 is that of a gram in no profile."""

    langs: tuple[str, ...]
    row: dict[str, int]
    place: np.ndarray

    @classmethod
    def fit(cls, samples: list[tuple[str, str]]) -> Profiles:
        """From (language, text) pairs: a fixed table of known texts, not the corpus."""
        words: dict[str, list[str]] = {}
        for lang, text in samples:
            if lang and text:
                words.setdefault(lang, []).extend(w.lower() for w in _WORD.findall(text))
        langs = tuple(sorted(words))
        profiles = [ranked(words[lang])[:PROFILE_SIZE] for lang in langs]
        row = {g: i for i, g in enumerate(dict.fromkeys(chain.from_iterable(profiles)), 1)}
        place = np.full((len(row) + 1, len(langs)), 3 * PROFILE_SIZE, np.int16)
        for k, profile in enumerate(profiles):
            place[[row[g] for g in profile], k] = np.arange(len(profile))
        return cls(langs, row, place)

    def judge(self, text: str) -> list[tuple[str, str, float, bool]]:
        """(sentence, language, confidence, whole) for each sentence of a text; '' where no profile is near.

        Confidence is the lead of the nearest profile over the next, as a share of the next one's distance.
        """
        return self.judge_all([text])[0]

    def judge_all(self, texts: list[str]) -> list[list[tuple[str, str, float, bool]]]:
        """What :func:`judge` gives for each text; the sentences of all are measured together."""
        parts = [sentences(plain(t)) for t in texts]
        words = [_WORD.findall(s.lower()) for p in parts for s, _ in p]
        away = self.distances_of(words)
        n_words = np.array([len(w) for w in words], np.int64)
        letters = np.array([sum(map(len, w)) for w in words], np.int64)
        there = n_words >= 2
        if len(self.langs) > 1:
            two = np.partition(away, 1, axis=1)[:, :2] if len(words) else np.zeros((0, 2))
            lead = np.where(there, 1 - two[:, 0] / np.maximum(1e-9, two[:, 1]), 0.0)
        else:
            lead = there.astype(float)
        best = away.argmin(1) if len(words) else np.zeros(0, np.int64)
        near = there & (away.min(1) <= STRANGE) if len(words) else there
        clear = near & (lead >= UNSURE) & (n_words >= LEAST_WORDS)
        worded = ((n_words >= LEAST_WORDS) & (letters >= 2.5 * n_words)).tolist()
        best, near, clear, lead, letters = best.tolist(), near.tolist(), clear.tolist(), lead.tolist(), letters.tolist()
        out, at = [], 0
        for p in parts:
            span = range(at, at + len(p))
            at += len(p)
            sure = sorted({best[i] for i in span if clear[i]})
            judged = []
            for i, (s, ended) in zip(span, p):
                lang = ""
                if near[i]:
                    k = best[i]
                    if lead[i] < UNSURE and sure:
                        k = min(sure, key=away[i].__getitem__)
                    lang = self.langs[k]
                judged.append((s, lang, lead[i] if lang else 0.0, ended and worded[i] and letters[i] >= 0.6 * (len(s) - s.count(" "))))
            out.append(judged)
        return out

    def distances(self, words: list[str]) -> np.ndarray:
        """Out-of-place distance of one sentence to each profile."""
        return self.distances_of([words])[0]

    def distances_of(self, sents: list[list[str]]) -> np.ndarray:
        """Out-of-place distance of each sentence to each profile, as a share of the greatest possible (sentences x languages); that
        of a sentence without words is 1."""
        lex = self.__dict__.get("_lexicon")
        if lex is None:
            object.__setattr__(self, "_lexicon", lex := _Lexicon(self.row))
        out = np.ones((len(sents), len(self.langs)))
        first = 0
        while first < len(sents):
            if len(lex.number) > _REMEMBERED:
                lex.forget()
            ids, sizes, grams, last = [], [], 0, first
            while last < len(sents):
                grams += LONGEST_GRAM * sum(map(len, sents[last]))
                if grams > _AT_ONCE and last > first:
                    break  # a sentence of more n-grams than that is measured alone
                own = lex.ids(sents[last])
                ids += own
                sizes.append(len(own))
                last += 1
            self._measure(lex, np.array(ids, np.int64), np.array(sizes), out[first:last])
            first = last
        return out

    def _measure(self, lex: _Lexicon, ids: np.ndarray, sizes: np.ndarray, out: np.ndarray) -> None:
        """Ranks the n-grams of some sentences, words given by number, and writes their distances to ``out``. Sentence, n-gram (then count) and
        first place are the parts of one whole number, so that two plain sorts rank them all."""
        start, flat = np.frombuffer(lex.start, np.int64), np.frombuffer(lex.flat, np.int32)
        n = start[ids + 1] - start[ids]
        total = int(n.sum())
        if not total:
            return
        gram = flat[np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(total)].astype(np.int64)
        held = np.bincount(np.repeat(np.arange(len(sizes)), sizes), n, len(sizes)).astype(np.int64)
        begin = np.cumsum(held) - held
        sent = np.repeat(np.arange(len(sizes)), held)
        # the bits of a place or count, and of an n-gram's number
        few, many = int(held.max()).bit_length(), len(lex.number).bit_length() + 1
        low = (1 << few) - 1
        key = (sent << (few + many)) | (gram << few) | (np.arange(total) - begin[sent])
        key.sort()
        same = key >> few
        head = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
        key = (key[head] >> (few + many) << 2 * few) | ((low - np.diff(np.append(head, total))) << few) | (key[head] & low)
        key.sort()
        sent = key >> 2 * few
        kinds = np.bincount(sent, minlength=len(sizes))
        rank = np.arange(len(key)) - (np.cumsum(kinds) - kinds)[sent]
        row = gram[begin[sent] + (key & low)]
        in_some = (rank < PROFILE_SIZE) & (row < len(self.place))
        size = np.minimum(kinds, PROFILE_SIZE)
        sent, rank, row = sent[in_some], rank[in_some], row[in_some]
        own = (rank * PROFILE_SIZE // size[sent]).astype(np.int16)[:, None]
        far = self.place[row]
        far -= own
        np.minimum(np.abs(far, out=far), PROFILE_SIZE, out=far)
        known = np.bincount(sent, minlength=len(sizes))
        there = np.flatnonzero(known)
        away = np.zeros((len(sizes), len(self.langs)))
        if len(there):
            away[there] = np.add.reduceat(far, (np.cumsum(known) - known)[there], axis=0, dtype=np.int64)
        worded = size > 0
        out[worded] = ((away + (size - known)[:, None] * PROFILE_SIZE) / (PROFILE_SIZE * np.maximum(1, size))[:, None])[worded]


SEGMENTS = "rec_no bigint, seg_no int, lang string, confidence double, n_sentences int, n_chars int, segment string"


def language_segments(df: DataFrame, samples: DataFrame, key: str = "rec_no", text: str = "content") -> DataFrame:
    """Rows (rec_no, seg_no, lang, confidence, n_sentences, n_chars, segment): the stretches of one language of each record.

    Neighbouring sentences of one language form a stretch; a fragment without a clear language of its own (a lead of UNSURE,
    LEAST_WORDS words) stays with the stretch before it. ``n_sentences`` counts whole sentences (an end mark, at least LEAST_WORDS words, letters for the most part); ``confidence`` is the lead of
    the nearest profile, averaged over the characters. Text in no known language (junk, figures) has lang ''. Null, empty
    and blank texts give no row; repeated keys are judged separately; other columns are ignored. ``samples`` (lang, text) is the
    fixed table of known texts; without any there is no language to name and every stretch has lang ''.
    """
    return _segments(df, samples, key, text, True)


def _segments(df: DataFrame, samples: DataFrame, key: str, text: str, written: bool) -> DataFrame:
    """:func:`language_segments`, whose text is null unless ``written``: counts need no copy of it."""
    known = [(r["lang"], r["text"]) for r in samples.select("lang", "text").collect()]
    profiles = df.sparkSession.sparkContext.broadcast(Profiles.fit(known))
    rows = spread(df.where(F.col(text).rlike(r"\S")).select(F.col(key).cast("bigint").alias("rec_no"), F.col(text).alias("body")))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = profiles.value
        for pdf in batches:
            out = []
            judged = model.judge_all(pdf["body"].tolist()) if model.langs else [[(body, "", 0.0, False)] for body in pdf["body"]]
            for rec, found in zip(pdf["rec_no"], judged):
                runs: list[list] = []
                for s, lang, lead, whole in found:
                    # a fragment with a clear language of its own is no part of a stretch in another
                    own = whole or lang and lead >= UNSURE and len(_WORD.findall(s)) >= LEAST_WORDS
                    if runs and (lang == runs[-1][0] or not own):
                        run = runs[-1]
                    else:
                        runs.append(run := [lang, 0.0, 0, 0, []])
                    if not run[0] and lang:
                        run[0] = lang
                    run[1] += lead * len(s) if lang == run[0] else 0.0
                    run[2] += whole and lang == run[0] and bool(lang)
                    run[3] += len(s)
                    if written:
                        run[4].append(s)
                out += [(rec, i, r[0], r[1] / r[3], int(r[2]), r[3], " ".join(r[4]) if written else None) for i, r in enumerate(runs)]
            yield pd.DataFrame(out, columns=["rec_no", "seg_no", "lang", "confidence", "n_sentences", "n_chars", "segment"]).astype({"rec_no": "Int64"})

    return rows.mapInPandas(judge, SEGMENTS)


def record_languages(segments: DataFrame) -> DataFrame:
    """Rows (rec_no, lang, confidence, n_sentences, share): each record's languages with the share of its characters."""
    total = F.sum("n_chars")
    per = segments.groupBy("rec_no", "lang").agg(
        F.sum(F.col("confidence") * F.col("n_chars")).alias("c"), F.sum("n_sentences").cast("int").alias("n_sentences"), total.alias("n")
    )
    whole = segments.groupBy("rec_no").agg(total.alias("all_chars"))
    return per.join(whole, "rec_no").select("rec_no", "lang", (F.col("c") / F.col("n")).alias("confidence"), "n_sentences", (F.col("n") / F.col("all_chars")).alias("share"))


def mislabelled(df: DataFrame, samples: DataFrame, key: str = "rec_no", text: str = "content", label: str = "lang_label") -> DataFrame:
    """Rows (rec_no, lang) for records of at least two whole sentences in a language whose label is missing, names none or
    another language, or that hold two or more languages. A row for each language with at least two whole sentences."""
    found = _segments(df, samples, key, text, False).where("n_sentences > 0").groupBy("rec_no", "lang").agg(F.sum("n_sentences").alias("n")).where("n >= 2")
    per = found.groupBy("rec_no").agg(F.collect_set("lang").alias("langs"))  # at most one entry per known language
    labels = df.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("rec_no"), label_language(F.col(label)).alias("said"))
    case = (F.size("langs") > 1) | (F.col("said") != F.element_at("langs", 1))
    return per.join(labels, "rec_no").where(case).select("rec_no", F.explode("langs").alias("lang")).distinct()
