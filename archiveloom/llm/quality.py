"""Problem 6: text quality statistics per record, and whether it is prose, a list, a table or junk.

The statistics are standardised and a Gaussian mixture is fitted to them by expectation-maximization over all records.  It starts
from inspected examples, one component each, and each component takes the kind of the examples that it answers for.  A record is
of the kind that its components make most probable; what they call a list, a table or junk is then checked exactly: more than
half of the characters must be of that kind.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archiveloom.session import settle, spread

#: Steps of expectation-maximization at most; it ends sooner when the mean log likelihood gains less than TOLERANCE.
STEPS, TOLERANCE = 40, 1e-3
#: Records that a component's example counts for, as its mean and as its variance (in squared deviations).
PRIOR_MEAN, PRIOR_SPREAD, SPREAD = 2.0, 8.0, 0.1
KINDS = ("prose", "list", "table", "junk")
#: The last three are shares of the visible characters, by the look of the line they stand in.
STATS = ("word_count", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "digit_ratio", "line_length", "list_share", "table_share", "junk_share")

_BREAKS = [
    (re.compile(r"<\s*li\b[^>]*>|\\item\b", re.I), "\n• "),
    (re.compile(r"<\s*tr\b[^>]*>", re.I), "\n"),
    (re.compile(r"</?\s*t[dh]\b[^>]*>", re.I), " | "),
    (re.compile(r"<\s*/?\s*(?:p|br|div|h[1-6]|ul|ol|table|pre)\b[^>]*>", re.I), "\n"),
    (re.compile(r"<[^<>\n]{1,200}>"), " "),
    (re.compile(r"\\(?:begin|end)\{[^}]*\}(?:\{[^}]*\})?"), "\n"),
]
_ACCENT = re.compile(r"\\[\"'`^~=.]\s?(?:\{\\?([A-Za-z])\}|\\?([A-Za-z]))")
_MARK = re.compile(r"\s*(?:[-–—•*·▪◦‣+]+\s+|[([]?(?:\d{1,3}|[A-Za-z]|[ivxlc]{1,5})[.)\]]\s+|\[\d+\]\s)")
_WORD = re.compile(r"[^\W\d_]+")
#: What a row of a table must hold for a look at its cells.
_CELLS = re.compile(r"[|\t&…]|\s\s|;.*;|\.\.\.\.|\s\.\s\.")
_DIGIT = re.compile(r"\d")
_NO_WORD = re.compile(r"\W")
_LEADER = re.compile(r"\w.*?(?:\.{4,}|(?:\s\.){3,}|…{2,})\s*\S")
_VOWEL = re.compile(r"[aeiouyàâäáãåæèéêëìíîïòóôöõøœùúûüýÿаеёиоуыэюя]", re.I)
_CLEAN = re.compile(r"[^\W\d_]{2,}(?:[-'’./][^\W\d_]+)*|[(]?\d+(?:[.,:/-]\d+)*%?[)]?|[-–—.…|]+|n/?a")
_TABLE_CELL = re.compile(r"\s*[\w%.\-'’ ]+(?:;[\w%.\-'’ ]+){2,}\s*")
_ENDED = re.compile(r"[.!?…][\"'»”)\]*_]*\s*$")
_INNER = re.compile(r"[.!?…][\"'»”)\]*_]*\s")


def lines_of(text: str) -> list[str]:
    """Lines without their markup, with list items and table rows on lines of their own."""
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ACCENT.sub(lambda m: m.group(1) or m.group(2), text)
    if "<" in text or "\\" in text:
        for pattern, to in _BREAKS:
            text = pattern.sub(to, text)
    return text.split("\n")


@lru_cache(maxsize=200_000)
def odd_token(t: str) -> bool:
    """No word, figure or ordinary abbreviation: letters without a vowel, marks inside of letters, endless runs."""
    core = t.strip(".,;:!?()[]{}\"'«»“”…*_|-–—/\\&%$€£°")
    if not core:
        return False
    if len(core) > 40:
        return True
    if core.replace("-", "").replace("'", "").replace("’", "").isalpha():
        return len(core) > 3 and core.islower() and not _VOWEL.search(core)
    return bool(re.search(r"[^\w.,:/'’°%@#&+-]", core)) or bool(re.search(r"[^\W\d]", core)) and bool(re.search(r"\W.*\W.*\W", core)) and "/" not in core


def cells(line: str) -> int:
    """Columns of a table row, 0 if the line is none."""
    bare = line.strip()
    if not re.search(r"\w", bare):
        return 2 if bare.count("|") >= 2 or bare.startswith(("{|", "|-", "|}")) else 0
    for parts in (bare.strip("|").split("|"), bare.split("\t"), re.split(r"\s{2,}", bare), bare.rstrip("\\").split(" & ")):
        full = [p for p in parts if p.strip()]
        if len(parts) >= 3 and len(full) >= 2 or len(parts) == 2 and len(full) == 2 and "\t" in bare:
            if sum(len(p.split()) for p in full) <= 6 * len(full):
                return len(parts)
    if bare.count(";") >= 2 and not re.search(r";\s", bare.rstrip("; ")):
        return bare.count(";") + 1
    if _LEADER.match(bare):
        return 2
    return 0


def line_kinds(text: str, common: frozenset[str]) -> tuple[dict[str, int], list[str]]:
    """Visible characters by kind, and the kind of each line that is not blank."""
    total, kinds, _ = _read(text, common)
    return total, kinds


def _read(text: str, common: frozenset[str]) -> tuple[dict[str, int], list[str], list[float]]:
    """What :func:`line_kinds` gives, and the number of lines, their characters, the lines that end as sentences do, the words, their letters, the words that are common,
    and the digits."""
    lines, kinds, ended_, shown = [], [], 0, []
    n_words = n_letters = n_known = 0
    for line in lines_of(text):
        tokens = line.split()
        if not tokens:
            continue
        lines.append(line)
        found = _WORD.findall(line.lower())
        visible = sum(map(len, tokens))
        shown.append(visible)
        known = sum(map(common.__contains__, found))
        letters = sum(map(len, found))
        n_words += len(found)
        n_letters += letters
        n_known += known
        ended = _ENDED.search(line[-12:]) is not None
        ended_ += ended
        n = cells(line) if _CELLS.search(line) else 0
        if not n and known >= 0.25 * len(tokens) and 3.5 * len(tokens) <= visible <= 12 * len(tokens) and letters >= 0.7 * visible:
            # words of usual length with many common ones among them can't be junk
            kinds.append("list" if _MARK.match(line) else "prose" if ended or sum(len(w) > 1 for w in found) > 12 else "")
            continue
        odd = sum(len(t) for t in tokens if odd_token(t))
        brief = sum(len(_NO_WORD.sub("", t)) <= 2 for t in tokens)
        words = [w for w in found if len(w) > 1]
        clean = sum(len(t) for t in tokens if _CLEAN.fullmatch(t.strip(",;:!?&|\"'«»“”*_•\\"))) if n else 0
        if n and (clean + line.count("|") + line.count("&") >= 0.6 * visible or _TABLE_CELL.fullmatch(line)):
            kind = "table"
        elif n and not letters:
            kind = "junk" if not line.strip(" |-:+=") == "" else "table"
        elif odd > 0.5 * visible or letters < 0.35 * visible and (len(tokens) >= 3 or not re.search(r"\w", line)) or len(tokens) >= 8 and brief > 0.75 * len(tokens) and (known < 0.2 * len(tokens) or brief > 0.95 * len(tokens)):
            kind = "junk"
        elif _MARK.match(line):
            kind = "list"
        elif ended or len(words) > 12:
            kind = "prose"
        else:
            kind = ""
        kinds.append(kind)
    # lines without a mark of their own: part of a sentence that goes on, or entries
    i = 0
    while i < len(lines):
        if kinds[i]:
            i += 1
            continue
        j = i
        while j < len(lines) and not kinds[j]:
            j += 1
        run = lines[i:j]
        words = _WORD.findall(" ".join(run))
        share = sum(w.lower() in common for w in words) / max(1, len(words))
        inner = sum(bool(_INNER.search(x)) for x in run)
        width = sum(map(len, run)) / len(run)
        beside = (i > 0 and kinds[i - 1] == "list") or (j < len(lines) and kinds[j] == "list")
        commas = sum(bool(re.search(r",\s[^,]{2,20}$", x)) for x in run) / len(run)
        if beside and len(run) == 1 and len(words) <= 4:
            kind = "list"
        elif inner or len(run) < 3:
            kind = "prose"
        else:
            kind = "list" if width < 30 or share < 0.15 or commas > 0.6 else "prose"
        kinds[i:j] = [kind] * len(run)
        i = j
    total = dict.fromkeys(KINDS, 0)
    for visible, kind in zip(shown, kinds):
        total[kind] += visible
    return total, kinds, [len(lines), sum(map(len, lines)), ended_, n_words, n_letters, n_known, len(_DIGIT.findall(" ".join(lines)))]


def statistics(text: str, common: frozenset[str]) -> list[float]:
    """The values named in STATS. A text without visible characters has zeros."""
    total, _, (n, chars, ended, words, letters, known, digits) = _read(text, common)
    visible = sum(total.values())
    if not visible:
        return [0.0] * len(STATS)
    shares = [total[k] / visible for k in KINDS[1:]]
    return [float(words), letters / max(1, words), max(0, visible - letters - digits) / visible, ended / n, known / max(1, words), digits / visible, math.log1p(chars / n), *shares]


# The inspected examples that give components their kind.
EXAMPLES = [
    ("prose", "The committee met in the spring to review the work of the year. It found that the wells had been repaired, and that the road was open again. No one could say when the next visit would take place."),
    ("prose", "La commission a examiné les comptes de l'année. Elle a constaté que les puits avaient été réparés, tandis que la route restait fermée."),
    ("prose", "The harbour was closed for two weeks, and the\nboats could not land. After long talks the guards\nlet the first ones in on 4 May 1962. The others\nwaited until the end of the month."),
    ("prose", "Der Bericht zeigt, dass die Brunnen im Mai 1961 wieder in Betrieb waren. Offen blieben die Fragen nach den Kosten und nach der Strasse zum Hafen."),
    ("prose", "La nota dice que los pozos fueron reparados. Nadie sabía por qué el camino seguía cerrado, mientras que las barcas esperaban en el puerto."),
    ("prose", "Комиссия изучила отчёты за год и отметила, что колодцы отремонтированы. Никто не знал, почему дорога была закрыта."),
    ("prose", "# Summary\n\nThe wells were repaired in **June**, and the road was opened. See [the note](docs/a.md) of 4 May for the rest of it."),
    ("prose", "THE WELLS WERE REPAIRED IN JUNE STOP THE ROAD WAS OPENED AFTER LONG TALKS STOP NO ONE COULD SAY WHEN THE BOATS WOULD LAND."),
    ("list", "• blankets, 200\n• lamps\n• ropes, 15\n• water pumps\n• buckets, 40\n• stretchers"),
    ("list", "1. couvertures\n2. lampes, 14\n3. cordes\n4. pompes à eau, 3\n5. seaux\n6. brancards, 20"),
    ("list", "a) blankets, 12;\nb) lamps;\nc) ropes, 9;\nd) water pumps;\ne) buckets, 44;"),
    ("list", "Water pumps, 31, Geneva\nStretchers, Turin\nRopes, 2, Lyon\nBlankets, Bern\nLamps, 77, Lyon"),
    ("list", "GENEVA\n – water pumps\nTURIN\n – ropes, 14\nLYON\n – stretchers\nBERN\n – lamps"),
    ("list", "<ul><li>water pumps</li>\n<li>ropes</li>\n<li>stretchers</li>\n<li>lamps</li></ul>"),
    ("table", "Item\t1960\t1961\t1962\nblankets\t12\t4%\t-\nlamps\t7.5\t90\t3310\nropes\t-\t18\t22%"),
    ("table", "| Item | 1960 | 1961 |\n|------|------|------|\n| blankets | 12 | 4% |\n| lamps | 7.5 | - |\n| ropes | 18 | 940 |"),
    ("table", "blankets;12;4%;-;88\nlamps;7.5;90;3310;4\nropes;-;18;22%;61"),
    ("table", "blankets .... 12\nwater pumps .... 4%\nlamps .... 3310\nropes .... -\nstretchers .... 7.5"),
    ("table", "Item              1960     1961     1962\nblankets          12       4%       -\nlamps             7.5      90       3310"),
    ("table", "Jan\tGeneva\twater pumps\tTurin\nFeb\tLyon\tropes\tBern\tidem\nMar\tTurin\tlamps\tLyon\tn/a"),
    ("junk", "kxqwz bnfrt hgplk zzxcv mnbvq wrtpl kdfgh xcvbn qwrtp lkjhg fdspl mnbvc zxplk jhgfd"),
    ("junk", "0 a il ii rn t a il ii c c 0 i1 il a t vv a rn 0 c il a c rn x"),
    ("junk", "?;-/(x0~ );;%(1!@(-/x!@1 -:9b/?1^b:~a) +-:@w~9+ .,/;:;1,w!:@1,0w)~ (~09 b?q qw:a:^x!:@("),
    ("junk", "a i c ii 0 a i1 c t a 0 a c i x a i c vv a 0 i c a t rn i a c x a i"),
    ("junk", "0041. 000027 6606%; 0013 ? 2204; 00000065 1193. 0082 ? 3570% 000013 44; 00027. 3193 ?"),
    ("junk", "q8Jm2xWvR0tYb7LsKp4ZcNf1HgUeAo3DiQw6TxVyBn5MrEkS9lJhGzCaPuOdFi+W/qT8x2Yv7Zb3Nm"),
    ("junk", "~~~~~~~\n. . . . . .\n/ / / /\n....,,,,....\n- - - - -\n( ) ( ) ( )\n27 3301 88"),
]

MEASURED = "rec_no bigint, stats array<double>"


def measured(df: DataFrame, words: DataFrame, key: str = "rec_no", text: str = "content") -> DataFrame:
    """Rows (rec_no, stats) for every text with visible characters: the values named in STATS. ``words`` (word) is the fixed table of
    common words."""
    common = known_words(words)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"rec_no": pdf["rec_no"], "stats": [statistics(b, common) for b in pdf["body"]]})

    rows = df.where(F.col(text).rlike(r"\S")).select(F.col(key).cast("bigint").alias("rec_no"), F.col(text).alias("body"))
    return spread(rows).mapInPandas(measure, MEASURED)


def known_words(words: DataFrame) -> frozenset[str]:
    """The fixed table of common words, in lower case."""
    return frozenset(r["word"].lower() for r in words.select("word").distinct().collect() if r["word"])


# ---- the mixture -------------------------------------------------------------------------------------------------------------


def _plain(stats: np.ndarray) -> np.ndarray:
    """Statistics as they are standardised: the number of words by its logarithm."""
    return np.column_stack([np.log1p(stats[:, 0]), stats[:, 1:]])


@dataclass
class Mixture:
    """A Gaussian mixture with diagonal covariances over standardised statistics, each component with the probability of each kind."""

    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    kind: np.ndarray

    def standardised(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((_plain(stats) - self.centre) / self.scale, -8, 8)

    def densities(self, x: np.ndarray) -> np.ndarray:
        """Log of each component's weighted density at standardised points (points x components)."""
        p = 1 / self.var
        away = (x * x) @ p.T - 2 * x @ (self.mean * p).T + (self.mean**2 * p).sum(1)
        return np.log(self.weight) - 0.5 * (away + np.log(2 * np.pi * self.var).sum(1))

    def posteriors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each component's share in each point, and the points' log likelihoods."""
        d = self.densities(x)
        top = d.max(1, keepdims=True)
        e = np.exp(d - top)
        total = e.sum(1, keepdims=True)
        return e / total, (top + np.log(total))[:, 0]

    def kinds(self, stats: np.ndarray) -> np.ndarray:
        """The probability of each of KINDS (records x kinds)."""
        return self.posteriors(self.standardised(stats))[0] @ self.kind


def _summed(rows: DataFrame, size: int, values) -> np.ndarray:
    """The sum over all rows of what ``values`` makes of a matrix of statistics: ``size`` numbers, added up in the tasks first."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += values(np.stack(pdf["stats"].to_numpy()))
        yield pd.DataFrame({"at": np.arange(size), "v": total})

    out = np.zeros(size)
    for r in rows.select("stats").mapInPandas(add, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def fit_mixture(rows: DataFrame, common: frozenset[str]) -> Mixture:
    """Expectation-maximization over all ``rows`` (stats), one pass a step; sums of a fixed size reach the driver.

    Each inspected example starts a component and counts for a few records of it, so that the same path holds for any number of
    records, none included.
    """
    inspected = np.array([statistics(t, common) for _, t in EXAMPLES])
    d, k = inspected.shape[1], len(EXAMPLES)
    moments = lambda s: np.concatenate([[len(s)], _plain(s).sum(0), (_plain(s) ** 2).sum(0)])
    sums = _summed(rows, 1 + 2 * d, moments) + moments(inspected)
    centre = sums[1 : 1 + d] / sums[0]
    scale = np.sqrt(np.maximum(1e-6, sums[1 + d :] / sums[0] - centre**2))
    model = Mixture(centre, scale, np.full(k, 1 / k), np.zeros((k, d)), np.full((k, d), 0.5), np.zeros((k, len(KINDS))))
    start = model.mean = model.standardised(inspected)
    last = -math.inf
    for _ in range(STEPS):
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def expect(stats: np.ndarray, shared=shared) -> np.ndarray:
            x = shared.value.standardised(stats)
            r, like = shared.value.posteriors(x)
            return np.concatenate([r.sum(0), (r.T @ x).ravel(), (r.T @ (x * x)).ravel(), [like.sum(), len(x)]])

        got = _summed(rows, k * (1 + 2 * d) + 2, expect)
        n, s, q = got[:k], got[k : k + k * d].reshape(k, d), got[k + k * d : -2].reshape(k, d)
        mean = (s + PRIOR_MEAN * start) / (n + PRIOR_MEAN)[:, None]
        around = q - 2 * mean * s + n[:, None] * mean**2 + PRIOR_MEAN * (start - mean) ** 2 + PRIOR_SPREAD * SPREAD
        model = Mixture(centre, scale, (n + 1) / (n + 1).sum(), mean, around / (n + PRIOR_MEAN + PRIOR_SPREAD)[:, None], model.kind)
        shared.unpersist()
        like = got[-2] / max(1.0, got[-1])
        if like - last < TOLERANCE:
            break
        last = like
    model.kind = component_kinds(model, inspected)
    return model


def component_kinds(model: Mixture, inspected: np.ndarray) -> np.ndarray:
    """The kind of each component (1 for it, 0 for others): that of the examples which are nearest to its mean, in its own
    deviations. One example speaks for itself where it stays nearest."""
    x = model.standardised(inspected)
    out = np.zeros((len(model.mean), len(KINDS)))
    for i, (m, v) in enumerate(zip(model.mean, model.var)):
        away = ((x - m) ** 2 / (v + SPREAD)).sum(1)
        out[i, KINDS.index(EXAMPLES[int(away.argmin())][0])] = 1.0
    return out


QUALITY = "rec_no bigint, " + ", ".join(f"{s} double" for s in STATS) + ", component int, prose_probability double, mixture_kind string, kind string"


def text_quality(df: DataFrame, words: DataFrame, key: str = "rec_no", text: str = "content") -> DataFrame:
    """Rows (rec_no, the STATS, component, prose_probability, mixture_kind, kind) for every text with visible characters.

    ``mixture_kind`` is the most probable kind by the mixture; ``kind`` is the same where the exact check holds (more than half
    of the characters are of it), else prose. Null, empty and blank texts give no row; repeated keys one row each; other columns
    are ignored. An empty table gives an empty result.
    """
    rows = settle(measured(df, words, key, text))
    shared = df.sparkSession.sparkContext.broadcast(fit_mixture(rows, known_words(words)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            stats = np.stack(pdf["stats"].to_numpy())
            r, _ = model.posteriors(model.standardised(stats))
            p = r @ model.kind
            best = p.argmax(1)
            share = np.column_stack([np.ones(len(stats)), stats[:, -3:]])[np.arange(len(stats)), best]
            names = np.array(KINDS, dtype=object)
            out = pd.DataFrame({"rec_no": pdf["rec_no"].to_numpy()} | {s: stats[:, i] for i, s in enumerate(STATS)})
            yield out.assign(component=r.argmax(1).astype("int32"), prose_probability=p[:, 0], mixture_kind=names[best], kind=names[np.where(share > 0.5, best, 0)])

    return rows.mapInPandas(place, QUALITY)
