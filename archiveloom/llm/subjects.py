"""Problem 2: the subject areas that a text treats.

One-versus-rest linear classifiers on hashed word n-grams, with L1 so that words common to all subjects weigh nothing.  They start
from the labelled seed texts and are refitted on weak labels: a sentence without a subject of its own takes those of its
section (the chunk it stands in), which teaches the terms that no seed holds.  Each round counts n-grams by subject over all
sections, and the thresholds are calibrated on the scores of all sentences; only the gradient runs on a bounded sample, to which
sections are added that hold speaking n-grams the sample lacks.  The corpus is then scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archiveloom.llm.language import plain, sentences
from archiveloom.session import settle, spread

BUCKETS = 1 << 16
HEAD = 5
#: Most stretches that the gradient is first run on, drawn by a hash of their key; as many again may be added for n-grams they lack.
TRAINING_SECTIONS = 6000
#: Sentences of a stretch at most (a section, or a part of a long one), so that the sample's size is bounded too.
STRETCH = 250
#: Stretches that a speaking n-gram shall have in the sample, where so many hold it.
FEW = 4
#: Probability from which a sentence counts as labelled, round by round: the seeds alone speak first, then looser.
ROUNDS = (0.5, 0.3, 0.2, 0.2, 0.2, 0.2)
#: Share of a section's sentences from which it lends its subject to the others.
LENDING = 0.12
#: What it lends, as a multiple of its own share.
GENEROUS = 2.0
#: A section weighs as much as so many sentences at most.
WEIGHTY = 40
#: An n-gram speaks for a subject only if, of the sections that hold it, the share that treats the subject lies this far between the
#: share of all sections and one; words of all subjects don't. Shares start from two sections of the usual share.
TELLING, PRIOR = 0.33, 2
L1, STEPS, RATE = 3e-5, 40, 0.3
_WORD = re.compile(r"[^\W\d_]+")


def sentence_words(text: str) -> list[list[str]]:
    """Words of each sentence of at least four words."""
    found = ([w.lower() for w in _WORD.findall(s)] for s, _ in sentences(plain(text)))
    return [w for w in found if len(w) >= 4]


def buckets(words: list[str]) -> np.ndarray:
    """Hashed single words, pairs, and the heads of long words (which inflected forms, compounds and loan words share), each once."""
    own = [_hashes(w) for w in words]
    pairs = [zlib.crc32(b, begun) % BUCKETS for (_, _, begun, _), (_, _, _, b) in zip(own, own[1:])]
    return np.array(sorted({h for h, _, _, _ in own}.union(pairs, (head for _, head, _, _ in own if head >= 0))), dtype=np.int64)


@lru_cache(maxsize=200_000)
def _hashes(word: str) -> tuple[int, int, int, bytes]:
    """A word's bucket, that of its head (-1 for a short word), the checksum that a pair begins with, and its bytes."""
    b = word.encode()
    return zlib.crc32(b) % BUCKETS, zlib.crc32((word[:HEAD] + "-").encode()) % BUCKETS if len(word) > HEAD else -1, zlib.crc32(b + b" "), b


@dataclass
class SubjectModel:
    subjects: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def probabilities(self, sents: list[np.ndarray]) -> np.ndarray:
        n, k = len(sents), len(self.subjects)
        if not n or not k:
            return np.zeros((n, k))
        row, col = np.repeat(np.arange(n), [len(x) for x in sents]), np.concatenate(sents)
        heard = (self.weights != 0).any(1)[col]  # most n-grams have no weight for any subject
        row, col = row[heard], col[heard]
        z = np.stack([np.bincount(row, self.weights[col, j], n) for j in range(k)], 1) + self.bias
        return 1 / (1 + np.exp(-z))

    def _descend(self, sents: list[np.ndarray], target: np.ndarray, weight: np.ndarray, l1: float, telling: np.ndarray | None = None) -> None:
        """Proximal adaptive gradient descent on the logistic loss of each subject. ``telling`` (buckets x subjects) says which n-grams may
        speak for which subject."""
        n, k = len(sents), len(self.subjects)
        row, col = np.repeat(np.arange(n), [len(x) for x in sents]), np.concatenate(sents)
        weight = weight / weight.sum()
        self.weights = np.zeros((BUCKETS, k), np.float32)
        self.bias = np.full(k, -2.5)
        for j in range(k):
            # an n-gram that may not speak keeps the weight 0, so its places need no look
            free = np.ones(len(col), bool) if telling is None else telling[col, j]
            own_row = row[free]
            used = distinct(col[free])
            at = np.searchsorted(used, col[free])
            w, seen, seen_b = np.zeros(len(used)), np.full(len(used), 1e-9), 1e-9
            for _ in range(STEPS):
                z = np.bincount(own_row, w[at], n) + self.bias[j]
                slope = (1 / (1 + np.exp(-z)) - target[:, j]) * weight
                g = np.bincount(at, slope[own_row], len(used))
                seen += g * g
                step = RATE / np.sqrt(seen)
                w -= step * g
                w = np.sign(w) * np.maximum(0, np.abs(w) - step * l1)
                total = slope.sum()
                seen_b += total * total
                self.bias[j] -= RATE * total / np.sqrt(seen_b)
            self.weights[used, j] = w

    @classmethod
    def fit(cls, seeds: list[tuple[str, str]], sections: list[str] | Sections) -> SubjectModel:
        """From labelled (subject, text) seeds and unlabelled sections: their texts, or the passes over them."""
        subjects = sorted({s for s, t in seeds if s and t})
        model = cls(subjects)
        known = [(subjects.index(s), buckets(w)) for s, t in seeds if s and t for w in sentence_words(t)]
        if not known:
            return model
        every = sections if isinstance(sections, Sections) else Sections([[buckets(w) for w in sentence_words(t)] for t in sections])
        sx, sy = [x for _, x in known], np.eye(len(subjects))[[k for k, _ in known]]
        # seeds are sections of one known subject
        seeded = tally([[x] for x in sx], sy)
        model._descend(sx, sy, np.ones(len(sx)), 1e-4, telling(*seeded))
        drawn = every.draw()
        for sure in ROUNDS if drawn else ():
            speaks = telling(*(a + b for a, b in zip(seeded, every.tally(model, sure))))
            drawn += every.holding(speaks.any(1))
            qx, own_at = flat(drawn)
            if not qx:
                break
            hit, lent = lending(model, drawn, sure)
            bare = hit.sum(1) == 0
            target = np.where(bare[:, None], lent[own_at], hit)
            weight = np.where(bare, 0.7, 1.0) * np.minimum(1, WEIGHTY / np.array(every.sizes)[own_at])
            model._descend(sx + qx, np.concatenate([sy, target]), np.concatenate([np.ones(len(sx)), weight]), L1, speaks)
        model.thresholds = np.array([_valley(*h) for h in (histogram(model, [[x] for x in sx]) + every.histogram(model))])
        return model


def flat(sections: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """All sentences, and the section of each."""
    return [x for sents in sections for x in sents], np.repeat(np.arange(len(sections)), [len(sents) for sents in sections])


def lending(model: SubjectModel, sections: list[list[np.ndarray]], sure: float) -> tuple[np.ndarray, np.ndarray]:
    """The sentences' subjects, and what each section lends."""
    sents, own_at = flat(sections)
    hit = (model.probabilities(sents) > sure).astype(float)
    size = np.maximum(1, np.bincount(own_at, minlength=len(sections)))
    share = np.stack([np.bincount(own_at, hit[:, k], len(sections)) for k in range(len(model.subjects))], 1) / size[:, None]
    return hit, np.minimum(1, GENEROUS * share) * (share >= LENDING)


def distinct(x: np.ndarray) -> np.ndarray:
    """The different whole numbers of an array, in order. (A plain sort is faster here than looking each up.)"""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def tally(sections: list[list[np.ndarray]], of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sections by n-gram, by n-gram and subject, by subject, and in all; ``of`` (sections x subjects) says what they treat."""
    sents, own_at = flat(sections)
    pair = distinct(np.repeat(own_at, [len(x) for x in sents]) * BUCKETS + np.concatenate(sents)) if sents else np.zeros(0, np.int64)
    section, gram = pair // BUCKETS, pair % BUCKETS
    by = np.zeros((BUCKETS, of.shape[1]))
    for k in range(of.shape[1]):
        at = (of[:, k] != 0)[section]
        by[:, k] = np.bincount(gram[at], of[section[at], k], BUCKETS)
    return np.bincount(gram, minlength=BUCKETS), by, of.sum(0), len(sections)


def telling(held: np.ndarray, by: np.ndarray, treat: np.ndarray, n: int) -> np.ndarray:
    usual = treat / n
    return (by + PRIOR * usual) / (held[:, None] + PRIOR) >= usual + TELLING * (1 - usual)


#: Thresholds that are tried, and the unit of the sums, which are whole numbers so that they are the same in any order.
TRIED = np.arange(0.2, 0.61, 0.02)
UNIT = 10**6


def histogram(model: SubjectModel, sections: list[list[np.ndarray]]) -> np.ndarray:
    """Per subject the sentences between two thresholds and the sum of their probabilities (subjects x 2 x bins). A section weighs as
    much as WEIGHTY sentences at most."""
    sents, own_at = flat(sections)
    p = model.probabilities(sents)
    size = np.array([max(1, len(x)) for x in sections])
    weight = np.minimum(1, WEIGHTY / size[own_at]) if sents else np.zeros(0)
    at = np.searchsorted(TRIED, p)
    bins = lambda k, w: np.bincount(at[:, k], np.round(w * UNIT), len(TRIED) + 1)
    return np.stack([np.stack([bins(k, weight), bins(k, weight * p[:, k])]) for k in range(len(model.subjects))])


def _valley(n: np.ndarray, total: np.ndarray) -> float:
    """The threshold between 0.2 and 0.6 that parts the scores best (greatest variance between the two classes)."""
    best, at = -1.0, 0.5
    for i, t in enumerate(TRIED, 1):
        above, below = n[i:].sum(), n[:i].sum()
        if above and below:
            share = above / (above + below)
            spread_ = share * (1 - share) * (total[i:].sum() / above - total[:i].sum() / below) ** 2
            if spread_ > best:
                best, at = spread_, float(t)
    return at


class Sections:
    """Unlabelled sections that are all held here; all are drawn."""

    def __init__(self, sections: list[list[np.ndarray]]):
        self.sections = sections
        #: Sentences of the section of each stretch that was drawn.
        self.sizes = [max(1, len(x)) for x in sections]

    def draw(self) -> list[list[np.ndarray]]:
        """The sample that the gradient is run on."""
        return list(self.sections)

    def holding(self, speaks: np.ndarray) -> list[list[np.ndarray]]:
        """Further sections for n-grams that the sample lacks."""
        return []

    def tally(self, model: SubjectModel, sure: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        return tally(self.sections, (lending(model, self.sections, sure)[1] > 0).astype(float))

    def histogram(self, model: SubjectModel) -> np.ndarray:
        return histogram(model, self.sections)


def _packed(sents: list[np.ndarray]) -> tuple[bytes, bytes]:
    """The lengths of sentences and their buckets (two bytes each)."""
    return np.array([len(x) for x in sents], np.int32).tobytes(), np.concatenate([*sents, np.zeros(0, np.int64)]).astype(np.uint16).tobytes()


def _unpacked(lens: bytes, grams: bytes) -> list[np.ndarray]:
    n = np.frombuffer(lens, np.int32)
    return np.split(np.frombuffer(grams, np.uint16).astype(np.int64), np.cumsum(n)[:-1]) if len(n) else []


class SpreadSections(Sections):
    """Sections in a frame (node_id, lens, grams): sums come to the driver, of a size set by BUCKETS and the subjects, and the sample."""

    def __init__(self, rows: DataFrame, most: int):
        self.rows, self.most, self.room = rows, most, most
        self.sizes: list[int] = []
        self.taken: set[tuple] = set()
        #: Sections, and stretches of the sample, that hold each n-gram.
        self.held, self.has = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)

    def _stretches(self) -> DataFrame:
        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for node, lens, grams in zip(pdf["node_id"], pdf["lens"], pdf["grams"]):
                    sents = _unpacked(lens, grams)
                    out += [(node, i, len(sents), *_packed(sents[i : i + STRETCH])) for i in range(0, max(1, len(sents)), STRETCH)]
                yield pd.DataFrame(out, columns=["node_id", "part", "size", "lens", "grams"])

        cut_ = self.rows.select("node_id", "lens", "grams").mapInPandas(cut, "node_id string, part int, size int, lens binary, grams binary")
        return cut_.withColumn("h", F.xxhash64("node_id") + F.col("part"))

    def _taken(self, found: list) -> list[list[np.ndarray]]:
        self.taken |= {(r["node_id"], r["part"]) for r in found}
        self.sizes += [max(1, r["size"]) for r in found]
        more = [_unpacked(r["lens"], r["grams"]) for r in found]
        self.has += tally(more, np.zeros((len(more), 1)))[0]
        return more

    def draw(self) -> list[list[np.ndarray]]:
        return self._taken(self._stretches().orderBy("h", "node_id", "part").limit(self.most).collect())

    def holding(self, speaks: np.ndarray) -> list[list[np.ndarray]]:
        """Stretches for the n-grams that speak and of which the sample has fewer than FEW, those first that serve most sections."""
        wanted = speaks & (self.has < np.minimum(FEW, self.held))
        if not self.room or not wanted.any():
            return []
        shared = self.rows.sparkSession.sparkContext.broadcast((wanted, self.taken))

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            wanted, taken = shared.value
            best: dict[tuple, tuple] = {}
            for pdf in batches:
                for node, part, grams, h in zip(pdf["node_id"], pdf["part"], pdf["grams"], pdf["h"]):
                    if (node, part) not in taken:
                        own = distinct(np.frombuffer(grams, np.uint16))
                        for g in own[wanted[own]].tolist():
                            slot, me = (g, h % FEW), (h, node, part)
                            if slot not in best or me < best[slot]:
                                best[slot] = me
            yield pd.DataFrame([(*slot, *me) for slot, me in best.items()], columns=["gram", "slot", "h", "node_id", "part"])

        least = self._stretches().mapInPandas(find, "gram int, slot int, h long, node_id string, part int").groupBy("gram", "slot").agg(F.min(F.struct("h", "node_id", "part")).alias("x"))
        worth: dict[tuple, int] = {}
        for r in least.select("gram", "x.*").collect():  # FEW rows per bucket at most
            key = r["node_id"], r["part"]
            worth[key] = worth.get(key, 0) + int(self.held[r["gram"]])
        chosen = set(sorted(worth, key=lambda x: (-worth[x], x))[: self.room])
        given = self.rows.sparkSession.sparkContext.broadcast(chosen)

        def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf[[x in given.value for x in zip(pdf["node_id"], pdf["part"])]]

        found = sorted(self._stretches().mapInPandas(take, "node_id string, part int, size int, lens binary, grams binary, h long").collect(), key=lambda r: (r["h"], r["node_id"], r["part"]))
        self.room -= len(found)
        return self._taken(found)

    def tally(self, model: SubjectModel, sure: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        shared = self.rows.sparkSession.sparkContext.broadcast((model.subjects, model.weights, model.bias))
        kinds = [f"k{k}" for k in range(len(model.subjects))]

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = SubjectModel(*shared.value)
            sums: list = [0, 0, 0, 0]
            for pdf in batches:
                sections = [_unpacked(*x) for x in zip(pdf["lens"], pdf["grams"])]
                sums = [a + b for a, b in zip(sums, tally(sections, (lending(own, sections, sure)[1] > 0).astype(float)))]
            held, by, treat, n = sums
            if n:
                used = np.flatnonzero(held)
                # the row of no n-gram has the sections in all
                body = np.concatenate([np.column_stack([used, held[used], by[used]]), [[-1, n, *treat]]]).astype(np.int64)
                yield pd.DataFrame(body, columns=["gram", "held", *kinds])

        made = self.rows.select("lens", "grams").mapInPandas(count, "gram long, held long, " + ", ".join(f"{k} long" for k in kinds))
        got = made.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("held", *kinds)]).toArrow().to_pandas().to_numpy(dtype=np.int64)  # a row per bucket
        full = np.zeros((BUCKETS + 1, len(kinds) + 1), np.int64)
        full[got[:, 0]] = got[:, 1:]
        self.held = full[:BUCKETS, 0]
        return self.held, full[:BUCKETS, 1:], full[-1, 1:], int(full[-1, 0])

    def histogram(self, model: SubjectModel) -> np.ndarray:
        shared = self.rows.sparkSession.sparkContext.broadcast((model.subjects, model.weights, model.bias))
        shape = (len(model.subjects), 2, len(TRIED) + 1)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, total = SubjectModel(*shared.value), np.zeros(shape)
            for pdf in batches:
                total += histogram(own, [_unpacked(*x) for x in zip(pdf["lens"], pdf["grams"])])
            yield pd.DataFrame({"at": np.arange(total.size), "n": total.ravel().astype(np.int64)})

        out = np.zeros(shape).ravel()
        for r in self.rows.select("lens", "grams").mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            out[r["at"]] = r["n"]
        return out.reshape(shape)


SCORED = "node_id string, n_chars int, subject string, share double, confidence double"


def subject_scores(df: DataFrame, seeds: DataFrame, key: str = "node_id", text: str = "text", sections: int = TRAINING_SECTIONS) -> DataFrame:
    """Rows (node_id, n_chars, subject, share, confidence): for each distinct key and subject with any sentence above its
    threshold, the share of the text's sentences that treat it and their mean probability. A text that treats none has one row
    with a null subject.

    Repeated keys count once (the least text of the key); null keys and null texts give no row; empty texts treat nothing. Other
    columns are ignored. ``sections`` bounds the sample that the gradient is run on (as many again may join it for n-grams it lacks);
    n-grams are counted, thresholds calibrated and subjects scored on all texts.
    """
    once = settle(df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(key).alias("node_id")).agg(F.min(text).alias("body")))
    labelled = [(r["subject"], r["text"]) for r in seeds.select("subject", "text").collect()]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [(node, len(body), *_packed([buckets(w) for w in sentence_words(body)])) for node, body in zip(pdf["node_id"], pdf["body"])]
            yield pd.DataFrame(made, columns=["node_id", "n_chars", "lens", "grams"])

    rows = settle(spread(once).mapInPandas(read, "node_id string, n_chars int, lens binary, grams binary"))
    model = SubjectModel.fit(labelled, SpreadSections(rows, sections))
    shared = df.sparkSession.sparkContext.broadcast((model.subjects, model.weights, model.bias, model.thresholds))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = SubjectModel(*shared.value)
        for pdf in batches:
            sents, lengths = [], []
            for packed in zip(pdf["lens"], pdf["grams"]):
                x = _unpacked(*packed)
                sents += x
                lengths.append(len(x))
            p = own.probabilities(sents)
            out, start = [], 0
            for node, n_chars, n in zip(pdf["node_id"], pdf["n_chars"], lengths):
                part = p[start : start + n]
                start += n
                rows = []
                for k, subject in enumerate(own.subjects):
                    hit = part[:, k] > own.thresholds[k]
                    if n and hit.any():
                        rows.append((node, n_chars, subject, float(hit.mean()), float(part[hit, k].mean())))
                out += rows or [(node, n_chars, None, 0.0, 0.0)]
            yield pd.DataFrame(out, columns=["node_id", "n_chars", "subject", "share", "confidence"])

    return rows.mapInPandas(score, SCORED)


def assigned(scores: DataFrame, least: float = 0.25) -> DataFrame:
    """The subjects treated in at least the given share of a text's sentences."""
    return scores.where(F.col("subject").isNotNull() & (F.col("share") >= least))


def composition(scores: DataFrame, areas: DataFrame, least: float = 0.25) -> DataFrame:
    """Per subject area: texts that treat it, their characters, their share of all texts, and the weight that would even the areas out.

    Every area has a row, also one that no text treats (weight null); the row without a subject counts the texts that treat none.
    """
    total = scores.select(F.countDistinct("node_id")).scalar()
    hits = assigned(scores, least)
    none = scores.select("node_id", "n_chars").distinct().join(hits.select("node_id").distinct(), "node_id", "left_anti").withColumn("subject", F.lit(None).cast("string"))
    counts = hits.select("node_id", "n_chars", "subject").unionByName(none).groupBy("subject").agg(F.count("*").alias("n_texts"), F.sum("n_chars").alias("n_chars"))
    names = areas.select("subject").unionByName(areas.sparkSession.createDataFrame([(None,)], "subject string"))
    n = F.coalesce("n_texts", F.lit(0))
    even = areas.select(F.count("*")).scalar()
    return names.join(counts, names["subject"].eqNullSafe(counts["subject"]), "left").select(
        names["subject"], n.alias("n_texts"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), (n / total).alias("share"),
        F.when(names["subject"].isNotNull() & (n > 0), total / even / n).alias("weight"),
    )
