"""Vectors as array<double>, and the embedding provider.

An embedder is any function from a list of texts to a matrix; :func:`embed` runs it over Arrow batches, loading it once per worker.
The default needs no model: signed feature hashing of words, whose components are whole numbers and so sum exactly in any order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from archiveloom.session import ship

DIMENSIONS = 64
_WORD = regex.compile(r"[\p{L}\p{N}]+")


@lru_cache(maxsize=500_000)
def _slot(word: str) -> tuple[int, int]:
    h = int(hashlib.md5(word.encode()).hexdigest()[:4], 16)
    return h % DIMENSIONS, 1 - 2 * ((h // DIMENSIONS) % 2)


def hashed(texts: list[str]) -> np.ndarray:
    """Signed counts of the hashed words of each text. A text without words is the zero vector."""
    out = np.zeros((len(texts), DIMENSIONS))
    for i, t in enumerate(texts):
        row = out[i]
        for w in _WORD.findall(t.lower()):
            at, sign = _slot(w)
            row[at] += sign
    return out


#: The vector of several texts together is the sum of their vectors; an embedder without this mark isn't taken for additive.
hashed.additive = True

Embedder = Callable[[list[str]], np.ndarray]

EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hashed": lambda: hashed}


def register_embedder(name: str, loader: Callable[[], Embedder]) -> None:
    """Names a loader of an embedder, so that strategies can be told which to use by name."""
    if not name:
        raise ValueError("an embedder needs a name")
    EMBEDDERS[name] = loader


def embedder(name: str) -> Callable[[], Embedder]:
    """The loader of a registered embedder."""
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder {name!r}; known: {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[name]


def embed(text: Column, loader: Callable[[], Embedder] = lambda: hashed) -> Column:
    """The vector of each text (null for null). ``loader`` is called once per worker and gives the embedder."""
    ship()

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader()
        for batch in batches:
            there = batch.notna()
            vectors = iter(model(batch[there].tolist()))
            yield pd.Series([next(vectors) if x else None for x in there], index=batch.index, dtype=object)

    return run(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).when(size == 0, F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x - y)
    return F.sqrt(dot(d, d))
