"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archiveloom.session import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer parts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[int, object] = {}


def encoding(ranks: bytes):
    """The tokenizer of a file of ranks, loaded once per worker process."""
    import tiktoken

    key = zlib.crc32(ranks)
    if key not in _loaded:
        _loaded[key] = tiktoken.Encoding(f"ranks-{key}", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    return _loaded[key]


def token_sizes(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows (key, *keep, tokens) for every text that isn't null; an empty text has 0 tokens.

    The tokenizer's file is read by the driver and broadcast (it has a fixed size); special tokens in a text are ordinary text.
    """
    with open(tokenizer, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    columns = [F.col(key), *[F.col(c) for c in keep]]
    rows = spread(df.where(F.col(text).isNotNull()).select(*columns, F.col(text).alias("__body")))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            enc = encoding(ranks.value)
            yield pdf.drop(columns="__body").assign(tokens=[len(enc.encode_ordinary(t)) for t in pdf["__body"]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__body") + ", tokens bigint"
    return rows.mapInPandas(measure, schema)
