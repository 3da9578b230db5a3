"""Token counts of whole texts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Place of the vocabulary (ranks); any file of this form may be named instead.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenising pattern published with this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[tuple[str, str], object] = {}


def encoding(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    """The encoder, loaded once per Python worker."""
    import tiktoken

    key = (vocabulary, pattern)
    if key not in _loaded:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[key] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def count_tokens(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, name: str = "tokens") -> DataFrame:
    """Adds the number of tokens of ``text``: null for a null text, 0 for an empty one. Texts are encoded whole."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(vocabulary, pattern)
        for s in batches:
            yield pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in s], dtype="Int64")

    return df.withColumn(name, count(F.col(text)))
