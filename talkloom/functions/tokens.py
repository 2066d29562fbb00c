"""Token counts by a byte-pair vocabulary given as ranks, in Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary's texts are cut before pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str = PATTERN):
    """Once a process; ``path`` is a file of ranks that every executor can read."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """Number of tokens; 0 for null. What looks like a special token is ordinary text. Marked as not deterministic, though it is:
    else a filter on the count is moved below it and each text is counted twice."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path, pattern)
        for texts in batches:
            yield pd.Series([len(e.encode_ordinary(t)) if t else 0 for t in texts], dtype="int32")

    return F.pandas_udf(count, "int").asNondeterministic()(text)
