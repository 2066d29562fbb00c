"""Hashed bag-of-ngram vectors."""

from __future__ import annotations

import re
import zlib

import numpy as np


def hash_tokens(text: str, dim: int) -> np.ndarray:
    """A unit vector (float32) of the text's words and word pairs; zero if it has none."""
    words = re.findall(r"\w+", text.lower())
    out = np.zeros(dim, np.float32)
    for t in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
        h = zlib.crc32(t.encode())
        out[h % dim] += 1 if h >> 31 else -1
    n = np.linalg.norm(out)
    return out / n if n else out
