"""Vectorised tokenising and hashing of many UTF-8 texts at once.

Works on bytes: every separator and letter that the word rules name is ASCII,
and all bytes of other characters are 0x80 or above.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64 (fixed public constants)."""
    with np.errstate(over="ignore"):
        x = x + U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def byte_table(is_word) -> np.ndarray:
    """256 entries: the byte with A-Z lower-cased, 0 for bytes that separate words."""
    out = np.zeros(256, np.uint8)
    for b in range(1, 256):
        low = b + 32 if 65 <= b <= 90 else b
        if is_word(low):
            out[b] = low
    return out


#: Words of letters, digits and all that isn't ASCII.
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Words between white space.
SPACED = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))


class Words:
    """The words of a list of texts: ``hash`` (64 bits each), ``doc`` (index of its text), ``length`` in bytes."""

    def __init__(self, texts: list[bytes], table: np.ndarray = ALNUM):
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        mapped = table[raw]
        inside = mapped != 0
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.raw = raw
        self.length = (self.end - self.start).astype(np.int64)
        self.doc = np.searchsorted(np.cumsum(sizes), self.start, side="right").astype(np.int64)
        self.n_docs = len(texts)
        body = mapped[inside]
        first = np.cumsum(self.length) - self.length
        self.hash = _hash(body, first, self.length)
        self._body, self._first = body, first

    def prefixes(self, sizes: tuple[int, ...]):
        """For each size of at most 8 bytes: which words are longer, and the hashes of their first bytes."""
        head = np.zeros(len(self._first), np.uint64)
        last = max(0, len(self._body) - 1)
        for k in range(max(sizes)):
            if len(head):
                head |= self._body[np.minimum(self._first + k, last)].astype(np.uint64) << U(8 * k)
            if k + 1 in sizes:
                longer = self.length > k + 1
                yield longer, mix64(head[longer] + U((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))

    def per_doc(self, weights=None) -> np.ndarray:
        return np.bincount(self.doc, weights, self.n_docs)


def _hash(body: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A multilinear hash of body[first : first + length] each; the top bit is always set."""
    if not len(first):
        return np.zeros(0, np.uint64)
    total = int(length.sum())
    begin = np.cumsum(length) - length
    within = (np.arange(total, dtype=np.int64) - np.repeat(begin, length)).astype(np.int32)
    keys = mix64(np.arange(int(length.max()), dtype=np.uint64)) | U(1)
    chosen = body if total == len(body) else body[np.repeat(first, length) + within]
    with np.errstate(over="ignore"):
        out = np.add.reduceat(chosen.astype(np.uint64) * keys[within], begin)
        return mix64(out) | U(1 << 63)


def blocks(texts: list[bytes], limit: int):
    """Slices of ``texts`` of about ``limit`` bytes, a longer text by itself."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]


def as_bytes(column) -> list[bytes]:
    """Texts of a pandas column as UTF-8; null counts as empty."""
    return [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b"" for x in column]
