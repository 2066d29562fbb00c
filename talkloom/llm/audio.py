"""Chroma audio fingerprints of a media column, and alignment of recordings by offset histograms and bit errors.

A recording is cut into overlapping frames (``FRAME`` samples, a third of that apart, at ``RATE`` Hz); the power of each
frame's spectrum is summed into twelve pitch classes, smoothed over time and normalised. Sixteen rectangle filters,
evaluated on an integral image of those rows, are each quantised to two bits (Gray code): one packed 32-bit integer a frame.

Recordings with equal fingerprints are one class; only classes are indexed and searched. Every integer of every class is
indexed. Two classes are linked if at some offset the share of wrong bits over their overlap is ``MAX_ERROR`` or less; the
overlap is ``MIN_OVERLAP`` integers at least, or the whole of a fingerprint that has fewer, and ``MIN_SHARE`` of the shorter one.
The offset with fewest errors stands for the pair.

No link is lost. Classes that ask meet all classes in blocks of some ``BLOCK_INTEGERS`` integers a side (a stated query set
against all rows: shuffled rows are those of all classes once per block that asks). In a block the integers held are filed under two parts of
their bits (``PARTS``); one of ``MAX_WRONG`` (4) wrong bits or fewer has 2 at most in the first part or 1 at most in the second, so a query's integer is
compared only with what stands under those values, some hundredth of the block. What is left still grows as queries times rows. Hits are counted by class and
offset (the offset histogram). At a share of 0.15 an overlap of n integers has n * ``LEAST_VOTES`` hits at least, as all others have 5 wrong
bits or more; the bit errors at each such offset decide. Only links leave a block (``align``, ``op1``: a row each), or their number and
the best one of each class that asks (``summed``, ``op1_turns``, which the query registers: a row per turn).

Media: 16-bit WAV bytes of any rate and channels, or a text played as a score: each word is a tone of ``NOTE`` samples whose pitch is hashed from
the word. Samples are made or decoded a block of frames at a time, so a recording of any length needs little memory, and
audio is never stored or shuffled. ``conversations`` has no recordings: its turns are the scores.

Defined cases: null and empty media, and bytes that are no 16-bit WAV file, have an empty fingerprint, no class and no links; recordings shorter than a frame or
than the filters are padded with silence; rows that repeat an id are reported each; rows without conv_id are indexed but
never queries.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.sources.scratch import cut

RATE, FRAME, HOP = 11025, 4096, 1365
NOTE = 512
LOWEST, HIGHEST = 110.0, 3520.0
PITCHES = 36
#: Frames decoded at once and transformed at once; recordings, and rows of them, that pass the filters together.
BLOCK, AT_ONCE, RECORDINGS, ROWS = 128, 16, 512, 2048
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: Kind, first pitch class, pitch classes, frames; kinds are how the rectangle's halves or quarters or thirds are compared.
FILTERS = [(kind, (5 * i + 3) % (9 - i % 3 * 2), 4 + i % 3 * 2, 3 * (1 + i % 4)) for i, kind in enumerate([0, 1, 2, 3, 4, 5, 1, 2, 3, 1, 2, 4, 5, 3, 1, 2])]
WIDTH = max(f[3] for f in FILTERS)
#: Bounds of the four levels of the log-ratio of a filter's two sums, about its value on rows of equal shares.
LEVELS = (-0.15, 0.0, 0.15)
GRAY = np.array([0, 1, 3, 2], np.uint32)
MAX_ERROR, MIN_OVERLAP, MIN_SHARE = 0.15, 4, 0.5
#: Most wrong bits of the best integer of an overlap, and the least share of integers with so few.
MAX_WRONG = int(32 * MAX_ERROR)
LEAST_VOTES = 1 - 32 * MAX_ERROR / (MAX_WRONG + 1)
QUERY_EVERY = 50
BLOCK_INTEGERS = 1 << 18
MOST_HITS, KEYS_AT_ONCE, HELD_AT_ONCE = 1 << 16, 256, 1 << 16


def _pitch_matrix() -> np.ndarray:
    """2049 x 12: the pitch class of each bin of the spectrum."""
    freq = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(freq), 12), np.float32)
    on = (freq >= LOWEST) & (freq <= HIGHEST)
    out[np.flatnonzero(on), np.round(12 * np.log2(freq[on] / 440.0)).astype(int) % 12] = 1
    return out


PITCH = _pitch_matrix()
WINDOW = np.hamming(FRAME).astype(np.float32)


def _tones() -> np.ndarray:
    t = np.arange(NOTE) / RATE
    envelope = np.sin(np.pi * (np.arange(NOTE) + 0.5) / NOTE) ** 0.5
    freq = 220.0 * 2 ** (np.arange(PITCHES) / 12)
    return (envelope * (np.sin(2 * np.pi * freq[:, None] * t) + 0.3 * np.sin(4 * np.pi * freq[:, None] * t))).astype(np.float32)


TONES = _tones()


class Score:
    """A text as samples."""

    def __init__(self, text: str):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        self.notes = np.fromiter((zlib.crc32(w) % PITCHES for w in words), np.int64, len(words))
        self.size = NOTE * len(words)

    def samples(self, lo: int, hi: int) -> np.ndarray:
        first = lo // NOTE
        return TONES[self.notes[first : -(-hi // NOTE)]].reshape(-1)[lo - first * NOTE : hi - first * NOTE]


class Wav:
    """A RIFF file of 16-bit samples; channels are averaged and other rates brought to RATE by straight lines between samples."""

    def __init__(self, data: bytes):
        channels, rate, bits, self.pcm, at = 0, 0, 0, np.zeros(0, np.float32), 12
        while data[:4] == b"RIFF" and data[8:12] == b"WAVE" and at + 8 <= len(data):
            kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            body = data[at + 8 : at + 8 + size]
            if kind == b"fmt " and len(body) >= 16:
                channels, rate, bits = (int.from_bytes(body[i:j], "little") for i, j in ((2, 4), (4, 8), (14, 16)))
            elif kind == b"data" and bits in (0, 16):
                width = max(1, channels)
                samples = np.frombuffer(body[: len(body) // (2 * width) * 2 * width], "<i2").reshape(-1, width)
                self.pcm = samples[:, 0] if width == 1 else samples.mean(1)
                break
            at += 8 + size + size % 2
        self.step = (rate or RATE) / RATE
        self.size = int(len(self.pcm) / self.step)

    def samples(self, lo: int, hi: int) -> np.ndarray:
        if self.step == 1:
            return self.pcm[lo:hi].astype(np.float32) / 32768
        first = int(lo * self.step)
        part = self.pcm[first : int(hi * self.step) + 2]
        return (np.interp(np.arange(lo, hi) * self.step - first, np.arange(len(part)), part) / 32768).astype(np.float32)


class Spectra:
    """Powers of frames by pitch class, in arrays that are used again: fresh ones of this size cost more than the transform."""

    def __init__(self):
        self.frames = np.empty((AT_ONCE, FRAME), np.float32)
        self.spectrum = np.empty((AT_ONCE, FRAME // 2 + 1), np.complex64)
        self.power, self.other = (np.empty((n, FRAME // 2 + 1), np.float32) for n in (BLOCK, AT_ONCE))

    def of(self, media) -> np.ndarray:
        """Rows of twelve sums, one a frame."""
        frames = max(1, (media.size - FRAME) // HOP + 1)
        out = np.empty((frames, 12))
        for k in range(0, frames, BLOCK):
            n = min(BLOCK, frames - k)
            lo, hi = k * HOP, (k + n - 1) * HOP + FRAME
            x = media.samples(lo, min(hi, media.size))
            if len(x) < hi - lo:
                x = np.pad(x, (0, hi - lo - len(x)))
            views = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
            for i in range(0, n, AT_ONCE):
                m = min(AT_ONCE, n - i)
                windowed, spectrum, power, other = self.frames[:m], self.spectrum[:m], self.power[i : i + m], self.other[:m]
                np.multiply(views[i : i + m], WINDOW, out=windowed)
                np.fft.rfft(windowed, out=spectrum)
                np.square(spectrum.real, out=power)
                np.square(spectrum.imag, out=other)
                np.add(power, other, out=power)
            out[k : k + n] = self.power[:n] @ PITCH
        return out


def chroma(powers: np.ndarray, frames: np.ndarray) -> np.ndarray:
    """Rows of twelve shares, smoothed over time: of recordings of so many frames, each padded with rows of zeros."""
    own = np.arange(powers.shape[1]) < frames[:, None]
    wide = np.pad(powers, ((0, 0), (2, 2), (0, 0)))
    smooth = sum(SMOOTH[k] * wide[:, k : k + powers.shape[1]] for k in range(len(SMOOTH)))
    smooth = np.where((frames >= len(SMOOTH))[:, None, None], smooth, powers)
    norm = np.sqrt((smooth**2).sum(2, keepdims=True))
    return np.where((norm > 1e-6) & own[:, :, None], smooth / np.maximum(norm, 1e-6), 0)


def packed(rows: np.ndarray) -> np.ndarray:
    """32-bit integers of rows of pitch classes of some recordings, one for each place of a window of WIDTH rows."""
    out = np.zeros((len(rows), rows.shape[1] - WIDTH + 1), np.uint32)
    for i, ratio in enumerate(log_ratios(rows)):
        level = sum((ratio - CENTRE[i] > x).astype(np.int64) for x in LEVELS)
        out |= GRAY[level] << np.uint32(2 * i)
    return out


def log_ratios(rows: np.ndarray):
    """The value of each filter at all places of its window, for some recordings."""
    places = rows.shape[1] - WIDTH + 1
    total = np.zeros((13, len(rows), rows.shape[1] + 1))
    total[1:, :, 1:] = np.moveaxis(rows.cumsum(1).cumsum(2), 2, 0)

    def area(t0, t1, p0, p1):
        to, since = slice(t1, t1 + places), slice(t0, t0 + places)
        return total[p1, :, to] - total[p1, :, since] - total[p0, :, to] + total[p0, :, since]

    for kind, p, h, w in FILTERS:
        q, m, v = p + h, p + h // 2, w // 2
        whole = area(0, w, p, q)
        if kind == 0:
            a, b = whole, area(0, w, 0, 12) - whole
        elif kind == 1:
            a = area(0, w, m, q)
            b = whole - a
        elif kind == 2:
            a = area(v, w, p, q)
            b = whole - a
        elif kind == 3:
            a = area(0, v, m, q) + area(v, w, p, m)
            b = whole - a
        elif kind == 4:
            a = area(0, w, p + h // 3, q - h // 3)
            b = whole - a
        else:
            a = area(w // 3, w - w // 3, p, q)
            b = whole - a
        yield np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0))


CENTRE = [float(x[0, 0]) for x in log_ratios(np.full((1, WIDTH, 12), 12**-0.5))]


def fingerprints(recordings: Iterable) -> Iterator[np.ndarray]:
    """The fingerprint of each recording. Small arrays cost more to handle than to fill, so recordings of like lengths go through the filters together."""
    spectra, rest = Spectra(), iter(recordings)
    while some := [spectra.of(media) if media is not None and media.size else np.zeros((0, 12)) for media in itertools.islice(rest, RECORDINGS)]:
        out, frames = [np.zeros(0, np.int32)] * len(some), np.array([len(x) for x in some])
        order = [int(i) for i in np.argsort(frames, kind="stable") if frames[i]]
        while order:
            # the longest ones that are left, as many as fill ROWS
            length = max(WIDTH, int(frames[order[-1]]))
            many = max(1, ROWS // length)
            order, group = order[:-many], order[-many:]
            powers = np.zeros((len(group), length, 12))
            for k, i in enumerate(group):
                powers[k, : frames[i]] = some[i]
            integers = packed(chroma(powers, frames[group])).view(np.int32)
            for k, i in enumerate(group):
                out[i] = integers[k, : max(1, frames[i] - WIDTH + 1)].copy()
        yield from out


def fingerprint(media) -> np.ndarray:
    return next(fingerprints([media]))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def score_print(texts: pd.Series) -> pd.Series:
    return pd.Series(list(fingerprints(Score(t) if isinstance(t, str) else None for t in texts)), dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def wav_print(media: pd.Series) -> pd.Series:
    return pd.Series(list(fingerprints(Wav(bytes(b)) if b is not None and len(b) else None for b in media)), dtype=object)


def _prints(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Integers of all fingerprints one after the other, and where each begins (one more at the end)."""
    column = t.column("print").combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32)
    return values, np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _near(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits with ``radius`` bits set or fewer."""
    return np.array([sum(1 << i for i in c) for k in range(radius + 1) for c in itertools.combinations(range(width), k)], np.int64)


#: Parts of an integer: first bit, bits, the most wrong bits looked up there, and the numbers that differ by so many. With MAX_WRONG bits wrong, one part has no more than those.
PARTS = [(14, 18, 2, _near(18, 2)), (0, 14, MAX_WRONG - 3, _near(14, MAX_WRONG - 3))]


def _filed(b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Integers in the order of each of PARTS: their places, where each value of the part begins, and the integers."""
    out = []
    for first, width, _, _ in PARTS:
        part = (b >> np.uint32(first) & np.uint32((1 << width) - 1)).astype(np.int32)
        order = np.argsort(part, kind="stable").astype(np.int32)
        out.append((order, np.concatenate([[0], np.cumsum(np.bincount(part, minlength=1 << width))]), b[order]))
    return out


def _hits(a: np.ndarray, filed: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Places in a and in the integers ``filed`` of all pairs with MAX_WRONG wrong bits or fewer, each once, some at a time."""
    for k, ((first, width, _, near), (order, begins, b)) in enumerate(zip(PARTS, filed)):
        # some integers at a time, so that keys and what stands under them stay small
        for j in range(0, len(a), KEYS_AT_ONCE):
            own = a[j : j + KEYS_AT_ONCE]
            keys = (own >> np.uint32(first) & np.uint32((1 << width) - 1)).astype(np.int64)[:, None] ^ near
            low = begins[keys]
            size = begins[keys + 1] - low
            many, i = size.sum(1), 0
            ends = np.cumsum(many)
            while i < len(own):
                stop = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + HELD_AT_ONCE, "right")))
                on = np.flatnonzero(size[i:stop])
                n, at = size[i:stop].ravel()[on], low[i:stop].ravel()[on]
                at = np.arange(n.sum()) + np.repeat(at - (np.cumsum(n) - n), n)
                who = np.repeat(np.arange(i, stop, dtype=np.int32), many[i:stop])
                differ = b[at] ^ own[who]
                v = np.flatnonzero(np.bitwise_count(differ) <= MAX_WRONG)
                if k:
                    # those that the first part has found
                    v = v[np.bitwise_count(differ[v] >> np.uint32(PARTS[0][0])) > PARTS[0][2]]
                if len(v):
                    yield who[v].astype(np.int64) + j, order[at[v]]
                i = stop


def _histogram(a: np.ndarray, filed: list, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hits of a's integers in those ``filed`` by class and offset in one number, where a would begin: at ``begin`` of the integer hit less its
    place in a; and how many each has."""
    keys, held, key, votes = [np.zeros(0, np.int64)], 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def folded():
        more, many = np.unique(np.concatenate(keys), return_counts=True)
        if not len(key):
            return more, many
        both, at = np.unique(np.concatenate([key, more]), return_inverse=True)
        return both, np.bincount(at, np.concatenate([votes, many]), len(both)).astype(np.int64)

    for i, v in _hits(a, filed):
        keys.append(begin[v] - i)
        held += len(v)
        if held > MOST_HITS:
            (key, votes), keys, held = folded(), [], 0
    return folded() if keys else (key, votes)


def _wrong_bits(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Wrong bits of overlaps of n integers from these places on."""
    out, ends, i = np.zeros(len(n), np.int64), np.cumsum(n), 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + MOST_HITS)))
        first = np.cumsum(n[i:j]) - n[i:j]
        step = np.arange(n[i:j].sum()) - np.repeat(first, n[i:j])
        differ = a[np.repeat(at_a[i:j], n[i:j]) + step] ^ b[np.repeat(at_b[i:j], n[i:j]) + step]
        out[i:j] = np.add.reduceat(np.bitwise_count(differ).astype(np.int64), first)
        i = j
    return out


def _found(asked: pa.Table, held: pa.Table) -> Iterator[np.ndarray]:
    """Links of each of the classes ``asked`` with those ``held``: rows of q, r, offset, n, wrong bits."""
    (a, a0), (b, b0) = _prints(asked), _prints(held)
    if not len(b):
        return
    size = np.diff(b0)
    filed, longest = _filed(b), int(np.diff(a0).max(initial=0))
    # offsets of a class are numbers of their own: span of them, from one where the longest that asks begins before it
    span = longest + int(size.max()) + 1
    begins = np.repeat(np.arange(len(size)) * span - b0[:-1] + longest, size) + np.arange(len(b))
    for q in range(len(a0) - 1):
        m = int(a0[q + 1] - a0[q])
        key, votes = _histogram(a[a0[q] : a0[q + 1]], filed, begins)
        r = key // span
        offset = key - r * span - longest
        begin = np.maximum(0, -offset)
        n, shorter = np.minimum(m, size[r] - offset) - begin, np.minimum(m, size[r])
        on = np.flatnonzero((n >= np.minimum(shorter, MIN_OVERLAP)) & (n >= MIN_SHARE * shorter) & (votes >= n * LEAST_VOTES - 1e-9))
        r, offset, begin, n, votes = (x[on] for x in (r, offset, begin, n, votes))
        wrong = _wrong_bits(a, b, a0[q] + begin, b0[r] + begin + offset, n)
        on = np.flatnonzero(wrong <= MAX_ERROR * 32 * n)
        # of the offsets that align two classes the one with fewest errors stands for them
        on = on[np.lexsort((offset[on], np.abs(offset[on]), -votes[on], wrong[on] / n[on], r[on]))]
        on = on[np.unique(r[on], return_index=True)[1]]
        yield np.stack([np.full(len(on), q), r[on], offset[on], n[on], wrong[on]])


def _links(asked: pa.Table, held: pa.Table) -> np.ndarray:
    """All of ``_found``."""
    return np.concatenate([np.zeros((5, 0), np.int64), *_found(asked, held)], 1)


LINK = "qk1 long, qk2 long, rk1 long, rk2 long, offset int, n int, error double"


def _table_of(asked: pa.Table, held: pa.Table, links: np.ndarray) -> pa.Table:
    q, r, offset, n, wrong = links
    ids = {x + k: t.column(k).combine_chunks().take(pa.array(at)) for x, t, at in (("q", asked, q), ("r", held, r)) for k in ("k1", "k2")}
    return pa.table(ids | {"offset": offset.astype(np.int32), "n": n.astype(np.int32), "error": wrong / np.maximum(1, n * 32.0)})


def _block(asked: pa.Table, held: pa.Table) -> pa.Table:
    """A row per link of the classes ``asked`` with those ``held``."""
    return _table_of(asked, held, _links(asked, held))


def _counts(asked: pa.Table, held: pa.Table) -> pa.Table:
    """A row per class ``asked``: the number of its links with those ``held``, other than itself, and the best of them."""
    (a1, a2), (b1, b2) = ([t.column(k).to_numpy() for k in ("k1", "k2")] for t in (asked, held))
    best, many = [np.zeros((5, 0), np.int64)], []
    for links in _found(asked, held):
        q, r = links[0], links[1]
        links = links[:, (a1[q] != b1[r]) | (a2[q] != b2[r])]
        if links.shape[1]:
            _, r, _, n, wrong = links
            first = np.lexsort((b2[r], b1[r], -n, wrong / n))[:1]
            best.append(links[:, first])
            many.append(links.shape[1])
    return _table_of(asked, held, np.concatenate(best, 1)).append_column("n_links", pa.array(many, pa.int64()))


def classes_of(prints: DataFrame) -> DataFrame:
    """One row per fingerprint of ``prints`` (conv_id, turn, print, k1, k2) that isn't empty: k1, k2, rep (its smallest conv_id and turn), asks, print."""
    query = F.coalesce(F.col("conv_id") % QUERY_EVERY == 0, F.lit(False))
    named = F.min_by(F.struct("conv_id", "turn"), F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "turn"))
    return prints.where(F.size("print") > 0).groupBy("k1", "k2").agg(named.alias("rep"), F.bool_or(query).alias("asks"), F.first("print").alias("print"))


def _met(classes: DataFrame, block: int, take, schema: str) -> DataFrame:
    """What ``take`` makes of each block of classes that ask and of classes that are held; all of them meet."""
    size = F.size("print").cast("long")
    n, asking = classes.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(F.col("asks"), size)), F.lit(0))).first()
    parts = {"_r": max(1, -(-n // block)), "_q": max(1, -(-asking // block))}

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod("k1", F.lit(parts[own])).cast("int").alias(own)
        return df.select(F.col("k1").alias("k1"), F.col("k2").alias("k2"), F.col("print").alias("print"), mine, F.explode(F.sequence(F.lit(0), F.lit(parts[other] - 1))).alias(other))

    a, b = dealt(classes.where("asks"), "_q", "_r"), dealt(classes, "_r", "_q")
    return a.groupBy("_q", "_r").cogroup(b.groupBy("_q", "_r")).applyInArrow(take, schema)


def linked(classes: DataFrame, block: int = BLOCK_INTEGERS) -> DataFrame:
    """(qk1, qk2, rk1, rk2, offset, n, error) of all pairs of a class that asks and another one that align."""
    return _met(classes, block, _block, LINK).where("qk1 != rk1 or qk2 != rk2")


def counted(classes: DataFrame, block: int = BLOCK_INTEGERS) -> DataFrame:
    """(k1, k2, n_links, best) of each class that asks and has links: their number, all counted, and the one with fewest errors (of
    equal ones the longer one, then that of the smaller hash)."""
    met = _met(classes, block, _counts, LINK + ", n_links long")
    best = F.min(F.struct("error", (-F.col("n")).alias("less"), "rk1", "rk2", "offset", "n"))
    return met.groupBy(F.col("qk1").alias("k1"), F.col("qk2").alias("k2")).agg(F.sum("n_links").alias("n_links"), best.alias("best"))


def align(prints: DataFrame, block: int = BLOCK_INTEGERS) -> DataFrame:
    """Each row of ``prints`` (conv_id, turn, print) once: class_conv, class_turn, n_frames, is_query; and the row that names a class
    with a query in it once per class that aligns with it, its links: link_conv, link_turn, offset, n, error, and their number n_links.
    Other rows have nulls there."""
    # classes by two hashes of the fingerprint: the fingerprint itself is no key
    keys = [F.xxhash64("print").alias("k1"), F.xxhash64(F.lit("print"), "print").alias("k2")]
    prints = cut(prints.select("*", *keys), "audio-prints")
    classes = cut(classes_of(prints), "audio-classes")
    pairs = cut(linked(classes, block), "audio-pairs")
    ids = classes.select(F.col("k1").alias("rk1"), F.col("k2").alias("rk2"), F.col("rep.conv_id").alias("link_conv"), F.col("rep.turn").alias("link_turn"))
    rounded = F.round("error", 4).alias("error")
    links = pairs.join(ids, ["rk1", "rk2"]).select(F.col("qk1").alias("k1"), F.col("qk2").alias("k2"), F.lit(True).alias("first"), "link_conv", "link_turn", "offset", "n", rounded)
    n_links = pairs.groupBy(F.col("qk1").alias("k1"), F.col("qk2").alias("k2")).agg(F.count("*").alias("n_links"))
    named = classes.select("k1", "k2", "rep").join(n_links, ["k1", "k2"], "left")
    query = F.coalesce(F.col("conv_id") % QUERY_EVERY == 0, F.lit(False))
    first = (F.col("conv_id").eqNullSafe(F.col("rep.conv_id"))) & (F.col("turn").eqNullSafe(F.col("rep.turn")))
    out = prints.join(named, ["k1", "k2"], "left").select(
        "k1", "k2", first.alias("first"), "conv_id", "turn", F.size("print").cast("long").alias("n_frames"), F.col("rep.conv_id").alias("class_conv"), F.col("rep.turn").alias("class_turn"), query.alias("is_query"),
        F.when(first, F.col("n_links")).alias("n_links"),
    )
    return out.join(links, ["k1", "k2", "first"], "left").drop("k1", "k2", "first")


def summed(prints: DataFrame, block: int = BLOCK_INTEGERS) -> DataFrame:
    """Each row of ``prints`` (conv_id, turn, print) once, and one row for each: class_conv, class_turn, n_frames, is_query, and of a class with
    a query in it n_links, the number of classes that align with it (0 too), and the best of them: link_conv, link_turn, offset, n, error.

    The links are those of ``align``, each counted where it is found: their number grows with queries times rows, that of the rows doesn't."""
    keys = [F.xxhash64("print").alias("k1"), F.xxhash64(F.lit("print"), "print").alias("k2")]
    prints = cut(prints.select("*", *keys), "audio-prints")
    classes = cut(classes_of(prints), "audio-classes")
    counts = cut(counted(classes, block), "audio-counts")
    ids = classes.select(F.col("k1").alias("rk1"), F.col("k2").alias("rk2"), F.col("rep").alias("link"))
    best = counts.select("k1", "k2", "n_links", "best.*").join(ids, ["rk1", "rk2"]).select("k1", "k2", "n_links", "link", "offset", "n", F.round("error", 4).alias("error"))
    named = classes.select("k1", "k2", "rep", "asks").join(best, ["k1", "k2"], "left")
    query = F.coalesce(F.col("conv_id") % QUERY_EVERY == 0, F.lit(False))
    return prints.join(named, ["k1", "k2"], "left").select(
        "conv_id", "turn", F.size("print").cast("long").alias("n_frames"), F.col("rep.conv_id").alias("class_conv"), F.col("rep.turn").alias("class_turn"), query.alias("is_query"),
        F.when(F.col("asks"), F.coalesce("n_links", F.lit(0))).alias("n_links"), F.col("link.conv_id").alias("link_conv"), F.col("link.turn").alias("link_turn"), "offset", "n", "error",
    )


def op1(turns: DataFrame) -> DataFrame:
    """The class of every turn's fingerprint, and the classes that align with it (see ``align``); queries are all conv_id divisible by 50."""
    return align(turns.select("conv_id", "turn", score_print("text").alias("print")))


def op1_turns(turns: DataFrame) -> DataFrame:
    """One row per turn: the class of its fingerprint, and the number and the best of the links of a class with a query in it (see ``summed``)."""
    return summed(turns.select("conv_id", "turn", score_print("text").alias("print")))
