"""Words, lines and their hashes over whole Arrow batches, in numpy.

A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR, so UTF-8 texts are cut exactly as the
pattern [^\\x20\\x09-\\x0D]+ cuts them. All functions work on many texts at once: one byte buffer plus offsets.
Hashes are 64-bit and the same in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 20


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)


BYTE_CODE = _random(256, 11)
STEP = U(0x9E3779B97F4A7C15)
NGRAM_STEP = _random(64, 12)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about limit bytes; null counts as empty. A longer
    text is a run of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at the offsets of the texts."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    start[full] = inside[full]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    end[last] = inside[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the number of its first word (one more at the end)."""
    starts, ends = _runs(~IS_SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans ascend, don't overlap and aren't empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(first, lens)
    power = np.cumprod(np.full(int(lens.max()), STEP, np.uint64))
    value = BYTE_CODE[data[place + np.repeat(starts, lens)]] * power[place]
    return mix(np.add.reduceat(value, first) + lens.astype(np.uint64))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values, by its first; the last n - 1 places have none."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size = len(h) - n + 1
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out += h[j : j + size] * NGRAM_STEP[j]
    return mix(out)


def inside_text(bounds: np.ndarray, n: int, total: int) -> np.ndarray:
    """For each of the runs of ngram_hashes: does it lie in one text?"""
    size = max(0, total - n + 1)
    ok = np.ones(size, bool)
    for j in range(1, n):
        cut = bounds[1:-1] - j
        cut = cut[(cut >= 0) & (cut < size)]
        ok[cut] = False
    return ok


def text_of(bounds: np.ndarray) -> np.ndarray:
    """The text number of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def char_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points in each span."""
    total = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return total[ends] - total[starts]
