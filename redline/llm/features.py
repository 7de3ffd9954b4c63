"""Sparse hashed text features, for many texts at once.

A feature word is a maximal run of letters, digits and non-ASCII bytes, or of other visible characters, so marks glued
to words are words of their own. Features are runs of 1 .. max_n feature words of one text, hashed to 2**bits places; a word
that repeats the one before it, or the one before that, also counts at place 0.
"""

from __future__ import annotations

import numpy as np

from redline.llm import words as W

_KIND = np.full(256, 2, np.uint8)
_KIND[128:] = 1
for _first, _last in ((48, 58), (65, 91), (97, 123)):
    _KIND[_first:_last] = 1
_KIND[W.IS_SPACE] = 0


def feature_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the feature words, and the first feature word of each text (one more at the end)."""
    kind = _KIND[data]
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.ones(len(kind) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    starts, ends = cut[:-1], cut[1:]
    seen = kind[starts] > 0
    starts, ends = starts[seen], ends[seen]
    return starts, ends, np.searchsorted(starts, offsets)


def hashed(data: np.ndarray, offsets: np.ndarray, bits: int, max_n: int, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, count) of each feature of each text, by text and place."""
    if lower:
        data = W.LOWER[data]
    starts, ends, bounds = feature_words(data, offsets)
    h = W.span_hashes(data, starts, ends)
    text = W.text_of(bounds)
    keys = []
    for n in range(1, max_n + 1):
        at = np.flatnonzero(W.inside_text(bounds, n, len(h)))
        place = (h if n == 1 else W.ngram_hashes(h, n))[at] >> W.U(64 - bits)
        keys.append(text[at].astype(np.int64) << bits | place.astype(np.int64))
        if n == 2:
            keys.append(text[at[h[at] == h[at + 1]]].astype(np.int64) << bits)
            far = np.flatnonzero(W.inside_text(bounds, 3, len(h)))
            keys.append(text[far[h[far] == h[far + 2]]].astype(np.int64) << bits)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), count
