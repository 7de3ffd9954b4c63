"""Quality rules by repetition coverage.

Rolling hashes of several word n-gram lengths measure which characters of a text lie inside n-grams that occur twice
or more in it, and inside repeated lines. A text is rejected where the share of such characters passes a limit.

Defined results: a null or empty text, or one of white space, has zero counts and fails the base rule; the row stays,
with its doc_id as it is (null too). Repeated rows are judged each for itself. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from redline.llm import words as W

#: Longest share of word characters that may lie in repeated n-grams of each length, and in repeated lines.
NGRAM_LIMITS = {5: 0.35, 6: 0.32, 8: 0.28, 10: 0.25}
LINE_LIMIT = 0.30
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_WORDS_PERCENT = 50
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_chars long, {ngrams}, base_failed boolean, kept boolean"
)


def _in_text_groups(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: does it occur again in its text; did it occur before there?"""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((key, text))
    k, t = key[order], text[order]
    same = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
    before = np.concatenate([[False], same])
    again = before | np.concatenate([same, [False]])
    out = np.empty((2, len(key)), bool)
    out[0][order], out[1][order] = again, before
    return out[0], out[1]


def covered_words(h: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """Words inside an n-word window whose words occur twice or more in the text."""
    grams, ok = W.ngram_hashes(h, n), W.inside_text(bounds, n, len(h))
    at = np.flatnonzero(ok)
    again, _ = _in_text_groups(grams[at], W.text_of(bounds)[at])
    step = np.zeros(len(h) + 1, np.int64)
    hit = at[again]
    np.add.at(step, hit, 1)
    np.add.at(step, hit + n, -1)
    return np.cumsum(step)[:-1] > 0


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the non-empty lines between LF; a line keeps its white space."""
    return W._runs(data != 10, offsets)


def measure(data: np.ndarray, offsets: np.ndarray, ngram_limits: dict[int, float], line_limit: float) -> dict[str, np.ndarray]:
    texts = len(offsets) - 1
    starts, ends, bounds = W.word_spans(data, offsets)
    h = W.span_hashes(data, starts, ends)
    chars = W.char_counts(data, starts, ends)
    text = W.text_of(bounds)
    per_text = lambda values, of: np.bincount(of, values, texts).astype(np.int64)
    out = {"n_words": np.diff(bounds).astype(np.int64), "word_chars": per_text(chars, text)}
    symbol = np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8))
    total = np.concatenate([[0], np.cumsum(symbol)])
    out["n_symbols"] = total[offsets[1:]] - total[offsets[:-1]]

    line_start, line_end = _lines(data, offsets)
    first, last = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    full = last > first
    line_start, line_end, first, last = line_start[full], line_end[full], first[full], last[full]
    line_text = np.searchsorted(offsets, line_start, "right") - 1
    _, before = _in_text_groups(W.span_hashes(data, line_start, line_end), line_text)
    out["n_dup_lines"] = per_text(before, line_text)
    sums = np.concatenate([[0], np.cumsum(chars)])
    out["dup_line_chars"] = per_text((sums[last] - sums[first]) * before, line_text)

    out["n_repeat_words"] = per_text(covered_words(h, bounds, 3), text)
    good = out["dup_line_chars"] <= line_limit * out["word_chars"]
    for n, limit in ngram_limits.items():
        inside = per_text(chars * covered_words(h, bounds, n), text)
        out[f"dup_{n}gram_chars"] = inside
        good &= inside <= limit * out["word_chars"]
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_WORDS_PERCENT * out["n_words"])
    out["kept"] = ~out["base_failed"] & good
    return out


def repetition_rules(docs: DataFrame, ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """One row for each document with its counts, the base rule and the verdict; needs doc_id and text."""
    limits = ngram_limits or NGRAM_LIMITS
    schema = SCHEMA.format(ngrams=", ".join(f"dup_{n}gram_chars long" for n in limits))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, end, data, offsets in W.text_chunks(batch.column(1)):
                got = measure(data, offsets, limits, line_limit)
                yield pa.RecordBatch.from_arrays([ids[first:end]] + [pa.array(got[c]) for c in names[1:]], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
