"""Substring dedup with repeated-phrase automata.

A window is a run of WINDOW consecutive words of one document. A word goes if some window that covers it starts, with
the same words, in a document with a smaller doc_id too; windows are judged on the input.

1. Candidates. A window's signature is the least hash among its 8-word runs. Equal windows have equal signatures, and
   neighbouring windows mostly share one, so blocks ask shards about few values: does another block have it?
2. Confirmation. Of windows whose signature recurs, blocks ask about the 64-bit hash of the whole window. Blocks are
   ranges of doc_id; the shard names, for each recurring window, the first block as its holder, and who needs it.
3. The holders send the words themselves: runs of needed windows, merged to passages, to the blocks that need them.
4. Each block compiles one Aho-Corasick automaton from its passages and its own repeats, in pieces of half a window, and
   streams all its documents through it to find every occurrence, word for word. So the automata are sharded by block: each is
   bounded by the block's text, every document is streamed once, and a passage that is everywhere costs each block one
   pattern.

Defined results: a null or empty text has no words and the hash of "". A null doc_id counts as larger than all ids: such
a row loses what earlier documents hold, and costs no other row anything. Rows with equal doc_ids don't dedupe each
other. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from redline.llm import block_exchange as X
from redline.llm import words as W

WINDOW = 13
RUN = 8
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
REPLIES = "block int, kind int, shard int, answer binary, who binary"


def doc_ranges(docs: DataFrame, blocks: int) -> np.ndarray:
    """Ascending first ids of about so many ranges with about as many documents each; one number for each block."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    dealt = ids.repartitionByRange(blocks, "doc_id").groupBy(F.spark_partition_id().alias("part")).agg(F.min("doc_id").alias("low"))
    low = np.sort(np.array([r.low for r in dealt.select("low").collect()], np.int64))
    return low if len(low) else np.zeros(1, np.int64)


def in_ranges(docs: DataFrame, low: np.ndarray) -> DataFrame:
    """doc_id, text, block: blocks 0 .. len(low) - 1 are ranges of ids, as many more hold the rows without id."""
    n = len(low)

    @F.pandas_udf(IntegerType())
    def place(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.clip(np.searchsorted(low, doc_id.to_numpy(np.int64), "right") - 1, 0, n - 1).astype(np.int32))

    spread = (F.pmod(F.xxhash64("text"), F.lit(n)) + n).cast("int")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    some = some.withColumn("place", place(F.coalesce("doc_id", F.lit(0))))
    return some.select("doc_id", "text", F.when(F.col("doc_id").isNull(), spread).otherwise(F.col("place")).alias("block"))


class BlockWords:
    """The words of a block's documents, by doc_id, and their windows."""

    def __init__(self, table: pa.Table, window: int, run: int):
        ids = table.column("doc_id").to_numpy(zero_copy_only=False)
        table = table.take(pa.array(np.argsort(ids, kind="stable")))
        self.doc_ids = table.column("doc_id").to_pylist()
        self.window, parts, base = window, [], 0
        for _, _, data, offsets in W.text_chunks(table.column("text")):
            starts, ends, bounds = W.word_spans(data, offsets)
            h = W.span_hashes(data, starts, ends)
            parts.append((data, starts + base, ends + base, np.diff(bounds), h))
            base += len(data)
        join = lambda i, kind: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind)
        self.data, self.starts, self.ends = join(0, np.uint8), join(1, np.int64), join(2, np.int64)
        self.bounds = np.append(0, np.cumsum(join(3, np.int64))).astype(np.int64)
        h = join(4, np.uint64)
        self.at = np.flatnonzero(W.inside_text(self.bounds, window, len(h)))  # first words of all windows
        self.text = W.text_of(self.bounds)
        runs, self.hashes = W.ngram_hashes(h, run), W.ngram_hashes(h, window)[self.at]
        least = runs[self.at] if len(self.at) else np.zeros(0, np.uint64)
        for j in range(1, window - run + 1):
            least = np.minimum(least, runs[self.at + j])
        self.signatures = least
        rank, seen = [], {}
        for doc in self.doc_ids:
            rank.append(seen.setdefault(doc, len(seen)))
        self.rank = np.array(rank, np.int64)  # of the doc_id within the block; null last

    def in_two_docs(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which windows (numbers at into self.at) have a value that other doc_ids of the block have as well?"""
        if not len(values):
            return np.zeros(0, bool)
        rank = self.rank[self.text[self.at[at]]]
        order = np.lexsort((rank, values))
        v, r = values[order], rank[order]
        first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        last = np.append(first[1:], len(v)) - 1
        out = np.empty(len(v), bool)
        out[order] = np.repeat(r[first] != r[last], np.diff(np.append(first, len(v))))
        return out

    def words(self, first: int, end: int) -> list[bytes]:
        """Words of one document by their numbers."""
        return self.data[self.starts[first] : self.ends[end - 1]].tobytes().split() if end > first else []


def _reply(rows: list[tuple[int, int, int, bytes, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * 5
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=["block", "kind", "shard", "answer", "who"])


def passages_of(doc: BlockWords, hashes: np.ndarray, asked_by: np.ndarray) -> list[tuple[int, bytes]]:
    """(block, passages) for each block that needs windows of this holder: runs of needed windows, a line for each."""
    value, first = np.unique(doc.hashes, return_index=True)
    hit = np.searchsorted(value, hashes)
    hit[hit == len(value)] = 0
    ok = value[hit] == hashes if len(value) else np.zeros(len(hashes), bool)
    position, who = doc.at[first[hit[ok]]], asked_by[ok]
    order = np.lexsort((position, who))
    position, who = position[order], who[order]
    if not len(position):
        return []
    gap = (np.diff(position) != 1) | (np.diff(who) != 0) | (doc.text[position[1:]] != doc.text[position[:-1]])
    cut = np.append(0, np.flatnonzero(gap) + 1)
    end = np.append(cut[1:], len(position)) - 1
    out: dict[int, list[bytes]] = {}
    for a, b in zip(cut.tolist(), end.tolist()):
        out.setdefault(int(who[a]), []).append(b" ".join(doc.words(int(position[a]), int(position[b]) + doc.window)))
    return [(block, b"\n".join(lines)) for block, lines in out.items()]


class Automaton:
    """An Aho-Corasick automaton that finds the windows of passages.

    Its patterns are the pieces of half a window that tile each passage: any window of a passage holds one whole piece.
    A piece knows the words around it within reach in each passage (each distinct surrounding once), so where it occurs
    the match is extended word by word, and counts if it spans a window.
    """

    def __init__(self, window: int):
        self.window, self.size = window, (window + 1) // 2
        self.reach = window - self.size
        self.number: dict[bytes, int] = {}
        self.around: dict[tuple[int, ...], dict[tuple, int]] = {}
        self.found: list[list[tuple]] = []
        self.automaton = None

    def add(self, words: list[bytes], value: int) -> None:
        """A passage; value is less than the rank of the documents that lose it."""
        number, size, reach = self.number, self.size, self.reach
        code = tuple([number.setdefault(w, len(number) + 1) for w in words])
        for i in range(0, len(code) - size + 1, size):
            around = self.around.setdefault(code[i : i + size], {})
            key = (code[max(0, i - reach) : i], code[i + size : i + size + reach])
            if around.get(key, value) >= value:
                around[key] = value

    def build(self) -> None:
        import ahocorasick

        if not self.around:
            return
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for piece, around in self.around.items():
            self.automaton.add_word(piece, len(self.found))
            self.found.append([(left, right, value) for (left, right), value in around.items()])
        self.automaton.make_automaton()
        self.around = {}

    def covered(self, words: list[bytes], own: int) -> list[tuple[int, int]]:
        """Spans of words inside windows of passages with a value below own."""
        if self.automaton is None or len(words) < self.window:
            return []
        code, size, spans = tuple(map(self.number.get, words, repeat(0))), self.size, []
        for last, which in self.automaton.iter(code):
            first, end = last - size + 1, last + 1
            for left, right, value in self.found[which]:
                if value >= own:
                    continue
                a, b = first - len(left), end + len(right)
                if a < 0 or code[a:first] != left:
                    a, k = first, len(left) - 1
                    while k >= 0 and a > 0 and code[a - 1] == left[k]:
                        a, k = a - 1, k - 1
                if code[end:b] != right:
                    b, k = end, 0
                    while k < len(right) and b < len(code) and code[b] == right[k]:
                        b, k = b + 1, k + 1
                if b - a >= self.window:
                    spans.append((a, b))
        return spans


def compile_automaton(doc: BlockWords, passages: list[bytes]) -> Automaton:
    """The automaton of a block: passages from earlier blocks, with value 0, and the runs of windows that recur in the
    block, as the first document has them, with 1 + that document's rank."""
    automaton = Automaton(doc.window)
    for line in passages:
        automaton.add(line.split(b" "), 0)
    own = np.flatnonzero(doc.in_two_docs(doc.hashes, np.arange(len(doc.at))))
    _, first = np.unique(doc.hashes[own], return_index=True)  # windows are in the order of doc_ids: the first holds it
    position = np.sort(doc.at[own[first]])
    cut = np.flatnonzero((np.diff(position) != 1) | (doc.text[position[1:]] != doc.text[position[:-1]])) + 1 if len(position) else []
    for run in np.split(position, cut) if len(position) else []:
        automaton.add(doc.words(int(run[0]), int(run[-1]) + doc.window), 1 + int(doc.rank[doc.text[run[0]]]))
    automaton.build()
    return automaton


def strip_repeats(doc: BlockWords, passages: list[bytes], with_text: bool = True) -> pa.Table:
    automaton = compile_automaton(doc, passages)
    rows = []
    for i, doc_id in enumerate(doc.doc_ids):
        words = doc.words(int(doc.bounds[i]), int(doc.bounds[i + 1]))
        kept, spans = words, automaton.covered(words, 1 + int(doc.rank[i]))
        if spans:
            step = np.zeros(len(words) + 1, np.int32)
            at = np.array(spans)
            np.add.at(step, at[:, 0], 1)
            np.add.at(step, at[:, 1], -1)
            kept = [w for w, c in zip(words, np.cumsum(step)[:-1].tolist()) if not c]
        text = b" ".join(kept)
        rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None))
    cols = list(zip(*rows)) or [[]] * 5
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, block_bytes: int = X.BLOCK_BYTES, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words, joined by blanks; null unless with_text) of
    each document."""
    blocks, shards = X.counts(X.text_bytes(docs), block_bytes)
    low = doc_ranges(docs, blocks)
    ranges = len(low)
    text = X.blocked(in_ranges(docs, low))
    tasks = X.tasks(docs)

    def ask_signatures(key, table):
        doc = BlockWords(table, window, run)
        return X.questions(key[0].as_py(), np.unique(doc.signatures), shards, 4)

    def signatures_recur(key, table):
        asked = X.Asked(table)
        got = asked.answers(key[0].as_py(), asked.entries((asked.times > 1).astype("u1")))
        return _reply([(b, 0, s, a, b"") for b, s, a in zip(*(got.column(c).to_pylist() for c in ("block", "shard", "answer")))])

    def ask_windows(key, table, replies):
        doc = BlockWords(table, window, run)
        value = np.unique(doc.signatures)
        recurs = X.answered(replies, value, shards, "u1") > 0
        chosen = recurs[np.searchsorted(value, doc.signatures)] if len(value) else np.zeros(0, bool)
        return X.questions(key[0].as_py(), np.unique(doc.hashes[chosen]), shards, 8)

    def name_holders(key, table):
        asked = X.Asked(table)
        block = asked.block[asked.order]
        holder = block[asked.first][asked.group]
        need = ~asked.new & (holder < ranges)
        value, holder, who = asked.values[asked.order][need], holder[need], block[need]
        order = np.argsort(holder, kind="stable")
        value, holder, who = value[order], holder[order], who[order]
        cut = np.flatnonzero(np.append(True, holder[1:] != holder[:-1])) if len(holder) else np.zeros(0, int)
        rows = [(int(holder[a]), 1, key[0].as_py(), value[a:b].astype("<u8").tobytes(), who[a:b].astype("<u4").tobytes()) for a, b in zip(cut, np.append(cut[1:], len(holder)))]
        return _reply(rows)

    def send_passages(key, table, replies):
        if not replies.num_rows:
            return _reply([])
        doc = BlockWords(table, window, run)
        hashes = np.frombuffer(b"".join(replies.column("answer").to_pylist()), "<u8")
        who = np.frombuffer(b"".join(replies.column("who").to_pylist()), "<u4")
        return _reply([(block, 2, key[0].as_py(), lines, b"") for block, lines in passages_of(doc, hashes, who)])

    def strip(key, table, replies):
        lines = [x for packed in replies.column("answer").to_pylist() for x in packed.split(b"\n")]
        return strip_repeats(BlockWords(table, window, run), lines, with_text)

    by_block = lambda df: df.repartition(tasks, "block").groupBy("block")
    by_shard = lambda df: df.repartition(tasks, "shard").groupBy("shard")
    texts = text.groupBy("block")
    recurring = by_shard(texts.applyInArrow(ask_signatures, X.QUESTIONS)).applyInArrow(signatures_recur, REPLIES)
    asked = texts.cogroup(by_block(recurring)).applyInArrow(ask_windows, X.QUESTIONS)
    held = by_shard(asked).applyInArrow(name_holders, REPLIES)
    passages = texts.cogroup(by_block(held)).applyInArrow(send_passages, REPLIES)
    return texts.cogroup(by_block(passages)).applyInArrow(strip, RESULT)
