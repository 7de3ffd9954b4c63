"""Interpolated modified Kneser-Ney language model (bigrams over a continuation unigram and a uniform floor), counted and
applied over all documents by Spark.

Tokens of a text: its words, A-Z lower-cased, then one end. The first token's context is the start mark.

    p(w | v) = (max(c(vw) - D(c(vw)), 0) + (D1 n1(v) + D2 n2(v) + D3 n3(v)) p(w)) / c(v)       p(w) if v was never seen
    p(w)     = (max(k(w) - E(k(w)), 0) + (E1 m1 + E2 m2 + E3 m3) / (V + 1)) / K

c counts, n1, n2, n3(v) the continuations of v seen once, twice, more often; k(w) how many different tokens w has
followed, K their sum, m1, m2, m3 the words with k of 1, 2, more; V distinct tokens; the + 1 is any unknown word. D and E
are the modified discounts from the counts of counts of c and k, for 1, 2 and 3 or more (1/2, 1, 3/2 where too little was
counted to estimate them). Probabilities over the V tokens and the unknown word sum to one in every context.

The model lives in shards of sorted hash arrays. Blocks of documents ask the shards about their own distinct bigrams and
words; a shard sums the training counts, stores them sorted by hash in a file that its worker memory-maps, and looks up
each block's questions there. So no worker ever holds the model, only its shard, and both grow with the corpus. Counts
over context and continuation need each bigram once: the shard names one block as the owner, which adds it to its words'
counts. The text is shuffled once.

Words are told apart by 64-bit hashes, bigrams by 40 bits within a shard of a few million.

Defined results: a null or empty text is one end token. train decides which rows are learnt from (null counts as
false); with none, all probabilities are 1 / (V + 1) = 1 and all scores 0. Repeated rows and equal or null doc_ids are
documents of their own. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.llm import block_exchange as X
from redline.llm import words as W

START, END = W.U(0x1F83D9ABFB41BD6B), W.U(0x5BE0CD19137E2179)
PAIR = W._random(2, 21)
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
ARROW = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
REPLIES = "block int, kind int, shard int, answer binary"
#: What is counted of a word; rows of the arrays that travel.
COUNT, FOLLOWS, N1, N2, N3 = WORD = range(5)
TOTALS = ["tokens", "vocabulary", "kinds"] + [f"c{k}" for k in (1, 2, 3, 4)] + [f"k{k}" for k in (1, 2, 3, 4)] + ["k_more"]


class BlockTokens:
    """The tokens of a block's documents with their contexts, as hashes."""

    def __init__(self, table: pa.Table):
        self.doc_ids, self.train = table.column("doc_id"), np.array([bool(x) for x in table.column("train").to_pylist()])
        parts, lengths = [], []
        for _, _, data, offsets in W.text_chunks(table.column("text")):
            data = W.LOWER[data]
            starts, ends, bounds = W.word_spans(data, offsets)
            parts.append(np.insert(W.span_hashes(data, starts, ends), bounds[1:], END))
            lengths.append(np.diff(bounds) + 1)
        self.token = np.concatenate(parts)
        self.length = np.concatenate(lengths)
        first = np.cumsum(self.length) - self.length
        self.before = np.append(START, self.token[:-1])
        self.before[first] = START
        self.first = first
        self.learnt = np.repeat(self.train, self.length)
        pair = W.mix(self.before * PAIR[0] + self.token * PAIR[1])
        self.pairs, self.example, self.pair = np.unique(pair, return_index=True, return_inverse=True)
        self.words, self.word = np.unique(np.append(self.token, START), return_inverse=True)
        self.word = self.word[:-1]
        self.context = np.searchsorted(self.words, self.before)

    def word_questions(self, count: np.ndarray, owned: np.ndarray) -> np.ndarray:
        """What the block adds to each of its words: training tokens (for the start mark: documents), and the bigrams
        it owns, by the word they end with and by the word they begin with."""
        n = len(self.words)
        out = np.zeros((len(WORD), n), np.uint64)
        out[COUNT] = np.bincount(self.word[self.learnt], minlength=n)
        out[COUNT, np.searchsorted(self.words, START)] = self.train.sum()
        mine = np.flatnonzero(owned)
        example = self.example[mine]
        out[FOLLOWS] = np.bincount(self.word[example], minlength=n)
        for name, chosen in ((N1, count[mine] == 1), (N2, count[mine] == 2), (N3, count[mine] > 2)):
            out[name] = np.bincount(self.context[example[chosen]], minlength=n)
        return out


class MappedCounts:
    """A shard's rows of counts, sorted by hash, in a file of the worker's own that is memory-mapped and has no name any more,
    so nothing is left behind however the task ends."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        kind = np.dtype([("value", "<u8"), ("count", "<u8", (len(counts),))])
        self.size = len(values)
        if self.size:
            handle, path = tempfile.mkstemp(prefix="ngram-shard-")
            os.close(handle)
            stored = np.memmap(path, kind, "w+", shape=self.size)
            os.unlink(path)
            stored["value"], stored["count"] = values, counts.T
            self.values, self.counts = stored["value"], stored["count"]

    def look_up(self, values: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.values, values)].T


def discounts(counts: list[float]) -> np.ndarray:
    """Modified discounts for counts of 0, 1, 2, 3 and more, from how many things were counted 1, 2, 3, 4 times."""
    n1, n2, n3, n4 = counts
    if min(n1, n2, n3) <= 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    usable = (d[1:] > 0) & (d[1:] <= np.array([1, 2, 3]))
    return np.append(0, np.where(usable, d[1:], [0.5, 1.0, 1.5]))


def word_probability(follows: np.ndarray, total: dict[str, float]) -> np.ndarray:
    """p(w) from k(w)."""
    floor = 1 / (total["vocabulary"] + 1)
    if not total["kinds"]:
        return np.full(len(follows), floor)
    e = discounts([total[f"k{k}"] for k in (1, 2, 3, 4)])
    freed = e[1] * total["k1"] + e[2] * total["k2"] + e[3] * total["k_more"]
    return (np.maximum(follows - e[np.minimum(follows, 3)], 0) + freed * floor) / total["kinds"]


def probability(count: np.ndarray, context: np.ndarray, p_word: np.ndarray, total: dict[str, float]) -> np.ndarray:
    """p(w | v) from c(vw), the counts of v, and p(w)."""
    d = discounts([total[f"c{k}"] for k in (1, 2, 3, 4)])
    seen = np.maximum(context["count"], 1)
    freed = d[1] * context["n1"] + d[2] * context["n2"] + d[3] * context["n3"]
    known = (np.maximum(count - d[np.minimum(count, 3)], 0) + freed * p_word) / seen
    return np.where(context["count"] > 0, known, p_word)


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int32(), pa.int32(), pa.binary()])], names=["block", "kind", "shard", "answer"])


def _with_kind(table: pa.Table, kind: int, rest: list[tuple]) -> pa.Table:
    got = [(b, kind, s, a) for b, s, a in zip(*(table.column(c).to_pylist() for c in ("block", "shard", "answer")))]
    return _rows(got + rest)


def _totals(names: dict[str, int]) -> bytes:
    return np.array([names.get(x, 0) for x in TOTALS], "<f8").tobytes()


def _of_kind(replies: pa.Table, kind: int) -> pa.Table:
    return replies.filter(pa.array(replies.column("kind").to_numpy() == kind)) if replies.num_rows else replies


def score_documents(docs: DataFrame, train: Column, block_bytes: int = X.BLOCK_BYTES) -> DataFrame:
    """Counts a model from the rows where train is true and scores all rows: doc_id, held_out (not train), n_tokens,
    n_known (tokens seen in training), train_tokens (all of them), base_score (log10, unigrams with 0.1 added), score
    (log10 probability of the text under the model). Perplexity is 10 ** (-score / n_tokens)."""
    blocks, shards = X.counts(X.text_bytes(docs), block_bytes)
    tasks = X.tasks(docs)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    text = X.blocked(some.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))).groupBy("block")

    def ask_pairs(key, table):
        t = BlockTokens(table)
        return X.questions(key[0].as_py(), t.pairs, shards, 5, np.bincount(t.pair[t.learnt], minlength=len(t.pairs))[None, :])

    def count_pairs(key, table):
        asked, shard = X.Asked(table, 1), key[0].as_py()
        extra = asked.extra[0, asked.order].astype("<u4")
        count = np.add.reduceat(extra, asked.first, dtype=np.int64) if len(extra) else np.zeros(0, np.int64)
        model = MappedCounts(asked.values[asked.order][asked.first], 2 * count[None, :])
        items = np.zeros((1, len(asked.values)), np.uint64)
        for a, b in zip(asked.cuts[:-1], asked.cuts[1:]):
            items[:, a:b] = model.look_up(asked.values[a:b])
        has = np.flatnonzero(extra > 0)
        _, owner = np.unique(asked.group[has], return_index=True)
        items[0, asked.order[has[owner]]] += np.uint64(1)
        totals = _totals({f"c{k}": int((count == k).sum()) for k in (1, 2, 3, 4)})
        return _with_kind(asked.answers(shard, items), 0, [(-1, 2, shard, totals)])

    def ask_words(key, table, replies):
        t = BlockTokens(table)
        got = X.answered(replies, t.pairs, shards, 1)[0].astype(np.int64)  # twice the count, plus one for the owner
        return X.questions(key[0].as_py(), t.words, shards, 8, t.word_questions(got >> 1, got & 1))

    def count_words(key, table):
        asked, shard = X.Asked(table, len(WORD)), key[0].as_py()
        sums = np.add.reduceat(asked.extra[:, asked.order], asked.first, axis=1)
        values = asked.values[asked.order][asked.first]
        model = MappedCounts(values, sums)
        items = np.zeros((len(WORD), len(asked.values)), np.uint64)
        for a, b in zip(asked.cuts[:-1], asked.cuts[1:]):
            items[:, a:b] = model.look_up(asked.values[a:b])
        real = sums[:, values != START]
        k = real[FOLLOWS]
        totals = {"tokens": int(real[COUNT].sum()), "vocabulary": int((real[COUNT] > 0).sum()), "kinds": int(k.sum()), "k_more": int((k > 2).sum())}
        totals |= {f"k{n}": int((k == n).sum()) for n in (1, 2, 3, 4)}
        return _with_kind(asked.answers(shard, items), 1, [(-1, 2, shard, _totals(totals))])

    def add_totals(batches):
        total, seen = np.zeros(len(TOTALS)), False
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total, seen = total + np.frombuffer(x, "<f8"), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["answer"])

    def score(key, table, replies):
        if not table.num_rows:  # the totals go to blocks without documents too
            return pa.table({name: pa.array([], kind) for name, kind in ARROW.items()})
        t = BlockTokens(table)
        total = dict(zip(TOTALS, np.frombuffer(_of_kind(replies, 2).column("answer")[0].as_py(), "<f8").tolist()))
        pair = X.answered(_of_kind(replies, 0), t.pairs, shards, 1)[0].astype(np.int64) >> 1
        word = X.answered(_of_kind(replies, 1), t.words, shards, len(WORD)).astype(np.int64)
        count = word[COUNT]
        p_word = word_probability(word[FOLLOWS], total)
        context = {name: word[row][t.context] for name, row in (("count", COUNT), ("n1", N1), ("n2", N2), ("n3", N3))}
        p = probability(pair[t.pair], context, p_word[t.word], total)
        base = np.log10((count + 0.1) / (total["tokens"] + 0.1 * (total["vocabulary"] + 1)))
        per_doc = lambda x: np.add.reduceat(x, t.first)
        return pa.table({
            "doc_id": t.doc_ids, "held_out": pa.array(~t.train), "n_tokens": pa.array(t.length.astype(np.int64)),
            "n_known": pa.array(per_doc((count > 0)[t.word].astype(np.int64))),
            "train_tokens": pa.array(np.full(len(t.length), int(total["tokens"]), np.int64)),
            "base_score": pa.array(per_doc(base[t.word])), "score": pa.array(per_doc(np.log10(p))),
        })

    by_block = lambda df: df.repartition(tasks, "block").groupBy("block")
    by_shard = lambda df: df.repartition(tasks, "shard").groupBy("shard")
    pairs = by_shard(text.applyInArrow(ask_pairs, X.QUESTIONS)).applyInArrow(count_pairs, REPLIES)
    own = by_block(pairs.where("kind = 0").select("block", "shard", "answer"))
    words = by_shard(text.cogroup(own).applyInArrow(ask_words, X.QUESTIONS)).applyInArrow(count_words, REPLIES)
    # the totals are one row: added up in each task, then in one, and sent to every block
    partial = pairs.union(words).where("kind = 2").select("answer").mapInArrow(add_totals, "answer binary")
    total = partial.repartition(1).mapInArrow(add_totals, "answer binary")
    total = total.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(2).alias("kind"), F.lit(-1).alias("shard"), "answer")
    replies = pairs.union(words).where("kind < 2").union(total)
    return text.cogroup(by_block(replies)).applyInArrow(score, RESULT)
