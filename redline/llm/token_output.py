"""Token ids as binary files: Simple-8b coding in 64-bit words, cut into blocks for vectorised decoding.

Format. A file set is a Parquet table of segments, ordered by (part, segment); ids run on through it in ascending
doc_id order. A segment is a run of whole documents of about SEGMENT_IDS ids (a longer document is one segment):

    doc_ids    the documents, in order (null stays null)
    lengths    ids of each document, end id included
    n_ids      ids of the segment
    offsets    u32 little-endian: word number at which each block of BLOCK_IDS ids starts, then the number of words
    words      u64 little-endian Simple-8b words

A word's top 4 bits are the selector: 1..14 pack SELECTORS[s] = (count, bits) ids in the low bits, first id lowest;
the last word of a block may be part-filled with zeros. Selector 15 is the escape: the whole next word is one id that
needs over 60 bits. Blocks are coded independently, so any block can be decoded alone, and all blocks at once.

Texts are encoded with a public tokenizer file of the tokenizers library. Its pre-tokenizer never joins text across
the start of a single blank between two visible characters, or of a line feed there, or of a mark after a letter, so a
text's ids are those of its pieces in order: each distinct piece is encoded once per worker and kept in a bounded table. A text with any other white
space, or with an added token of the tokenizer, is encoded whole.

Defined results: a null or empty text gives the end id only. Null doc_ids come first, as Spark sorts them; repeated
doc_ids are documents of their own, in order of text hash. An empty table gives no segments. Other columns are ignored.
"""

from __future__ import annotations

import json
import string
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redline.llm.words import text_chunks

BLOCK_IDS = 128
SEGMENT_IDS = 1 << 18
PIECES_KEPT = 1 << 20
#: (count, bits) by selector; 0 is unused, 15 the escape.
SELECTORS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
ESCAPE = 15
SEGMENTS = "part int, segment int, n_ids long, doc_ids array<bigint>, lengths array<bigint>, offsets binary, words binary"
U = np.uint64


SMALL_WIDTHS = np.maximum(1, np.ceil(np.log2(np.arange(1 << 17) + 1.0))).astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, 1 at least."""
    if int(ids.max()) < len(SMALL_WIDTHS):
        return SMALL_WIDTHS[ids]
    width = np.ones(len(ids), np.uint8)
    for bits in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60):
        width[ids >> U(bits) > 0] = bits + 1
    return width


def pack(ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): Simple-8b words, and the word at which each block starts, with the number of words last."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    width = _widths(ids)
    choice = np.full(n, 14, np.uint8)
    choice[width > 60] = ESCAPE
    # widest need over the next c ids, for the ascending counts of the selectors; past the end nothing is needed
    need, reach = width, 1
    for selector in sorted(SELECTORS, reverse=True)[1:]:
        count, bits = SELECTORS[selector]
        while reach < count:
            step = min(reach, count - reach)
            wider = need.copy()
            wider[:-step] = np.maximum(need[:-step], need[step:]) if step < n else wider[:-step]
            need, reach = wider, reach + step
        fits = need <= bits
        if not fits.any():
            break  # longer runs need no less
        choice[fits] = selector
    counts = np.zeros(16, np.int64)
    counts[list(SELECTORS)] = [c for c, _ in SELECTORS.values()]
    counts[ESCAPE] = 1
    starts = np.arange(0, n, block)
    ends = np.minimum(starts + block, n)
    at, heads, owner = starts.copy(), [], []
    live = np.arange(len(starts))
    while len(live):
        heads.append(at[live])
        owner.append(live)
        at[live] += counts[choice[at[live]]]
        live = live[at[live] < ends[live]]
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    heads, owner = np.concatenate(heads)[order], owner[order]
    chosen = choice[heads]
    slots = 1 + (chosen == ESCAPE)
    place = np.cumsum(slots) - slots
    words = np.zeros(int(slots.sum()), np.uint64)
    padded = np.append(ids, np.zeros(60, np.uint64))
    room = ends[owner] - heads
    for selector in np.unique(chosen).tolist():
        if selector == ESCAPE:
            continue
        count, bits = SELECTORS[selector]
        mine = np.flatnonzero(chosen == selector)
        word, at, left = np.full(len(mine), U(selector) << U(60)), heads[mine], room[mine]
        partial = bool((left < count).any())
        for j in range(count):
            value = padded[at + j]
            if partial:
                value[left <= j] = 0
            word |= value << U(j * bits)
        words[place[mine]] = word
    mine = np.flatnonzero(chosen == ESCAPE)
    words[place[mine]] = U(ESCAPE) << U(60)
    words[place[mine] + 1] = ids[heads[mine]]
    offsets = np.append(place[np.searchsorted(owner, np.arange(len(starts)))], len(words))
    return words, offsets.astype(np.uint32)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK_IDS) -> np.ndarray:
    """The n ids, all blocks at once."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> U(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    # an escape is followed by a raw word, whose top bits may look like anything: settle runs from their left end
    for k in np.flatnonzero(selector == ESCAPE):
        if not raw[k] and k + 1 < len(words):
            raw[k + 1] = True
    counts = np.zeros(16, np.int64)
    counts[list(SELECTORS)] = [c for c, _ in SELECTORS.values()]
    counts[ESCAPE] = 1
    holds = np.where(raw, 0, counts[selector])
    of = np.searchsorted(offsets[:-1], np.arange(len(words)), "right") - 1
    before = np.cumsum(holds) - holds
    first = of * block + before - before[offsets[:-1].astype(np.int64)][of]
    end = np.minimum((of + 1) * block, n)
    for s, (count, bits) in SELECTORS.items():
        mine = np.flatnonzero((selector == s) & ~raw)
        for j in range(count):
            inside = mine[first[mine] + j < end[mine]]
            out[first[inside] + j] = (words[inside] >> U(j * bits)) & U((1 << bits) - 1)
    mine = np.flatnonzero((selector == ESCAPE) & ~raw)
    out[first[mine]] = words[mine + 1]
    return out


#: White space other than the blank and the line feed, and controls that some engines count as such.
ODD_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"

MARKS = string.punctuation
#: Letters in every version of Unicode: of ASCII, Latin and Cyrillic, the two-byte ones those that begin with IS_LEAD.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u027f\u0400-\u047f"


def _bytes(values) -> np.ndarray:
    """True for these bytes, by byte."""
    is_in = np.zeros(256, bool)
    is_in[list(values)] = True
    return is_in


IS_GAP, IS_MARK, IS_LETTER = _bytes(b" \n"), _bytes(MARKS.encode()), _bytes(string.ascii_letters.encode())
IS_LEAD = _bytes([*range(0xC3, 0xCA), 0xD0, 0xD1])


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces of regular texts start: at a text's start, at a blank or line feed, which goes with what follows, and
    at a mark after a letter, where the pre-tokenizer always parts them."""
    cut = IS_GAP[data]
    mark = np.flatnonzero(IS_MARK[data])
    mark = mark[mark > 0]
    last, lead = data[mark - 1], data[np.maximum(mark, 2) - 2]
    sign = (lead == 0xC3) & ((last == 0x97) | (last == 0xB7))
    cut[mark[IS_LETTER[last] | (IS_LEAD[lead] & (last >> 6 == 2) & ~sign)]] = True
    cut[offsets[:-1]] = True
    return np.flatnonzero(cut)


def _with(store: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """The store with more after its used part; it doubles when it is full."""
    if used + len(more) > len(store):
        store = np.concatenate([store[:used], np.empty(used + 2 * len(more), store.dtype)])
    store[used : used + len(more)] = more
    return store


class PieceEncoder:
    """Whole texts to ids, as little-endian u32 bytes, with each distinct piece encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.pieces_kept = PIECES_KEPT
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.irregular = rf"\A(?:[ \n]|\z)|[ \n]\z|[ \n][ \n]|[{ODD_SPACE}]"
        # the library's model alone, for a blank and letters: the pre-tokenizer leaves them whole, each byte as a character
        self.model = None
        steps = self.tokenizer.pre_tokenizer and json.loads(self.tokenizer.pre_tokenizer.__getstate__())
        if self.tokenizer.normalizer is None and steps and (steps["type"], steps.get("add_prefix_space"), steps.get("use_regex")) == ("ByteLevel", False, True):
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab()
        self.has_blank = np.zeros(max(vocabulary.values()) + 1, bool)
        as_is = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.character = np.zeros(256, "<u2")
        self.character[as_is] = as_is
        self.character[self.character == 0] = 256 + np.arange(256 - len(as_is))
        self.has_blank[[i for token, i in vocabulary.items() if token[:1] == chr(self.character[ord(" ")])]] = True
        self.character[0] = ord(" ")  # what parts the pieces
        self.forget()

    def forget(self) -> None:
        """No piece is known: its row, and by row the place and number of its ids in the store."""
        self.row: dict[bytes, int] = {}
        self.place, self.size, self.store, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4"), 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @classmethod
    def of_worker(cls, path: str, pieces_kept: int, keep: bool = True) -> "PieceEncoder":
        """One encoder for all tasks of a worker process: what it has learnt holds for any text. Fewer pieces kept take less
        memory and more time; results are the same."""
        import tokenizers

        kept = tokenizers.__dict__.setdefault("_piece_encoders", {}) if keep else {}
        if path not in kept:
            kept[path] = cls(path)
        kept[path].pieces_kept = pieces_kept
        return kept[path]

    def regular(self, texts: pa.Array) -> pa.Array:
        """Only single blanks and line feeds, each between two visible characters, and no added token, which is one id
        wherever it stands."""
        odd = pc.match_substring_regex(texts, self.irregular)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        return pc.invert(odd)

    def learn(self, pieces: pa.Array, names: list[bytes]) -> np.ndarray:
        """Encode new pieces many at a time. Those of a blank and letters go to the model, the first id of each is the one with
        the blank; others are joined by line feeds, which always are one id of their own, and a piece's own is the one before
        it. Returns their rows."""
        rows = np.empty(len(names), np.int64)
        words = pc.match_substring_regex(pieces, rf"\A [{LETTERS}]+\z").to_numpy(zero_copy_only=False) & (self.model is not None)
        for are_words in (True, False):
            places = np.flatnonzero(words == are_words)
            for i in range(0, len(places), 4096):
                at = places[i : i + 4096]
                some = [names[k] for k in at.tolist()]
                if are_words:
                    joined = self.character[np.frombuffer(b"\0".join(some), np.uint8)].tobytes().decode("utf-16-le")
                    (coded,) = self.model.encode_batch_fast([joined], add_special_tokens=False)
                    ids = np.array(coded.ids, "<u4")
                    first = np.flatnonzero(self.has_blank[ids])
                    ends = np.append(first[1:], len(ids))
                else:
                    joined = b"".join([p if p[0] == 10 else b"\n" + p for p in some]).decode()
                    (coded,) = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)
                    ids = np.array(coded.ids, "<u4")
                    first = np.flatnonzero(ids == self.line)
                    ends = np.append(first[1:], len(ids))
                    first += [p[0] != 10 for p in some]
                n = len(self.row)
                self.place, self.size = _with(self.place, n, self.used + first), _with(self.size, n, ends - first)
                self.store = _with(self.store, self.used, ids)
                self.used += len(ids)
                rows[at] = np.arange(n, n + len(some))
                self.row.update(zip(some, range(n, n + len(some))))
        return rows

    def encode_regular(self, texts: pa.Array) -> tuple[bytes, list[int]]:
        """Ids of all these texts, and the byte at which each text's ids start, with the number of bytes last."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts = piece_starts(data, offsets)
        bounds = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        distinct, which = pieces.dictionary, pieces.indices.to_numpy()
        raw, cut = distinct.buffers()[2].to_pybytes(), np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1).tolist()
        names = [raw[a:b] for a, b in zip(cut, cut[1:])]
        rows = np.fromiter(map(self.row.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(rows < 0)
        if self.row and len(self.row) + len(new) > self.pieces_kept:
            self.forget()
            new = np.arange(len(names))
        if len(new):
            rows[new] = self.learn(distinct.take(pa.array(new)), [names[k] for k in new.tolist()])
        size = self.size[rows][which]
        ends = np.cumsum(size)
        ids = np.repeat(self.place[rows][which] - ends + size, size)
        ids += np.arange(len(ids))
        at = np.append(ends - size, ends[-1])[np.searchsorted(bounds, offsets)]
        return self.store[ids].tobytes(), (at * 4).tolist()

    def coded(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text, worked out for many texts at a time; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        for first, end, _, _ in text_chunks(texts):
            some = texts.slice(first, end - first)
            regular = self.regular(some)
            raw, at = self.encode_regular(some.filter(regular)) if pc.any(regular).as_py() else (b"", [])
            k = 0
            for i, is_regular in enumerate(regular.to_pylist()):
                if is_regular:
                    yield raw[at[k] : at[k + 1]]
                    k += 1
                else:
                    text = some[i].as_py()
                    yield self.whole(text) if text else b""

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        return list(self.coded(pa.array(texts, pa.string())))


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, parts: int | None = None, pieces_kept: int = PIECES_KEPT, keep_encoder: bool = True) -> DataFrame:
    """Segments of all documents in ascending doc_id order. The text is shuffled once, by ranges of (doc_id, hash of the
    text), so equal ids don't pile up; a task holds one segment at a time. With keep_encoder off, what an encoder has learnt goes with
    its task, for jobs whose workers go on to other work."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = some.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        encoder, part, segment = PieceEncoder.of_worker(tokenizer_path, pieces_kept, keep_encoder), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        ids, texts, size = [], [], 0

        def close(held_ids, held):
            flat = np.frombuffer(b"".join(held), "<u4")
            words, offsets = pack(flat)
            columns = [[part], [segment], [len(flat)], [held_ids], [[len(x) // 4 for x in held]], [offsets.astype("<u4").tobytes()], [words.astype("<u8").tobytes()]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "segment", "n_ids", "doc_ids", "lengths", "offsets", "words"])

        for batch in batches:
            for doc, code in zip(batch.column(0).to_pylist(), encoder.coded(batch.column(1))):
                ids.append(doc)
                texts.append(code + end)
                size += len(code) // 4 + 1
                if size >= SEGMENT_IDS:
                    yield close(ids, texts)
                    ids, texts, size, segment = [], [], 0, segment + 1
        if ids:
            yield close(ids, texts)

    return ordered.drop("tie").mapInArrow(run, SEGMENTS)


def segment_ids(words: bytes, offsets: bytes, n_ids: int) -> np.ndarray:
    return unpack(np.frombuffer(words, "<u8"), np.frombuffer(offsets, "<u4"), n_ids)


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files. Starts come from the segments'
    sizes: first summed by part, of which there are as many as the writer had tasks."""
    sizes = segments.select("part", "segment", "n_ids")
    by_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    part_start = by_part.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("part_start"))
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")
    starts = sizes.select("part", "segment", own.alias("own_start")).join(part_start, "part")
    starts = starts.select("part", "segment", (F.col("part_start") + F.col("own_start")).alias("segment_start"))

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = segment_ids(row["words"], row["offsets"], row["n_ids"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                first = ends - row["lengths"]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ends), row["part"], np.int32)), pa.array(np.full(len(ends), row["segment"], np.int32)),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(first), pa.array(np.asarray(row["lengths"], np.int64)),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(first, ends)], pa.int64()),
                ], names=["part", "segment", "doc_id", "within", "n_tokens", "ids_crc32"])

    read = segments.mapInArrow(decode, "part int, segment int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "segment"]).select("doc_id", (F.col("segment_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(segments: DataFrame) -> DataFrame:
    """doc_id and the ids themselves, array<long>, for readers that want them."""
    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, ends = segment_ids(row["words"], row["offsets"], row["n_ids"]).astype(np.int64), np.cumsum(row["lengths"])
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"doc_id": pd.array(row["doc_ids"], dtype="Int64"), "ids": np.split(ids, ends[:-1])}), schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]), preserve_index=False)

    return segments.mapInArrow(decode, "doc_id long, ids array<bigint>")
