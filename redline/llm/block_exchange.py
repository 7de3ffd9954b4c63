"""Questions about values (hashes) that occur all over a corpus, answered by Spark shuffles of packed arrays.

Documents are dealt into blocks of about equal size, each small enough for one task. A block sends its distinct values
to shards, cut by the values' high bits; the shard sees every block's copy of a value and answers. Questions and answers
travel as byte arrays, one row for each (block, shard), so a value costs a few bytes of shuffle and never a row. The
numbers of blocks and shards grow with the text, so both sides stay the same size at any scale. A value that occurs
everywhere costs a shard one entry for each block.

All uses of one blocked() result stand in one plan, in which Spark shuffles the text once and reads that exchange again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
BLOCK_BYTES = 2 << 20
SHARD_BYTES = 8 << 20
QUESTIONS = "shard int, block int, size int, low binary, high binary, extra binary"


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def counts(total: int, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> tuple[int, int]:
    """Numbers of blocks and shards for so many bytes of text."""
    return max(1, math.ceil(total / block_bytes)), max(1, math.ceil(total / shard_bytes))


def tasks(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def blocked(docs: DataFrame) -> DataFrame:
    """docs, which have a column block, with the rows of a block together."""
    return docs.repartition(tasks(docs), "block")


def pack_counts(counts: np.ndarray) -> bytes:
    """Rows of counts, mostly small: one byte each, 255 standing for those listed in full at the end."""
    large = counts >= 255
    return np.where(large, 255, counts).astype("u1").tobytes() + counts[large].astype("<u8").tobytes()


def unpack_counts(raw: bytes, rows: int, size: int) -> np.ndarray:
    out = np.frombuffer(raw, "u1", rows * size).reshape(rows, size).astype(np.uint64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=rows * size)
    return out


def shard_order(values: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, cuts): values[order[cuts[s]:cuts[s + 1]]] belong to shard s."""
    shard = ((values >> U(32)) % U(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def questions(block: int, values: np.ndarray, shards: int, width: int, extra: np.ndarray | None = None) -> pa.Table:
    """Rows that ask about distinct values, of which width bytes (4, 5 or 8) are sent; extra: one entry for each, or
    rows of counts."""
    order, cuts = shard_order(values, shards)
    full = np.flatnonzero(np.diff(cuts))
    low, high, more = [], [], []
    for s in full:
        mine = values[order[cuts[s] : cuts[s + 1]]]
        low.append((mine & U(0xFFFFFFFF)).astype("<u4").tobytes())
        high.append(b"" if width == 4 else ((mine >> U(56)).astype("u1") if width == 5 else (mine >> U(32)).astype("<u4")).tobytes())
        own = order[cuts[s] : cuts[s + 1]]
        more.append(b"" if extra is None else extra[own].tobytes() if extra.ndim == 1 else pack_counts(extra[:, own]))
    return pa.table({
        "shard": pa.array(full.astype(np.int32)), "block": pa.array(np.full(len(full), block, np.int32)),
        "size": pa.array(np.diff(cuts)[full].astype(np.int32)),
        "low": pa.array(low, pa.binary()), "high": pa.array(high, pa.binary()), "extra": pa.array(more, pa.binary()),
    })


class Asked:
    """What a shard has been asked: one entry for each (block, value). extra: the type of the questions' extra entries, or
    how many rows of counts they have."""

    def __init__(self, table: pa.Table, extra: str | int | None = None):
        table = table.sort_by("block")
        self.blocks = table.column("block").to_numpy()
        sizes = table.column("size").to_numpy()
        join = lambda name: b"".join(table.column(name).to_pylist())
        values = np.frombuffer(join("low"), "<u4").astype(np.uint64)
        high = join("high")
        if len(high) == len(values) and len(values):
            values |= np.frombuffer(high, "u1").astype(np.uint64) << U(32)
        elif len(high):
            values |= np.frombuffer(high, "<u4").astype(np.uint64) << U(32)
        self.values = values
        self.block = np.repeat(self.blocks, sizes)
        self.cuts = np.append(0, np.cumsum(sizes))
        self.extra = None
        if isinstance(extra, int):
            self.extra = np.concatenate([unpack_counts(raw, extra, n) for raw, n in zip(table.column("extra").to_pylist(), sizes)], axis=1)
        elif extra:
            self.extra = np.frombuffer(join("extra"), extra)
        order = np.argsort(values, kind="stable")  # by value, then by block
        v = values[order]
        self.order = order
        self.new = np.append(True, v[1:] != v[:-1]) if len(v) else np.zeros(0, bool)
        self.first = np.flatnonzero(self.new)  # in order
        self.group = np.cumsum(self.new) - 1  # in order: which distinct value
        self.times = np.diff(np.append(self.first, len(v)))

    def entries(self, per_value: np.ndarray) -> np.ndarray:
        """One item for each entry as asked, from one for each distinct value."""
        out = np.empty(len(self.values), per_value.dtype)
        out[self.order] = per_value[self.group]
        return out

    def answers(self, shard: int, items: np.ndarray) -> pa.Table:
        """Rows for the blocks; items: one for each entry as asked, or rows of counts for each."""
        cut = [items[a:b].tobytes() if items.ndim == 1 else pack_counts(items[:, a:b]) for a, b in zip(self.cuts[:-1], self.cuts[1:])]
        return pa.table({"block": pa.array(self.blocks.astype(np.int32)), "shard": pa.array(np.full(len(cut), shard, np.int32)), "answer": pa.array(cut, pa.binary())})


def answered(table: pa.Table, values: np.ndarray, shards: int, kind: str | int) -> np.ndarray:
    """The answers to questions(block, values, ...), in the order of values: items of a type, or rows of counts."""
    order, cuts = shard_order(values, shards)
    counted = isinstance(kind, int)
    out = np.zeros((kind, len(values)), np.uint64) if counted else np.zeros(len(values), kind)
    for shard, answer in zip(table.column("shard").to_pylist(), table.column("answer").to_pylist()):
        own = order[cuts[shard] : cuts[shard + 1]]
        if counted:
            out[:, own] = unpack_counts(answer, kind, len(own))
        else:
            out[own] = np.frombuffer(answer, kind)
    return out
