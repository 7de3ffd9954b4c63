"""Vectors in blocks: each component x as floor(scale * x), the rows dealt into blocks of bounded bytes, and a chosen set
of rows asked against the blocks.

A block is one Spark partition. The task holds its rows as one matrix and the asking rows stream past it, so memory is
one block and one Arrow batch, whatever the number of rows asking. Products of whole numbers below 2**53 are exact in
doubles in any order; bounds that would pass that are worked out in Python's integers.

Rows are told apart by uid, a number given to each row as it is read and kept in the stored table. Vectors may differ in
length: the shorter one counts as filled up with zeros. Null vectors, and those with a null or non-finite component (before
or after scaling), are left out; empty ones are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from redline.session import store

SCALE = 256
BLOCK_BYTES = 32 << 20
#: Blocks are not made smaller than this many rows to keep all cores busy.
LEAST_ROWS = 2048
#: Sums of absolute products below this are exact.
EXACT = float(1 << 53)
I64 = np.iinfo(np.int64)


def packed(df: DataFrame, key: str, vector: str, scale: int, more: dict[str, Column]) -> DataFrame:
    """uid, id, the columns of more, vector (little-endian doubles) and norm of the rows that take part."""
    some = df.select(
        F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("id"),
        *[c.alias(name) for name, c in more.items()], F.col(vector).cast("array<double>").alias("vector"),
    )
    at = len(some.columns) - 1
    schema = StructType(some.schema.fields[:at] + [StructField("vector", BinaryType()), StructField("norm", DoubleType())])
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            lists = batch.column(at)
            edge = lists.offsets.to_numpy().astype(np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                value = np.floor(np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64) * scale)
                row = np.repeat(np.arange(len(lists)), np.diff(edge))
                inner = value[edge[0] : edge[-1]]
                norm = np.sqrt(np.bincount(row, inner * inner, len(lists)))
            bad = np.bincount(row, ~np.isfinite(inner), len(lists)) > 0
            keep = ~bad & np.asarray(lists.is_valid())
            whole = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((edge * 8).astype(np.int32)), pa.py_buffer(value.astype("<f8"))])
            arrays = [*batch.columns[:at], whole, pa.array(norm)]
            yield pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(keep))

    return some.mapInArrow(run, schema)


def layout(df: DataFrame, vector: str) -> tuple[int, int]:
    """(number of blocks, components of the longest vector). Blocks hold up to BLOCK_BYTES; a small table is cut finer, so
    that every core has one. The number changes no result."""
    n, width = df.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(1))).first()
    width = max(1, width)
    most = max(1, BLOCK_BYTES // (8 * width))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(-(-n // most), min(2 * cores, -(-n // LEAST_ROWS)), 1), width


def dealt(rows: DataFrame, blocks: int, *order: Column) -> tuple[DataFrame, int]:
    """The rows with their block, in ranges of the order, written to the shared folder; and the number of blocks. The order
    should end in uid, so that equal rows are cut too."""
    held = store(rows.repartitionByRange(blocks, *order).withColumn("block", F.spark_partition_id()), "vector-blocks")
    return held, (held.agg(F.max("block")).first()[0] or 0) + 1


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch as rows of doubles."""
    edge = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 8
    flat = np.frombuffer(column.buffers()[2] or b"", "<f8")
    size = np.diff(edge)
    if (size == width).all():
        return flat[edge[0] : edge[-1]].reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), size), np.arange(edge[0], edge[-1]) - np.repeat(edge[:-1], size)] = flat[edge[0] : edge[-1]]
    return out


def exact_products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, safe: bool) -> np.ndarray:
    """Inner products of the rows a[i] and b[j], as long; beyond long's range they stop at its ends."""
    out = np.empty(len(i), np.int64)
    if safe:
        for at in range(0, len(i), 1 << 16):
            cut = slice(at, at + (1 << 16))
            out[cut] = np.einsum("ij,ij->i", a[i[cut]], b[j[cut]])
        return out
    for at, (x, y) in enumerate(zip(i, j)):
        whole = sum(int(p) * int(q) for p, q in zip(a[x], b[y]))
        out[at] = min(max(whole, int(I64.min)), int(I64.max))
    return out


def order_ids(ids: pa.Array) -> np.ndarray:
    """Ids for ties: null after all others."""
    return ids.fill_null(int(I64.max)).to_numpy()


def best_rows(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's k best, by descending score, then ascending id; owners ascend in the result."""
    order = np.lexsort((ids, ~score, owner))
    of = owner[order]
    first = np.searchsorted(of, of)
    return order[np.arange(len(of)) - first < k]


def ask(held: DataFrame, asking: DataFrame, blocks: int, build: Callable[[pa.Table], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """Each block's rows built once, and every row asking that block passed to what build returned, batch by batch. Both
    have the same columns (asking may add some), block among them; a row asking several blocks is there once for each."""
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in asking.schema if f.name not in held.columns]
    names = asking.columns
    both = held.select("*", *extra).select(*names, F.lit(0).cast("byte").alias("kind")).unionByName(asking.select("*", F.lit(1).cast("byte").alias("kind")))

    def run(batches):
        rows, answer = [], None
        for batch in batches:
            split = int(np.searchsorted(batch.column(len(names)).to_numpy(), 1))
            if split:
                rows.append(batch.slice(0, split))
            if split < len(batch):
                if answer is None:
                    if not rows:
                        return
                    answer, rows = build(pa.Table.from_batches(rows).combine_chunks()), []
                yield from answer(batch.slice(split))

    return both.repartitionById(blocks, "block").sortWithinPartitions("kind").mapInArrow(run, schema)
