"""Ordered work inside a document, spread over blocks.

One document may hold a large share of all rows, so no window here is partitioned by document alone. Rows are
cut into blocks of consecutive positions; windows run per (document, block). What crosses a block edge is
either a fixed reach (rows near an edge are copied next door) or a running sum (block sums are added up on a
table that is ``size`` times smaller, then joined back on the block).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 4096


def by_document(df: DataFrame) -> DataFrame:
    """Rows dealt by document, which fits a task as it fits a row of its source. Groups and windows by document and more
    find such rows in place, so that a text travels once, however many of them follow. A join by more than the document
    would deal both sides again: tables that meet are put under one another first, and dealt as one."""
    return df.repartition("doc_id")


def block_of(index: str, size: int = BLOCK) -> Column:
    return F.floor(F.col(index) / size).cast("long")


def with_neighbours(
    df: DataFrame, keys: list[str], index: str, compute: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0, after: int = 0, size: int = BLOCK, keep_block: bool = False,
) -> DataFrame:
    """Window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``index`` must count 0, 1, 2 … without gaps inside each key (see ``dense``). ``keep_block`` leaves the block
    number in, so that a ``running`` over the same index and size needs no second shuffle.
    """
    offset = F.pmod(F.col(index), F.lit(size))
    homes = F.array_compact(F.array(
        F.col("_home"),
        F.when(F.lit(before > 0) & (offset >= size - before), F.col("_home") + 1),
        F.when(F.lit(after > 0) & (offset < after) & (F.col("_home") > 0), F.col("_home") - 1),
    ))
    spread = df.withColumn("_home", block_of(index, size)).withColumn("_blk", F.explode(homes))
    window = Window.partitionBy(*keys, "_blk").orderBy(index)
    out = spread.select("*", *[c.alias(name) for name, c in compute(window).items()])
    return out.filter("_home = _blk").drop("_home" if keep_block else "_blk", "_home")


def running(
    df: DataFrame, keys: list[str], index: str, sums: dict[str, Column], totals: dict[str, Column] | None = None,
    size: int = BLOCK,
) -> DataFrame:
    """Inclusive running sums ``sums`` in order of ``index``, and whole-key sums ``totals``."""
    totals = totals or {}
    rows = df if "_blk" in df.columns else df.withColumn("_blk", block_of(index, size))
    part = rows.groupBy(*keys, "_blk").agg(
        *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()],
    )
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(
        *keys, "_blk",
        *[F.coalesce(F.sum(f"_s_{n}").over(upto), F.lit(0)).alias(f"_p_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(whole).alias(n) for n in totals],
    )
    local = Window.partitionBy(*keys, "_blk").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(part, [*keys, "_blk"])
        .select("*", *[(F.col(f"_p_{n}") + F.sum(c).over(local)).alias(n) for n, c in sums.items()])
        .drop("_blk", *[f"_p_{n}" for n in sums])
    )


def dense(df: DataFrame, keys: list[str], index: str, name: str, total: str | None = None, size: int = BLOCK) -> DataFrame:
    """Number the rows of each key 0, 1, 2 … in order of ``index``; ``total`` adds their count."""
    out = running(df, keys, index, {name: F.lit(1)}, {total: F.lit(1)} if total else None, size)
    return out.withColumn(name, F.col(name) - 1)


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark cuts every input partition to k rows before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= k)
