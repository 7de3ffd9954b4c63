"""Filter interaction audit: what each filter of a chain removes, in every order, and its Shapley value.

A document is a set of filters that it fails. Documents are counted by part and set, and from those few counts a table of
coalition removals is made: v(S), the documents that at least one filter of S removes, for all 2**n coalitions S. Each
step of each order is a difference of two coalitions: filter f after the filters P removes v(P + f) - v(P). The Shapley
values are the exact least-squares solution of v(S) ~ sum of phi over S under Shapley's kernel weights
(n - 1) / (C(n, s) s (n - s)), with sum of phi = v(all) (efficiency): the normal equations with their multiplier are solved
in rationals, once for each coalition's unit vector, as they are the same for all parts; n! times that solution is whole
numbers, which are then applied to every part's table as a plain sum.

Four of the five filters look at a text alone. The fifth asks for the same text under a smaller doc_id: the smallest id of
each text's SHA-256 comes from one grouping that is combined before its shuffle, and is joined back on digest and id
together, so copies of one text spread over all tasks. Text is read once and never shuffled.

Defined results: a null text is empty (and a copy of other empty texts); a null part counts as ''. A null doc_id is
smaller than none, so such rows neither have nor make copies. Rows that repeat a doc_id are documents of their own; with
the same text they aren't copies of each other. A document labelled more than once is good or toxic if any of its rows
says 1; null labels and labels of other documents say nothing. Other columns are ignored, whatever their names. No
documents, no rows.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.session import store

WORD_GAP = r"[\x20\x09-\x0D]+"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
MARKS = "[#$%&*|]"
#: Names of the filters, in the order of failures(); the copies come last.
FILTERS = "ABCDE"


def failures(text: Column) -> Column:
    """array<boolean>: what a text fails by itself: too short, too few different words, too many capitals, marks."""
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return F.transform(
        F.array(words),  # so that the words are cut once
        lambda w: F.array(
            F.size(w) < MIN_WORDS,
            100 * F.size(F.array_distinct(w)).cast("long") < DISTINCT_PERCENT * F.size(w).cast("long"),
            100 * capitals.cast("long") > CAPITAL_PERCENT * F.length(text).cast("long"),
            text.rlike(MARKS),
        ),
    )[0]


def failed_sets(docs: DataFrame, part: str) -> DataFrame:
    """part, doc_id and failed (bit i: fails the i-th filter) of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.coalesce(F.col(part), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    bits = F.aggregate("checks", F.lit(0), lambda a, x: a * 2 + x.cast("int"))
    own = own.select("part", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.reverse(failures(F.col("text"))).alias("checks"))
    own = store(own.select("part", "doc_id", "digest", bits.alias("failed")), "filter-checks")
    first = own.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    is_copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    copies = 1 << (len(FILTERS) - 1)
    seen = own.join(first, ["digest", "doc_id"], "left")
    return seen.select("part", "doc_id", (F.col("failed") + F.when(is_copy, copies).otherwise(0)).alias("failed"))


def coalition_table(failed: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """part, total and, by coalition, arrays of the documents, good ones and toxic ones that it removes."""
    said = lambda name: F.max(F.coalesce((F.col(name) == 1), F.lit(False))).alias(name)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(said("quality"), said("toxic"))
    count = lambda name: F.sum(F.coalesce(F.col(name), F.lit(False)).cast("long")).alias(name)
    sets = failed.join(known, "doc_id", "left").groupBy("part", "failed").agg(F.count("*").alias("docs"), count("quality"), count("toxic"))
    removed = lambda name: F.array(*[F.sum(F.when(F.col("failed").bitwiseAND(s) != 0, F.col(name)).otherwise(0)) for s in range(1 << n)])
    return sets.groupBy("part").agg(F.sum("docs").alias("total"), *[removed(name).alias(f"v_{name}") for name in ("docs", "quality", "toxic")])


def solve(rows: list[list[Fraction]], n: int) -> list[list[Fraction]]:
    """Gauss-Jordan elimination on n rows of n coefficients and any number of right sides; returns the solutions."""
    rows = [list(r) for r in rows]
    for i in range(n):
        at = next(k for k in range(i, n) if rows[k][i])
        rows[i], rows[at] = rows[at], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(n):
            if k != i and rows[k][i]:
                rows[k] = [x - rows[k][i] * y for x, y in zip(rows[k], rows[i])]
    return [r[n:] for r in rows]


def shapley_weights(n: int) -> list[list[int]]:
    """For each filter the whole numbers by which the removals of the coalitions add up to n! times its Shapley value."""
    sets = range(1 << n)
    size = [bin(s).count("1") for s in sets]
    weight = [Fraction(n - 1, comb(n, k) * k * (n - k)) if 0 < k < n else Fraction(0) for k in size]
    rows = []
    for i in range(n):
        has = [s for s in sets if s >> i & 1]
        left = [sum((weight[s] for s in has if s >> j & 1), Fraction(0)) for j in range(n)]
        rows.append([*left, Fraction(1), *[weight[s] if s >> i & 1 else Fraction(0) for s in sets]])
    rows.append([*[Fraction(1)] * n, Fraction(0), *[Fraction(int(k == n)) for k in size]])
    scaled = [[x * factorial(n) for x in phi] for phi in solve(rows, n + 1)[:n]]
    if any(x.denominator != 1 for phi in scaled for x in phi):
        raise ArithmeticError("the solution is not whole numbers")
    return [[int(x) for x in phi] for phi in scaled]


def steps(names: str) -> Column:
    """array of all steps of all orders: filter_order, step, at (number of its filter), before (the filters before it)."""
    table = []
    for order in permutations(range(len(names))):
        before = 0
        for k, i in enumerate(order):
            table.append({"filter_order": "".join(names[j] for j in order), "step": k + 1, "at": i, "before": before})
            before |= 1 << i
    return F.from_json(F.lit(json.dumps(table)), "array<struct<filter_order string, step int, at int, before int>>")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row for each part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley (n! times the Shapley value: the filter's removals summed over all orders)."""
    n = len(FILTERS)
    table = coalition_table(failed_sets(docs, part), labels, n)
    value = lambda w: sum((F.lit(x) * F.col("v_docs")[s] for s, x in enumerate(w) if x), F.lit(0))
    table = table.withColumn("phi", F.array(*[value(w) for w in shapley_weights(n)]))
    each = table.select("*", F.inline(steps(FILTERS)))
    each = each.withColumn("bit", F.expr("shiftleft(1, at)")).withColumn("after", F.col("before") + F.col("bit"))
    more = lambda name: F.get(f"v_{name}", F.col("after")) - F.get(f"v_{name}", F.col("before"))
    every = (1 << n) - 1
    return each.select(
        "part", "filter_order", "step",
        (F.col("total") - F.get("v_docs", F.col("after"))).alias("kept"),
        more("docs").alias("removed"),
        (F.get("v_docs", F.col("bit")) - more("docs")).alias("redundant"),
        (F.col("v_docs")[every] - F.get("v_docs", F.lit(every) - F.col("bit"))).alias("unique_fails"),
        more("quality").alias("good_lost"),
        more("toxic").alias("toxic_lost"),
        F.get("phi", F.col("at")).alias("shapley"),
    )
