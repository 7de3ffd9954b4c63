"""Vector searches against scoring every pair, in whole numbers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from redline.llm import hard_negatives, norm_search, vector_blocks

SCHEMA = "vec_id long, embedding array<double>, label int, uid long, norm double, block int, score long, least double"


def scaled(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(256 * x) for x in v]


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def after(row):
    """Order of ties: null ids last."""
    return (row is None, row)


def plain_top(rows, divisor, k):
    own = [(n, i, v) for n, (i, e, _) in enumerate(rows) for v in [scaled(e)] if v is not None]
    out = []
    for n, i, v in own:
        if i is not None and i % divisor == 0:
            best = sorted(((-product(v, w), after(j), j) for m, j, w in own if m != n))[:k]
            out += [(i, rank, j, -s) for rank, (s, _, j) in enumerate(best, 1)]
    return out


def plain_mine(rows, divisor, positives, negatives):
    own = [(n, i, v, y) for n, (i, e, y) in enumerate(rows) for v in [scaled(e)] if v is not None and y is not None]
    out = []
    for n, i, v, y in own:
        if i is None or i % divisor:
            continue
        near = sorted((-product(v, w), after(j), j) for m, j, w, z in own if m != n and z == y)[:positives]
        far = sorted((-product(v, w), after(j), j) for m, j, w, z in own if z != y)
        for s, _, j in near:
            fit = [(t, x) for t, _, x in far if 80 * -s <= 100 * -t <= 100 * -s][:negatives]
            out += [(i, j, rank, x, -s, -t) for rank, (t, x) in enumerate(fit, 1)]
    return out


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, e, y, 7, 0.5, 3, 1, 2.0) for i, e, y in rows], SCHEMA).repartition(parts)


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])


def awkward(seed, n=300, width=12):
    """Clusters of many lengths with exact copies, ties, repeated rows and rows that take no part."""
    draw = random.Random(seed)
    centre = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        length = draw.choice([0.01, 0.2, 1, 1, 1, 4])
        rows.append((i, [length * (c + draw.gauss(0, 0.3)) for c in draw.choice(centre)], draw.randrange(4)))
    same = rows[5][1]
    rows += [(1000 + i, same, draw.randrange(3)) for i in range(120)]
    rows += [(100, same, 1), (100, same, 1), (200, [0.0] * width, 2), (300, [-x for x in same], 0), (None, same, 1), (None, rows[9][1], 2)]
    rows += [(400, None, 1), (500, [None] + same[1:], 1), (600, [math.nan] + same[1:], 2), (700, [math.inf] + same[1:], 2), (800, same[:5], 1), (900, [], 3), (50, same, None)]
    return rows


@pytest.fixture(params=[1, 2])
def small_blocks(request, monkeypatch):
    """Several blocks and steps on a small table."""
    monkeypatch.setattr(vector_blocks, "BLOCK_BYTES", 12 * 8 * (60 if request.param == 1 else 1000))
    monkeypatch.setattr(vector_blocks, "LEAST_ROWS", 100000)
    for module in (norm_search, hard_negatives):
        monkeypatch.setattr(module, "STEP_ROWS", 16 if request.param == 1 else 100)
    monkeypatch.setattr(norm_search, "SEED_ROWS", 20)
    monkeypatch.setattr(norm_search, "ASK_ROWS", 3)
    monkeypatch.setattr(norm_search, "LENGTHS", 2)


def top(df, divisor, k=5):
    got = norm_search.top_k(df, F.col("vec_id") % divisor == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return ordered(tuple(r) for r in got.collect())


def mined(df, divisor, positives=5, negatives=5):
    got = hard_negatives.mine(df, F.col("vec_id") % divisor == 0, F.col("label"), positives, negatives)
    return ordered(tuple(r) for r in got.collect())


def test_top_k_of_awkward_rows(spark, small_blocks):
    rows = awkward(1)
    assert top(table(spark, rows), 10) == ordered(plain_top(rows, 10, 5))


def test_negatives_of_awkward_rows(spark, small_blocks):
    rows = awkward(2)
    want = ordered(plain_mine(rows, 10, 5, 5))
    assert len(want) > 100
    assert mined(table(spark, rows), 10) == want


def test_very_large_components(spark):
    draw = random.Random(3)
    rows = [(i, [draw.uniform(-1, 1) * 2.0 ** draw.randrange(0, 23) for _ in range(6)], i % 2) for i in range(60)]
    assert top(table(spark, rows), 5) == ordered(plain_top(rows, 5, 5))
    assert mined(table(spark, rows), 5) == ordered(plain_mine(rows, 5, 5, 5))
    huge = [(i, [1e12 * (i + 1), 1.0], i % 2) for i in range(4)] + [(5, [1e308, 0.0], 0), (6, [1.0, 2.0], 1)]
    got = top(table(spark, huge), 5, 2)
    assert [r[0] for r in got] == [0, 0] and got[0][3] == 2**63 - 1  # stops at long's end; row 5 isn't finite once scaled


def test_fewer_rows_than_asked_for(spark):
    rows = [(0, [1.0, 2.0], 1), (50, [2.0, 1.0], 1), (3, [0.5, 0.5], 2)]
    assert top(table(spark, rows), 50) == ordered(plain_top(rows, 50, 5))
    assert top(table(spark, rows[:1]), 50) == []
    assert mined(table(spark, rows), 50) == ordered(plain_mine(rows, 50, 5, 5))


def test_empty_tables(spark):
    some = table(spark, awkward(1)[:5])
    for df in (some.where("vec_id = 99"), some.withColumn("embedding", F.lit(None).cast("array<double>"))):
        assert top(df, 10) == [] and mined(df, 10) == []
    assert top(some.where("vec_id > 0"), 1000) == []


def test_a_third_of_all_rows_one_vector(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "LEAST_ROWS", 64)
    draw = random.Random(5)
    rows = [(i, [0.3] * 8 if i % 3 == 0 else [draw.gauss(0, 0.3) for _ in range(8)], 1 if i % 3 == 0 else draw.randrange(5)) for i in range(900)]
    assert top(table(spark, rows), 50) == ordered(plain_top(rows, 50, 5))
    assert mined(table(spark, rows), 100) == ordered(plain_mine(rows, 100, 5, 5))


def test_single_precision_components(spark):
    df = table(spark, awkward(6)[:200]).withColumn("embedding", F.col("embedding").cast("array<float>"))
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert top(df, 10) == ordered(plain_top(rows, 10, 5))
