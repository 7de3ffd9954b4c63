"""Exact top-k search by inner product: blocks of vectors by descending length, rotated partial sums, residual bounds.

Vectors are dealt into blocks by descending length, so the blocks that can hold a result of a query are always the first
ones. All vectors are turned by the right singular vectors of the whole table (the eigenvectors of its Gram matrix, which
is added up from every row), so that the first places hold as much of the length as they can. Inner products don't change
by that; after the first c places the rest of a product is at most the product of both residual lengths (Cauchy-Schwarz).

1. The longest vectors, a bounded number, are broadcast; each query's k-th best product among them is its first threshold.
2. A query is sent to the blocks whose longest vector could still reach its threshold.
3. A block is passed in steps of descending length. A query leaves it when the length bound falls below its threshold; a
   pair is dropped when partial sum and residual bound do. What is left is scored exactly, in whole numbers of the
   vectors as they came, and raises the threshold.
4. The best k of all blocks' best k are the result.

Bounds allow for rounding, and are only ever compared strictly, so ties are kept; exact scores decide.

Defined results: see vector_blocks for vectors that take no part, of mixed lengths, or with very large components (scores
stop at the ends of long). A row with a null id is never a query of a condition on ids; as a candidate it stands after its
ties. Rows that repeat an id are rows of their own: each is a candidate of the other, and each asks for itself. With fewer
than k candidates all are returned. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redline.llm import vector_blocks as B

K = 5
#: The vectors of the first thresholds: so many rows, and so many bytes, at most.
SEED_ROWS, SEED_BYTES = 4096, 16 << 20
STEP_ROWS = 4096
ASK_ROWS = 512
#: Parts of a vector's places after which bounds are looked at.
CUTS = (0.25, 0.5, 0.75)
#: Entries of the list of block lengths that the driver holds.
LENGTHS = 4096
SLACK = 1e-9


def gram(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of the outer products of all vectors; each task sends one triangle."""
    i, j = np.triu_indices(width)

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = B.matrix(batch.column(0), width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "g"])

    sums = rows.select("vector").mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
    out = np.zeros((width, width))
    out[sums.i, sums.j] = sums.g
    return out + np.triu(out, 1).T


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of the table, the strongest first. Sums that aren't finite turn nothing."""
    g = gram(rows, width)
    return np.linalg.eigh(g)[1][:, ::-1] if np.isfinite(g).all() else np.eye(width)


class Block:
    """Vectors by descending length, to be asked for their best k inner products."""

    def __init__(self, uid: np.ndarray, ids: pa.Array, x: np.ndarray, norm: np.ndarray, turn: np.ndarray, k: int):
        order = np.argsort(-norm, kind="stable")
        self.uid, self.ids, self.x, self.norm, self.turn, self.k = uid[order], ids.take(pa.array(order)), x[order], norm[order], turn, k
        self.tie = B.order_ids(self.ids)
        self.cuts = sorted({max(1, round(x.shape[1] * c)) for c in CUTS})
        self.r, self.rest = self.turned(self.x)

    def turned(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The turned vectors, and their lengths after each cut."""
        with np.errstate(over="ignore", invalid="ignore"):
            r = x @ self.turn
            return r, [np.sqrt(np.einsum("ij,ij->i", r[:, c:], r[:, c:])) for c in self.cuts]

    def ask(self, uid: np.ndarray, q: np.ndarray, norm: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place here, score) of each query's k best rows but its own that score least or more."""
        r, rest = self.turned(q)
        least = least.astype(np.float64).copy()
        found = [np.zeros(0, np.int64)] * 3
        for first in range(0, len(self.x), STEP_ROWS):
            top = self.norm[first] * norm * (1 + SLACK) + 1e-6
            who = np.flatnonzero(~(top < least))
            if not len(who):
                break
            found, least = self.step(first, who, uid, q, r, rest, norm, least, found)
        return tuple(found)

    def step(self, first, who, uid, q, r, rest, norm, least, found):
        cols = np.arange(first, min(first + STEP_ROWS, len(self.x)))
        rows, part, at = who, 0.0, 0
        with np.errstate(over="ignore", invalid="ignore"):
            for n, cut in enumerate(self.cuts):
                part = part + r[rows, at:cut] @ self.r[cols, at:cut].T
                room = least[rows] - norm[rows] * self.norm[first] * SLACK - 1e-6
                alive = ~(part + np.outer(rest[n][rows], self.rest[n][cols]) < room[:, None])
                some, at = alive.any(axis=1), cut
                if not some.any():
                    return found, least
                ones = alive.any(axis=0)
                rows, cols, part, alive = rows[some], cols[ones], part[np.ix_(some, ones)], alive[np.ix_(some, ones)]
        safe = float(norm[rows].max()) * float(self.norm[first]) < B.EXACT
        if safe and alive.mean() > 0.125:
            score = (q[rows] @ self.x[cols].T).astype(np.int64)
            i, j = np.nonzero(alive & (score >= least[rows][:, None]))
            score = score[i, j]
        else:
            i, j = np.nonzero(alive)
            score = B.exact_products(q, self.x, rows[i], cols[j], safe)
        i, j = rows[i], cols[j]
        good = (score >= least[i]) & (self.uid[j] != uid[i])
        owner, place, score = (np.concatenate([a, b[good]]) for a, b in zip(found, (i, j, score)))
        best = B.best_rows(owner, score, self.tie[place], self.k)
        found = [owner[best], place[best], score[best]]
        full = np.flatnonzero(np.bincount(found[0], minlength=len(least)) == self.k)
        last = np.searchsorted(found[0], full, "right") - 1
        least[full] = np.maximum(least[full], found[2][last])
        return found, least


def _asked(batch: pa.RecordBatch, width: int, least: np.ndarray):
    """The rows asking, a few at a time: (first row, arguments of Block.ask)."""
    for first in range(0, len(batch), ASK_ROWS):
        some = batch.slice(first, ASK_ROWS)
        yield first, some.column("uid").to_numpy(), B.matrix(some.column("vector"), width), some.column("norm").to_numpy(), least[first : first + ASK_ROWS]


def seeded(asking: DataFrame, held: DataFrame, lengths: list[float], width: int, turn, k: int) -> DataFrame:
    """The queries with least, their k-th best product among the longest vectors, whose number and bytes are bounded, and
    reached, how many of the descending lengths may reach it."""
    top = held.orderBy(F.desc("norm"), "uid").select("uid", "id", "vector", "norm").limit(max(k + 1, min(SEED_ROWS, SEED_BYTES // (8 * width)))).toArrow()
    longest = asking.sparkSession.sparkContext.broadcast(top.combine_chunks())
    names = asking.columns

    def run(batches):
        rows = longest.value.to_batches()[0]
        block = Block(rows["uid"].to_numpy(), rows["id"], B.matrix(rows["vector"], width), rows["norm"].to_numpy(), turn.value, k)
        for batch in batches:
            least, reached = np.full(len(batch), -np.inf), np.zeros(len(batch), np.int32)
            for first, *query in _asked(batch, width, least):
                owner, _, score = block.ask(*query)
                full = np.flatnonzero(np.bincount(owner, minlength=len(query[0])) == k)
                least[first + full] = score[np.searchsorted(owner, full, "right") - 1]
                cut = slice(first, first + len(query[0]))
                with np.errstate(over="ignore", invalid="ignore"):
                    reached[cut] = (~(np.outer(query[2], lengths) * (1 + SLACK) + 1e-6 < least[cut, None])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least), pa.array(reached)], names=[*names, "least", "reached"])

    return asking.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in asking.dtypes) + ", least double, reached int")


def top_k(vectors: DataFrame, queries: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", scale: int = B.SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that the condition queries holds for, its k best other rows."""
    blocks, width = B.layout(vectors, vector)
    rows = B.packed(vectors, key, vector, scale, {"asks": F.coalesce(queries, F.lit(False))})
    held, blocks = B.dealt(rows, blocks, F.desc("norm"), F.xxhash64("uid"), F.col("uid"))
    spark = vectors.sparkSession
    schema = "query_uid long, query_id long, vec_id long, score long"
    asking = held.where("asks")
    if asking.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = spark.sparkContext.broadcast(rotation(held, width))
    every = -(-blocks // LENGTHS)
    lengths = held.groupBy(F.expr(f"block div {every}").alias("run")).agg(F.max("norm").alias("norm")).orderBy("run").collect()
    asking = seeded(asking.select("uid", "id", "vector", "norm"), held, [r["norm"] for r in lengths], width, turn, k)
    last = F.least(F.lit(blocks), F.greatest("reached", F.lit(1)) * every) - 1
    asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0), last))).drop("reached")

    def build(table: pa.Table):
        rows = table.to_batches()[0]
        block = Block(rows["uid"].to_numpy(), rows["id"], B.matrix(rows["vector"], width), rows["norm"].to_numpy(), turn.value, k)

        def answer(batch):
            for first, *query in _asked(batch, width, batch["least"].to_numpy()):
                owner, place, score = block.ask(*query)
                of = pa.array(first + owner)
                yield pa.RecordBatch.from_arrays([batch["uid"].take(of), batch["id"].take(of), block.ids.take(pa.array(place)), pa.array(score)], names=["query_uid", "query_id", "vec_id", "score"])

        return answer

    got = B.ask(held.drop("asks"), asking, blocks, build, schema)
    best = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
