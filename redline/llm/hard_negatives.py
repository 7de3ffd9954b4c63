"""Hard negatives by a vertical scan: columns of vectors, read in each anchor's own order, until exact windows resolve.

For each anchor the best rows of its own label are its positives; for each positive the negatives are the best rows of
other labels whose score lies in a window below the positive's, low_percent of it or more.

A block keeps its vectors column by column, with each column's smallest and largest value in steps of STEP_ROWS rows. An
anchor reads the columns by its own descending magnitudes, a few at a time. After each few, every candidate has a partial
sum, and the columns still to come can add no less and no more than their extremes times the anchor's components. The
candidates' bitmap shrinks to those whose range can still matter: for positives, range ends at or above the k-th best
range start; for negatives, those that may fall into a window and can reach the k-th best start of the ones certain to
be in it. When all columns are read, the sums of what is left are the exact scores.

Blocks are ranges of labels, so anchors look for positives only in the blocks that hold their label; labels are joined to
their blocks with a salt, as one label may hold a third of all rows. Negatives are looked for in all blocks. Each block
returns its best k at most, of which the best k are taken; all sums are whole numbers, so bounds need no slack.

Defined results: a row without label takes no part. See vector_blocks for vectors that take no part, of mixed lengths, or
with very large components. Rows with a null id are no anchors of a condition on ids; elsewhere they stand after their
ties. Rows that repeat an id are rows of their own. An anchor without positives, and a positive whose window is empty (any
negative score's is), have no rows. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redline.llm import vector_blocks as B
from redline.session import store

POSITIVES = NEGATIVES = 5
LOW_PERCENT = 80
STEP_ROWS = 8192
#: Columns read between two looks at the bounds.
READ = 8
SALTS = 16


class Columns:
    """A block's vectors column by column, to be scanned for one anchor at a time."""

    def __init__(self, table: pa.Table, width: int):
        rows = table.to_batches()[0]
        self.uid, self.ids = rows["uid"].to_numpy(), rows["id"]
        self.tie, self.label = B.order_ids(self.ids), rows["label"].to_numpy()
        self.x = B.matrix(rows["vector"], width)
        self.norm = float(rows["norm"].to_numpy().max())
        self.steps = []
        for first in range(0, len(self.x), STEP_ROWS):
            c = np.ascontiguousarray(self.x[first : first + STEP_ROWS].T)
            self.steps.append((first, c, c.min(axis=1), c.max(axis=1)))

    def scan(self, a: np.ndarray, norm: float, chosen: np.ndarray, windows: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high) the places and scores of the chosen rows in it, the best k among them."""
        if not norm * self.norm < B.EXACT:
            place = np.flatnonzero(chosen)
            score = B.exact_products(a[None], self.x, np.zeros(len(place), np.int64), place, False)
            return [self.best(place[ok], score[ok], k) for low, high in windows for ok in [(score >= low) & (score <= high)]]
        order = np.argsort(-np.abs(a), kind="stable")
        order = order[: np.count_nonzero(a)]  # columns that add nothing
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        least = windows[:, 0].copy()
        for first, c, small, large in self.steps:
            at = np.flatnonzero(chosen[first : first + c.shape[1]])
            if not len(at):
                continue
            ends = np.stack([a[order] * small[order], a[order] * large[order]])
            lows, highs = (np.append(np.cumsum(e[::-1])[::-1], 0.0) for e in (ends.min(axis=0), ends.max(axis=0)))
            part = np.zeros(len(at))
            for done in range(0, len(order) + 1, READ):
                if done:
                    few = order[done - READ : done]
                    part = part + a[few] @ (c[few] if len(at) == c.shape[1] else c[np.ix_(few, at)])
                keep = self.open(part + lows[done], part + highs[done], windows, least, k)
                if not keep.all():
                    at, part = at[keep], part[keep]
                if not len(at):
                    break
            else:
                few = order[len(order) - len(order) % READ :]
                part = part + a[few] @ c[np.ix_(few, at)]
                score = part.astype(np.int64)
                for w, (low, high) in enumerate(windows):
                    ok = (part >= least[w]) & (part <= high)
                    place, own = found[w]
                    found[w] = self.best(np.concatenate([place, first + at[ok]]), np.concatenate([own, score[ok]]), k)
                    if len(found[w][0]) == k:
                        least[w] = max(least[w], found[w][1][-1])
        return found

    def open(self, low: np.ndarray, high: np.ndarray, windows: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
        """Which candidates can still be among the best k of some window; raises least, the score needed for that."""
        keep = np.zeros(len(low), bool)
        for w, (bottom, top) in enumerate(windows):
            sure = low[(low >= least[w]) & (high <= top)]
            if len(sure) >= k:
                least[w] = max(least[w], np.partition(sure, len(sure) - k)[len(sure) - k])
            keep |= (high >= least[w]) & (low <= top)
        return keep

    def best(self, place: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = B.best_rows(np.zeros(len(place), np.int64), score, self.tie[place], k)
        return place[order], score[order]


def scanned(held: DataFrame, asking: DataFrame, blocks: int, width: int, same: bool, k: int) -> DataFrame:
    """uid (of the anchor), top (its window's upper end), other_uid, other_id, score. Asking rows have the columns of held and
    tops, their windows' upper ends as array<long>; without any, one window holds all scores, and top is 0."""

    def build(table):
        columns = Columns(table, width)

        def answer(batch):
            out = []
            vectors, norms = B.matrix(batch["vector"], width), batch["norm"].to_numpy()
            for n, (uid, label, tops) in enumerate(zip(batch["uid"].to_pylist(), batch["label"].to_pylist(), batch["tops"].to_pylist())):
                chosen = columns.label == label
                chosen = chosen & (columns.uid != uid) if same else ~chosen
                windows = np.array([(-(-LOW_PERCENT * t // 100), t) for t in tops] or [(-np.inf, np.inf)], np.float64)
                for w, (place, score) in enumerate(columns.scan(vectors[n], norms[n], chosen, windows, k)):
                    out.append((np.full(len(place), uid), np.full(len(place), tops[w] if tops else 0), place, score))
            if out:
                uid, top, place, score = (np.concatenate(x) for x in zip(*out))
                at = pa.array(place)
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(top), pa.array(columns.uid[place]), columns.ids.take(at), pa.array(score)], names=["uid", "top", "other_uid", "other_id", "score"])

        return answer

    return B.ask(held, asking, blocks, build, "uid long, top long, other_uid long, other_id long, score long")


def mine(vectors: DataFrame, anchors: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, key: str = "vec_id", vector: str = "embedding", scale: int = B.SCALE) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score for the rows that the condition
    anchors holds for."""
    vectors = vectors.where(label.isNotNull())
    blocks, width = B.layout(vectors, vector)
    rows = B.packed(vectors, key, vector, scale, {"label": label.cast("long"), "asks": F.coalesce(anchors, F.lit(False))})
    held, blocks = B.dealt(rows.where("label IS NOT NULL"), blocks, F.col("label"), F.xxhash64("uid"), F.col("uid"))
    first = held.where("asks").drop("asks", "block")
    held = held.drop("asks")

    near = held.select("label", "block").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asking = first.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")).join(near, ["label", "salt"]).drop("salt")
    asking = asking.withColumn("tops", F.expr("cast(array() AS array<bigint>)"))
    best = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other_uid")
    chosen = scanned(held, asking, blocks, width, True, positives).withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    chosen = store(chosen.select("uid", F.col("other_id").alias("positive_id"), F.col("score").alias("top"), "place"), "positives")

    tops = chosen.where("top >= 0").groupBy("uid").agg(F.sort_array(F.collect_set("top")).alias("tops"))
    asking = first.join(tops, "uid").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    best = Window.partitionBy("uid", "top").orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other_uid")
    found = scanned(held, asking, blocks, width, False, negatives).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    pairs = chosen.join(found, ["uid", "top"]).join(first.select("uid", F.col("id").alias("anchor_id")), "uid")
    return pairs.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), F.col("top").alias("positive_score"), F.col("score").alias("negative_score"))
