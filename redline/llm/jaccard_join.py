"""Exact Jaccard self-join of documents on word shingles, with a token-group matrix.

A document's set holds its distinct shingles of SHINGLE consecutive words, A-Z lower-cased; a shorter text is one shingle.
Two documents link when PERCENT * union <= 100 * intersection. The result is each document's component.

1. Equal sets are one class, told apart by a 128-bit fingerprint; from here on a class counts once.
2. Blocks of classes ask shards about their shingles: in how many classes does each occur? A class of n shingles can link
   only if at least PERCENT% of them occur elsewhere; the others (most) are done. For the rest, shingles are put in order,
   rarest first.
3. Prefix filter: linked sets share one of the first n - ceil(PERCENT% n) + 1 shingles of either. Of all classes that hold
   a shingle there, the one with the largest share of recurring shingles is the centre; each class is verified against
   its centres. So a family of copies costs a row for each copy, not each pair. Links make components.
4. The matrix. Classes of one component and about one size are cut into groups of about GROUP; a group stores the union of its members'
   shingles. Where components still share a prefix shingle, the classes of the smaller one query the groups of the larger:
   the overlap with the union bounds the overlap with any member, and only groups that the bound lets through are opened
   and their members compared. Any pair that could still link two components is covered, so the components are exact.
   Hot groups are split by query, the members being copied to each part.

Defined results: texts without words, null or empty, have no shingles and are their own component; a null doc_id has
its component's smallest id (null if none has one). Repeated rows are documents of their own in equal sets. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.llm import block_exchange as X
from redline.llm import words as W
from redline.llm.components import components
from redline.session import store

SHINGLE = 4
PERCENT = 85
GROUP = 64
#: Sets of a group differ in size by so much at most, as a share.
BAND = 0.02
QUERIES_EACH = 512
#: Documents whose shingles a task holds at a time while it fingerprints them.
ROWS_EACH = 512
SETS = "doc_id long, tie long, n long, f1 long, f2 long, text string"
SURVIVORS = "cls long, n long, recurring long, tokens binary, prefix array<bigint>"


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, cuts): text i's sorted distinct shingle hashes are shingles[cuts[i]:cuts[i + 1]]."""
    out, sizes = [], []
    for _, _, data, offsets in W.text_chunks(texts):
        data = W.LOWER[data]
        starts, ends, bounds = W.word_spans(data, offsets)
        h = W.span_hashes(data, starts, ends)
        at = np.flatnonzero(W.inside_text(bounds, shingle, len(h)))
        text, value = [W.text_of(bounds)[at]], [W.ngram_hashes(h, shingle)[at]]
        count = np.diff(bounds)
        for n in range(1, shingle):  # whole texts of fewer words
            short = np.flatnonzero(count == n)
            text.append(short)
            value.append(W.ngram_hashes(h, n)[bounds[short]] if len(short) else np.zeros(0, np.uint64))
        text, value = np.concatenate(text), np.concatenate(value)
        order = np.lexsort((value, text))
        text, value = text[order], value[order]
        new = np.append(True, (text[1:] != text[:-1]) | (value[1:] != value[:-1])) if len(text) else np.zeros(0, bool)
        out.append(value[new])
        sizes.append(np.bincount(text[new], minlength=len(offsets) - 1))
    return (np.concatenate(out), np.append(0, np.cumsum(np.concatenate(sizes)))) if out else (np.zeros(0, np.uint64), np.zeros(1, np.int64))


def fingerprints(shingles: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Two 64-bit fingerprints of each set (rows), independent of order."""
    full = np.flatnonzero(np.diff(cuts))
    out = np.zeros((2, len(cuts) - 1), np.int64)
    for k, salt in enumerate((W.U(0x243F6A8885A308D3), W.U(0x13198A2E03707344))):
        if len(full):
            out[k][full] = W.mix(np.add.reduceat(W.mix(shingles ^ salt), cuts[full])).view(np.int64)
    return out


def fingerprinted(docs: DataFrame, shingle: int, with_text: bool) -> DataFrame:
    """doc_id, tie (hash of the text), n, f1, f2 of each document; with_text: only rows with shingles, and of equal sets only the first that a
    task meets, with its text."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in (whole.slice(i, ROWS_EACH) for whole in batches for i in range(0, whole.num_rows, ROWS_EACH)):
            shingles, cuts = shingle_sets(batch.column(2), shingle)
            f1, f2 = fingerprints(shingles, cuts)
            n = np.diff(cuts).astype(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(n), pa.array(f1), pa.array(f2)]
            if with_text:
                keep = []
                for i, pair in enumerate(zip(f1.tolist(), f2.tolist())):
                    if n[i] and pair not in seen:
                        seen.add(pair)
                        keep.append(i)
                yield pa.RecordBatch.from_arrays(columns + [batch.column(2)], names=["doc_id", "tie", "n", "f1", "f2", "text"]).take(pa.array(keep, pa.int64()))
            else:
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "n", "f1", "f2"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return some.mapInArrow(run, SETS if with_text else SETS.removesuffix(", text string"))


class BlockSets:
    """The distinct sets of a block."""

    def __init__(self, table: pa.Table, shingle: int):
        f1, f2 = table.column("f1").to_numpy(), table.column("f2").to_numpy()
        order = np.lexsort((f2, f1))
        new = np.append(True, (np.diff(f1[order]) != 0) | (np.diff(f2[order]) != 0))
        table = table.take(pa.array(order[new]))
        self.cls = table.column("f1").to_numpy()
        self.shingles, self.cuts = shingle_sets(table.column("text"), shingle)
        self.values, self.place, self.times = np.unique(self.shingles, return_inverse=True, return_counts=True)


def least_overlap(n: np.ndarray | int, percent: int):
    """A set of n shingles shares at least so many with any it links to."""
    return -(-percent * n // 100)


def survivors_of(sets: BlockSets, level: np.ndarray, percent: int) -> pa.Table:
    """The classes that may link, their shingles in global order, rarest first, and the recurring ones of the prefix.
    level: how common each distinct shingle is, 0 for one class only."""
    n = np.diff(sets.cuts)
    level = level[sets.place].astype(np.int64)
    recurring = np.add.reduceat(level > 0, sets.cuts[:-1]) if len(n) else np.zeros(0, np.int64)
    rows = []
    for i in np.flatnonzero(recurring >= least_overlap(n, percent)).tolist():
        a, b = sets.cuts[i], sets.cuts[i + 1]
        mine, mine_level = sets.shingles[a:b], level[a:b]
        first = np.lexsort((mine, mine_level))[: n[i] - least_overlap(int(n[i]), percent) + 1]
        prefix = mine[first][mine_level[first] > 0].view(np.int64)
        rows.append((int(sets.cls[i]), int(n[i]), int(recurring[i]), mine.tobytes(), prefix))
    cols = list(zip(*rows)) or [[]] * 5
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    return pa.table([pa.array(list(c), t) for c, t in zip(cols, types)], names=["cls", "n", "recurring", "tokens", "prefix"])


def survivors(docs: DataFrame, shingle: int, percent: int, block_bytes: int) -> DataFrame:
    blocks, shards = X.counts(X.text_bytes(docs), block_bytes)
    tasks = X.tasks(docs)
    block = F.pmod(F.col("f1"), F.lit(blocks)).cast("int")
    text = X.blocked(fingerprinted(docs, shingle, True).select("f1", "f2", "text", block.alias("block"))).groupBy("block")

    def ask(key, table):
        sets = BlockSets(table, shingle)
        return X.questions(key[0].as_py(), sets.values, shards, 4, np.minimum(sets.times, 65535).astype("<u2"))

    def count(key, table):
        asked = X.Asked(table, "<u2")
        total = np.add.reduceat(asked.extra[asked.order], asked.first, dtype=np.int64)
        level = np.minimum(np.round(8 * np.log2(total)), 255).astype("u1")
        return asked.answers(key[0].as_py(), asked.entries(level))

    def keep(key, table, replies):
        sets = BlockSets(table, shingle)
        return survivors_of(sets, X.answered(replies, sets.values, shards, "u1"), percent)

    levels = text.applyInArrow(ask, X.QUESTIONS).repartition(tasks, "shard").groupBy("shard").applyInArrow(count, "block int, shard int, answer binary")
    return text.cogroup(levels.repartition(tasks, "block").groupBy("block")).applyInArrow(keep, SURVIVORS)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Do two sorted sets link?"""
    if not percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _set(tokens: bytes) -> np.ndarray:
    return np.frombuffer(tokens, np.uint64)


def centre_links(kept: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) between classes and the centres of their prefix shingles."""
    prefix = kept.select("cls", "n", "recurring", F.explode("prefix").alias("shingle"))
    best = F.max(F.struct((F.col("recurring") / F.col("n")).alias("share"), "cls", "n"))
    centre = prefix.groupBy("shingle").agg(best.alias("best")).select("shingle", F.col("best.cls").alias("centre"), F.col("best.n").alias("centre_n"))
    fits = (F.col("cls") != F.col("centre")) & (F.greatest("n", "centre_n") * percent <= F.least("n", "centre_n") * 100)
    pairs = prefix.join(centre, "shingle").where(fits).select("cls", "centre").distinct()
    sets = kept.select("cls", "tokens")
    both = pairs.join(sets, "cls").join(sets.select(F.col("cls").alias("centre"), F.col("tokens").alias("centre_tokens")), "centre")

    def verify(batches):
        for batch in batches:
            ok = [linked(_set(x), _set(y), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(ok, pa.bool_())).columns[:2], names=["a", "b"])

    return both.select("cls", "centre", "tokens", "centre_tokens").mapInArrow(verify, "a long, b long")


def matrix_links(kept: DataFrame, comps: DataFrame, percent: int, group: int) -> DataFrame:
    """Verified links between classes of different components: queries against groups, bounded by the groups' unions."""
    # sets of a group have about one size, so that the size bounds are sharp
    placed = kept.join(comps, "cls").withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.0 + BAND))).cast("int"))
    bands = placed.groupBy("comp", "band").agg(F.count("*").alias("band_size"))
    sized = bands.join(bands.groupBy("comp").agg(F.sum("band_size").alias("size")), "comp")
    part = F.pmod(F.xxhash64("cls"), F.ceil(F.col("band_size") / group)).cast("int")
    placed = placed.join(sized, ["comp", "band"]).withColumn("part", part)
    prefix = placed.select("cls", "n", "recurring", "comp", "size", "band", "part", F.explode("prefix").alias("shingle"))
    shared = prefix.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("shingle")
    open_ = prefix.join(shared, "shingle", "left_semi")
    # a link of sizes n and m shares percent (n + m) / (100 + percent) shingles at least; room: what is left of that for n
    room = F.max(F.col("recurring") * (100 + percent) - F.col("n") * percent)
    groups = open_.groupBy("shingle", "comp", "size", "band", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"), room.alias("room"))
    groups = groups.select("shingle", *[F.col(c).alias(f"g_{c}") for c in ("comp", "size", "band", "part")], "least", "most", "room")
    smallest = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    may = (
        (F.struct("size", "comp") < F.struct("g_size", "g_comp")) & (F.col("n") * 100 >= F.col("least") * percent) & (F.col("n") * percent <= F.col("most") * 100)
        & (F.col("recurring") * (100 + percent) >= (F.col("n") + smallest) * percent) & (F.col("room") >= F.col("n") * percent)
    )
    keys = ["g_comp", "g_band", "g_part"]
    asks = open_.join(groups, "shingle").where(may).select("cls", *keys).distinct()
    asks = store(asks, "matrix-queries")
    loads = asks.groupBy(*keys).agg(F.ceil(F.count("*") / QUERIES_EACH).cast("int").alias("splits"))
    sets = kept.select("cls", "tokens")
    query = asks.join(loads, keys).join(sets, "cls")
    query = query.select(*keys, F.pmod(F.xxhash64("cls"), F.col("splits")).cast("int").alias("split"), "cls", "tokens")
    members = placed.select(*[F.col(k.removeprefix("g_")).alias(k) for k in keys], "cls", "tokens").join(loads, keys)
    members = members.select(*keys, F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), F.col("cls").alias("member"), F.col("tokens").alias("member_tokens"))

    def open_groups(key, queries, own):
        names, sets_of = own.column("member").to_pylist(), [_set(x) for x in own.column("member_tokens").to_pylist()]
        union = np.unique(np.concatenate(sets_of)) if sets_of else np.zeros(0, np.uint64)
        least, found = min(map(len, sets_of), default=0), []
        for cls, tokens in zip(queries.column("cls").to_pylist(), queries.column("tokens").to_pylist()):
            x = _set(tokens)
            at = np.searchsorted(union, x)
            at[at == len(union)] = 0
            bound = int((union[at] == x).sum()) if len(union) else 0
            if bound * (100 + percent) < percent * (len(x) + max(least, least_overlap(len(x), percent))):
                continue
            for name, y in zip(names, sets_of):
                if linked(x, y, percent):
                    found.append((cls, name))
                    break
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    keys = [*keys, "split"]
    return query.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(open_groups, "a long, b long")


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, group: int = GROUP, block_bytes: int = X.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the component), and, to tell rows and components apart where
    ids don't, tie (hash of the text) and comp (null without words), of each document. percent is a whole number, 1 to
    100: the share of the union, in hundredths, that linked sets have in common."""
    sets = store(fingerprinted(docs, shingle, False), "shingle-sets")
    kept = store(survivors(docs, shingle, percent, block_bytes), "shingle-survivors")
    nodes = kept.select("cls")
    first = store(centre_links(kept, percent), "centre-links")
    comps = components(nodes, first)
    more = store(matrix_links(kept, comps, percent, group), "matrix-links")
    comps = components(nodes, first.union(more))
    full = sets.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("first_id"))
    full = full.join(comps.select(F.col("cls").alias("f1"), "comp"), "f1", "left").withColumn("comp", F.coalesce("comp", "f1"))
    least = full.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = full.join(least, "comp").select("f1", "f2", "comp", "component_id")
    out = sets.join(named, ["f1", "f2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "tie", "comp")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The documents, with all their columns, that come first in their component: by doc_id (null last), then by hash of
    the text, and of equal rows one. Documents without words all stay."""
    named = jaccard_components(docs, **how)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")
    first = named.where("comp is not null").groupBy("comp").agg(F.min(rank).alias("r")).select(F.col("r.doc_id").alias("_first_id"), F.col("r.tie").alias("_first_tie"))
    first = first.distinct()
    tie = F.xxhash64("text")
    worded = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("_tie", tie)
    match = worded["doc_id"].cast("long").eqNullSafe(F.col("_first_id")) & (F.col("_tie") == F.col("_first_tie"))
    winners = worded.join(first, match, "left_semi").dropDuplicates(["doc_id", "_tie"]).drop("_tie")
    empty = docs.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return winners.unionByName(empty)
