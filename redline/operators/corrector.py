"""Pluggable correctors: stateless first passes and a sequential pass where each text sees the one before."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redline import vocab as V
from redline.functions import edits
from redline.functions.text import ends_abruptly, strip
from redline.operators.match import merge_patches
from redline.operators.ordered import BLOCK, by_document, dense
from redline.operators.structure import seed_before
from redline.operators.triage import fence
from redline.session import store

# (text, previous corrected text or None) -> corrected text
Corrector = Callable[[str, "str | None"], str]
RESULT = "doc_id long, batch_index int, paragraph_index int, original_text string, corrected_text string, context string, head_text string, is_tail boolean"


def first_pass_all(paragraphs: DataFrame, rules: list[tuple] = V.EDIT_RULES, off: Column | None = None) -> DataFrame:
    """Rule pass over every paragraph at once, with the log of its edits (places in the stripped text); short ones are
    marked skipped and kept as they are. ``off``: ids of the rules that are switched off for a row."""
    rows = paragraphs.withColumn("_t", strip(F.col("text"))).withColumn("_skip", F.length("_t") < 3)
    rows = fence(rows.withColumn("_f", F.when(~F.col("_skip"), edits.fix(F.col("_t"), rules, off))), ["_f"])
    return rows.select(
        *paragraphs.columns, F.col("_skip").alias("skipped"), F.coalesce("_f.text", "text").alias("corrected_text"),
        F.coalesce("_f.ops", F.array().cast(f"array<{edits.EDIT}>")).alias("ops"),
    )


def block_pass(blocks: DataFrame, rules: list[tuple] = V.EDIT_RULES) -> DataFrame:
    """The same rules on page blocks; only blocks whose text changes are returned."""
    rows = first_pass_all(blocks.withColumn("text", F.col("block_text")), rules)
    return rows.filter("not skipped and corrected_text <> block_text").drop("text", "skipped")


def assign_batches(paragraphs: DataFrame, batches: DataFrame) -> DataFrame:
    """Batch of each paragraph: that of the last batch start up to it, -1 before the first. Paragraphs and starts are dealt by
    document as one table and stay so, in order."""
    starts = batches.select("doc_id", F.col("start_paragraph").alias("paragraph_index"), "batch_index")
    rows = by_document(paragraphs.withColumn("_row", F.lit(True)).unionByName(starts, allowMissingColumns=True))
    upto = Window.partitionBy("doc_id").orderBy("paragraph_index").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("batch_index", F.coalesce(F.max("batch_index").over(upto), F.lit(-1)).cast("int"))
    return rows.filter("_row").drop("_row")


def correct_batches(pass0: DataFrame, batches: DataFrame, corrector: Corrector) -> DataFrame:
    """Run a corrector over each batch in order, giving it the text it corrected just before.

    A batch is sequential by nature and may be as long as its longest section, so rows are sorted by place and stream through
    the task: only the previous text is held, whatever the batch's length. Documents are dealt once and their batches run
    where they are; the batches of documents of more than a block of paragraphs are dealt again, to run side by side.
    ``head_text`` is what the corrector got, for the first text of a batch, and ``is_tail`` marks the last one.
    """
    order = Window.partitionBy("doc_id").orderBy("paragraph_index")
    rows = assign_batches(pass0, batches).filter("batch_index >= 0")
    first = F.coalesce(F.lag("batch_index").over(order) != F.col("batch_index"), F.lit(False))
    # The seed of a batch rides on its first paragraph, usable or not.
    rows = rows.withColumns({"_first": first, "seed": seed_before(order)}).select(
        "doc_id", "batch_index", "paragraph_index", "stripped", "pass0_text", F.when(F.col("_first"), F.col("seed")).alias("seed"),
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [field.split()[0] for field in RESULT.split(", ")]
        batch = previous = held = None
        head = True
        for pdf in parts:
            done = []
            for doc_id, index, place, text, given, seed in zip(*(pdf[c] for c in pdf)):
                if (doc_id, index) != batch:
                    batch, previous, head = (doc_id, index), seed if isinstance(seed, str) else None, True
                if not text or len(text) < 3:
                    continue
                if held:  # the last of its batch, if another batch follows
                    done.append((*held, held[:2] != batch))
                made = corrector(given, previous)
                held = (doc_id, index, place, text, made, previous, given if head else None)
                previous, head = made, False
            if done:
                yield pd.DataFrame(done, columns=names)
        if held:
            yield pd.DataFrame([(*held, True)], columns=names)

    by_place = ["doc_id", "paragraph_index"]
    longest = batches.agg(F.max("end_paragraph")).first()[0]
    if longest is None or longest < BLOCK:
        return rows.sortWithinPartitions(*by_place).mapInPandas(run, RESULT)
    rows = rows.withColumn("_long", F.max("paragraph_index").over(Window.partitionBy("doc_id")) >= BLOCK)
    short = rows.filter("not _long").drop("_long").sortWithinPartitions(*by_place)
    long = rows.filter("_long").drop("_long").repartition("doc_id", "batch_index").sortWithinPartitions("doc_id", "batch_index", "paragraph_index")
    return short.mapInPandas(run, RESULT).unionByName(long.mapInPandas(run, RESULT))


def to_assemble(corrected: DataFrame) -> DataFrame:
    """What repaired_heads and assembled_patches read of the corrected batches: their first and last texts, and all that changed."""
    head = F.col("head_text").isNotNull()
    kept = corrected.filter(head | F.col("is_tail") | (F.col("corrected_text") != F.col("original_text")))
    return kept.withColumn("context", F.when(head, F.col("context")))


def stock_corrector(text: str, previous: str | None) -> str:
    """Rule-table stand-in: lower the capital of a text that continues an unfinished one."""
    if previous and text and previous[-1:] not in '.?!:)"»\n':
        return text[0].lower() + text[1:]
    return text


def boundary_check(batches: DataFrame, pass0: DataFrame, corrected: DataFrame) -> DataFrame:
    """Batch heads whose approximate seed (rule-corrected text before, if usable) differs from the real one: the last text of the
    batch before, or of the last one before that holds any; empty where none does. ``corrected`` has doc_id,
    paragraph_index, final_text."""
    usable = pass0.filter(F.length("stripped") >= 3).select("doc_id", "paragraph_index")
    placed = assign_batches(pass0.select("doc_id", "paragraph_index", "stripped"), batches)
    heads = placed.filter(F.length("stripped") >= 3).groupBy("doc_id", "batch_index").agg(
        F.min("paragraph_index").alias("head"), F.max("paragraph_index").alias("tail")
    )
    heads = dense(heads, ["doc_id"], "batch_index", "place")
    texts = corrected.join(usable, ["doc_id", "paragraph_index"], "left_semi").select(
        "doc_id", F.col("paragraph_index").alias("tail"), F.left("final_text", F.lit(200)).alias("real_seed")
    )
    real = heads.join(texts, ["doc_id", "tail"]).select("doc_id", (F.col("place") + 1).alias("place"), "real_seed")
    before = pass0.filter(F.length("stripped") >= 3).select(
        "doc_id", (F.col("paragraph_index") + 1).alias("head"), F.left("pass0_text", F.lit(200)).alias("approx_seed")
    )
    seeds = [F.coalesce("real_seed", F.lit("")).alias("real_seed"), F.coalesce("approx_seed", F.lit("")).alias("approx_seed")]
    return (
        heads.filter("batch_index > 0").join(real, ["doc_id", "place"], "left")
        .join(before, ["doc_id", "head"], "left")
        .select("doc_id", "batch_index", F.col("head").alias("paragraph_index"), *seeds)
        .withColumn("rerun", F.col("real_seed") != F.col("approx_seed"))
    )


SEED = 200
HEAD = "doc_id long, place long, seed string, head_out string"


def repaired_heads(corrected: DataFrame, pass0: DataFrame, corrector: Corrector) -> DataFrame:
    """The first text of every batch, corrected after the text that really comes before it.

    Batches run side by side, each from an approximate seed; ``corrected`` is what they made (see correct_batches). A head
    whose seed isn't the last corrected text before it, be that several batches back when those between hold none, is
    corrected again with it. That changes what the next batch should have seen only where the head is all there is of its
    batch, so only the heads after those are looked at again, until none is left. ``pass0`` holds the heads' pass0_text, other
    rows don't matter. Returns doc_id, batch_index, paragraph_index, original_text, corrected_text of the heads that were corrected again.
    """
    edges = corrected.filter("head_text is not null or is_tail")
    ends = by_document(edges.select("doc_id", "batch_index", "paragraph_index", "context", "corrected_text", "original_text")).groupBy("doc_id", "batch_index").agg(
        F.min("paragraph_index").alias("head"), F.max("paragraph_index").alias("tail"),
        F.min_by(F.struct("context", "original_text"), "paragraph_index").alias("_h"),
        F.max_by(F.left("corrected_text", F.lit(SEED)), "paragraph_index").alias("tail_out"),
    )
    order = Window.partitionBy("doc_id").orderBy("batch_index")
    texts = pass0.select("doc_id", F.col("paragraph_index").alias("head"), "pass0_text")
    key = ["doc_id", "place"]
    # Nothing comes before the first text of a document: it gives its successor a text, and is never corrected again.
    state = ends.withColumns({"place": F.row_number().over(order).cast("long"), "real": F.lag("tail_out").over(order)}).filter("place > 1")
    state = store(state.join(texts, ["doc_id", "head"]).select(
        *key, "batch_index", "head", (F.col("head") == F.col("tail")).alias("alone"), "pass0_text", F.col("_h.original_text").alias("original_text"),
        F.coalesce("_h.context", F.lit("")).alias("seed"), "real",
    ), "batch-heads")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = [corrector(text, seed) for text, seed in zip(pdf["pass0_text"], pdf["real"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "place": pdf["place"], "seed": pdf["real"], "head_out": out})

    again, wrong = None, state.filter("real <> seed")
    for number in itertools.count():
        made = store(wrong.select(*key, "pass0_text", "real").mapInPandas(run, HEAD), "heads-again").withColumn("_round", F.lit(number))
        if made.isEmpty():
            break
        again = made if again is None else again.unionByName(made)
        latest = again.groupBy(*key).agg(F.max_by(F.struct("seed", "head_out"), "_round").alias("_a")).select(*key, "_a.*")
        moved = made.join(state.filter("alone").select(*key), key, "left_semi").select(
            "doc_id", (F.col("place") + 1).alias("place"), F.left("head_out", F.lit(SEED)).alias("_real")
        )
        seen = latest.select(*key, F.col("seed").alias("_seen"))
        wrong = state.join(moved, key).join(seen, key, "left").filter(F.col("_real") != F.coalesce("_seen", "real")).withColumn("real", F.col("_real"))
    done = state.drop("seed").join(latest, key) if again is not None else state.filter("false").withColumn("head_out", F.col("pass0_text"))
    return done.select("doc_id", "batch_index", F.col("head").alias("paragraph_index"), "original_text", F.col("head_out").alias("corrected_text"))


def assembled_patches(corrected: DataFrame, again: DataFrame) -> DataFrame:
    """The batches' patches with those of the repaired heads merged in, in document order and numbered in it."""
    patch = F.when(F.col("corrected_text") != F.col("original_text"), F.col("corrected_text"))
    base = corrected.withColumn("corrected_text", patch).filter("corrected_text is not null")
    merged = merge_patches(base, again.withColumn("corrected_text", patch)).filter("action <> 'drop'")
    rows = dense(merged, ["doc_id"], "paragraph_index", "patch_no")
    return rows.select("doc_id", F.col("patch_no").cast("long").alias("patch_no"), "paragraph_index", "corrected_text", "action").orderBy("doc_id", "paragraph_index")


def second_pass_merge(pass1: DataFrame, pass2: DataFrame) -> DataFrame:
    """Second-pass text over the first: override, make a patch where there was none, mark the source.

    ``pass1``: doc_id, paragraph_index, original_text, corrected_text, source (null without a patch).
    ``pass2``: doc_id, paragraph_index, final_text.
    """
    joined = pass1.join(pass2, ["doc_id", "paragraph_index"], "left")
    final = F.coalesce(F.nullif(F.col("final_text"), F.lit("")), F.col("corrected_text"))
    overridden = final != F.col("corrected_text")
    source = (
        F.when(F.col("source").isNull() & overridden, "chatgpt+audit")
        .when(overridden, F.concat("source", F.lit("+audit"))).otherwise(F.col("source"))
    )
    return joined.select(
        "doc_id", "paragraph_index", "original_text", F.col("corrected_text").alias("pass1_text"),
        final.alias("corrected_text"), source.alias("source"), (final != F.col("original_text")).alias("is_patch"),
    )
