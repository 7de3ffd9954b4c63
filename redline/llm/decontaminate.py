"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, units after numbers, and names (capitalised words inside a sentence) become typed placeholders; case and
punctuation go, also words of nothing else. Windows of the resulting template tokens are hash-joined: benchmark windows against all documents'. A
question with other numbers or names still has the same template. Names are told by their capitals, so windows in which
they stand as they are, in lower case, are joined too: copies in another case share those. A document leaks an item when it holds enough of the
item's windows and the slots agree: each value of the item's slots is replaced by the same value wherever it occurs in
that occurrence. A document's occurrences of an item are judged each by itself, and all together; one that passes will do.

No document text is shuffled: a document's windows are hashed, those whose bit in a bitmap of the benchmark's hashes is
not set are dropped, and the others are exploded and probed in one pass, against the benchmark's windows,
which are broadcast only if counted to be at most MAX_BROADCAST (beyond that Spark joins by shuffling hashes). Matches are
then grouped by document, item and the place where the item would start, neighbouring starts together.

Defined results: null and empty texts hold no windows; an item with MIN_WORDS words or more but fewer than a window is one
window of its own length. Windows of which less than half are literal words are not searched; an item that has no
others, or fewer words than MIN_WORDS, is searched literally (case and marks around words apart), so a document that holds
an item of one word leaks it. MIN_RUN words or more in a row that no slot differs in are a leak, however long the item. Documents with the same doc_id count as one; null
doc_ids are told apart by text. Repeated items are reported each; a null item_id stays null. Other columns are ignored by
leaks() and kept by without_leaks(). Empty tables leak nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 8
MIN_WORDS = 5
MIN_COVERAGE = 0.5
MIN_CONSISTENCY = 0.8
#: A run of an item's windows without a changed slot that spans so many words is a leak, whatever its share of the item.
MIN_RUN = 13
MAX_BROADCAST = 1_000_000
WORD_GAP = r"[\x20\x09-\x0D]+"
# Unit words that count as a unit after a number.
UNITS = "km m cm mm mi ft in yd kg g mg lb oz t l ml s ms min h hr hrs hours minutes seconds days weeks months years miles meters metres feet inches grams kilograms pounds dollars euros usd eur percent degrees c f k w kw mw v a hz khz mhz ghz b kb mb gb tb"


def without_lone_marks(text: Column) -> Column:
    """The text without the words that hold no letter or digit; angle brackets, which placeholders have, are other marks."""
    raw = F.coalesce(text, F.lit(""))
    raw = F.when(raw.contains("<") | raw.contains(">"), F.translate(raw, "<>", "''")).otherwise(raw)
    return F.regexp_replace(F.concat(F.lit(" "), raw), r"\s++[^\p{L}\p{N}\s]++(?!\S)", "")


def words_of(text: Column) -> Column:
    """The words; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def template_text(raw: Column) -> Column:
    """A text of without_lone_marks with placeholders, lower case and no marks at words. Its words stand where the text's
    words stand, one for one. A name is <name> and the word in lower case, for typed() and untyped()."""
    units = "|".join(UNITS.split())
    numbers = F.regexp_replace(raw, r"(?<!\S)\p{Punct}*[+-]?\d[\d.,:/]*(?i:" + units + r")?\p{Punct}*(?!\S)", "<num>")
    out = F.when(raw.rlike("[0-9]"), numbers).otherwise(raw)  # most texts have none
    out = F.regexp_replace(out, r"\p{Lu}(?<=[^\s.!?:]\s\p{Lu})[\p{L}'’-]*\p{Punct}*(?!\S)", "<name>$0")
    out = F.regexp_replace(F.lower(out), r"[^\p{L}\p{N}\s<>]", "")
    return F.when(raw.rlike("[0-9]"), F.regexp_replace(out, r"(?<=<num>\s)(?:<name>)?(?:" + units + r")(?!\S)", "<unit>")).otherwise(out)


def typed(template: Column) -> Column:
    return F.regexp_replace(template, r"<name>\S++", "<name>")


def untyped(template: Column) -> Column:
    """Names as they are, which copies in another case share."""
    return F.replace(template, F.lit("<name>"), F.lit(""))


def literal_text(clean: Column) -> Column:
    """A text of without_lone_marks in lower case, without the marks around words."""
    return F.regexp_replace(F.lower(clean), r"(?<!\S)[^\p{L}\p{N}\s]++|[^\p{L}\p{N}\s]++(?!\S)", "")


def window_hashes(tokens: Column, length: int, *kind: Column) -> Column:
    """Hash of each run of length tokens (and kind), in order; empty for fewer tokens."""
    count = F.size(tokens) - F.lit(length - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.slice(tokens, i, length), *kind))).otherwise(
        F.array().cast("array<bigint>")
    )


def slot_value(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^\p{Punct}+|\p{Punct}+$", ""))


def _slots(words: Column, tokens: Column) -> Column:
    """(place, type, value) of the placeholders among the tokens."""
    places = F.transform(words, lambda w, i: F.struct(i.alias("place"), F.get(tokens, i).alias("kind"), slot_value(w).alias("value")))
    return F.filter(places, lambda s: s["kind"].isin("<num>", "<unit>", "<name>"))


def _aligned(docs: DataFrame, *names) -> DataFrame:
    """names and clean, template: the text without lone marks and its template."""
    return docs.select(*names, without_lone_marks(F.col("text")).alias("clean")).select(*names, "clean", template_text(F.col("clean")).alias("template"))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """item, item_id, length, literal, item_windows, position, hash, item_slots of each window that is searched: typed, and
    untyped if that differs. An item that has typed windows to search is searched at those places only; literal: one
    that has neither."""
    some = _aligned(items, F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    some = some.select(
        "item", "item_id", words_of(F.col("clean")).alias("words"), words_of(typed(F.col("template"))).alias("typed"), words_of(untyped(F.col("template"))).alias("untyped"),
        words_of(literal_text(F.col("clean"))).alias("plain"),
    )
    some = some.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window)))
    length = F.col("length")
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    all_of = F.transform(starts, lambda i: F.struct((i - 1).alias("position"), *[F.slice(x, i, length).alias(x) for x in ("typed", "untyped", "words", "plain")]))
    searched = lambda kind: F.filter(F.col("windows"), lambda w: F.size(F.filter(w[kind], lambda t: ~t.startswith("<"))) * 2 >= length)
    rows = some.select("item", "item_id", "length", (F.size("words") < MIN_WORDS).alias("short"), all_of.alias("windows"))
    rows = rows.withColumn("literal", F.col("short") | (F.size(searched("typed")) == 0) & (F.size(searched("untyped")) == 0))
    rows = rows.withColumn("windows", F.when(F.col("literal"), F.col("windows")).when(F.size(searched("typed")) > 0, searched("typed")).otherwise(searched("untyped")))
    rows = rows.select("item", "item_id", "length", "literal", F.size("windows").alias("item_windows"), F.explode("windows").alias("w"))
    runs = F.when(F.col("literal"), F.array("w.plain")).otherwise(F.array_distinct(F.array("w.typed", "w.untyped")))
    rows = rows.select("item", "item_id", "length", "literal", "item_windows", "w.position", F.col("w.words").alias("raw"), F.explode(runs).alias("run"))
    hashed = F.when(F.col("literal"), F.xxhash64("run", F.lit(1))).otherwise(F.xxhash64("run"))
    return rows.select("item", "item_id", "length", "literal", "item_windows", "position", hashed.alias("hash"), _slots(F.col("raw"), F.col("run")).alias("item_slots"))


def hash_bits(hashes: DataFrame, count: int) -> tuple[list[int], int]:
    """(words, size): a bitmap in 64-bit words of the hashes' low bits, with 32 bits for each hash, 2**22 at most. A hash
    whose bit is not set is none of them."""
    size = 1 << min(22, max(12, (32 * count).bit_length()))
    bit = F.pmod("hash", F.lit(size))
    rows = hashes.select(F.floor(bit / 64).alias("word"), F.pmod(bit, F.lit(64)).alias("bit")).distinct()
    words = [0] * (size // 64)
    for r in rows.collect():  # as many as the bitmap has bits at most
        words[r.word] |= 1 << r.bit
    return [w - (1 << 64) if w >> 63 else w for w in words], size


def _longest_span(positions: Column, length: Column) -> Column:
    """Words that the longest row of windows at these positions covers without a gap."""
    start = F.struct(F.lit(0).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("most"))

    def add(run, at):
        first = F.when((run["last"] >= 0) & (at - run["last"] <= length), run["first"]).otherwise(at)
        return F.struct(first.alias("first"), at.alias("last"), F.greatest(run["most"], at - first + length).alias("most"))

    return F.aggregate(F.array_sort(positions), start, add, lambda run: run["most"])


def _judged(min_coverage: float, min_consistency: float, also: Column | bool = False) -> Column:
    """Whether the windows found at positions, with their slots in pairs, are a leak, and the figures, so that the
    greatest of several is the best. Windows without a changed slot are enough by themselves, and so is what also says."""
    values = F.array_distinct(F.transform("pairs", lambda p: F.struct(p["kind"], p["item_value"])))
    changed = F.size(F.filter("pairs", lambda p: ~p["item_value"].eqNullSafe(p["doc_value"])))
    n_slots, n_pairs = F.size(values), F.size("pairs")
    coverage = F.size("positions") / F.col("item_windows")
    consistency = F.when(n_pairs > 0, n_slots / n_pairs).otherwise(F.lit(1.0))
    enough = F.lit(also) | (coverage >= min_coverage) & (consistency >= min_consistency) | (F.size("unchanged") / F.col("item_windows") >= min_coverage)
    return F.struct(
        enough.alias("leaks"), (changed == 0).alias("exact"), coverage.alias("coverage"), consistency.alias("slot_consistency"),
        F.size("positions").cast("long").alias("n_windows"), n_slots.cast("long").alias("n_slots"), changed.cast("long").alias("n_changed_slots"),
    )


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_coverage: float = MIN_COVERAGE, min_consistency: float = MIN_CONSISTENCY, min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, tie (null unless doc_id is), item_id, n_windows, item_windows, coverage, n_slots, n_changed_slots,
    slot_consistency and exact (no slot differs) of each leak of an item in a document: those of its best occurrence."""
    searched = item_windows(items, window)
    kinds = [(r.length, r.literal) for r in searched.select("length", "literal").distinct().collect()]  # twice window at most
    count = searched.count()
    words, size = hash_bits(searched, count)
    bitmap = F.from_json(F.lit(json.dumps(words)), "array<bigint>")
    if count <= MAX_BROADCAST:
        searched = F.broadcast(searched)

    def likely(w):
        bit = F.pmod(w["hash"], F.lit(size))
        word = F.get(bitmap, F.shiftright(bit, 6).cast("int"))
        return F.getbit(word, F.pmod(bit, F.lit(64)).cast("int")) == 1

    text = _aligned(docs, F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("tie"), "text")
    named = F.col("template").contains("<name>")
    text = text.select("doc_id", "tie", words_of(F.col("clean")).alias("words"), words_of(typed(F.col("template"))).alias("typed"), F.when(named, words_of(untyped(F.col("template")))).otherwise(F.array().cast("array<string>")).alias("untyped"))

    def windows(kind, length):
        tokens, more = (words_of(literal_text(F.array_join("words", " "))), [F.lit(1)]) if kind == "literal" else (F.col(kind), [])
        each = F.transform(window_hashes(tokens, length, *more), lambda h, i: F.struct(i.alias("at"), F.lit(length).alias("length"), h.alias("hash")))
        return F.filter(each, likely)

    # a window without a name is found as both; the sets below level that out
    found = text.select("doc_id", "tie", "words", F.inline(F.concat(*[windows(kind, n) for n, literal in kinds or [(window, False)] for kind in (["literal"] if literal else ["typed", "untyped"])])))
    hits = found.join(searched, ["hash", "length"])
    pairs = F.transform("item_slots", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("item_value"), slot_value(F.get("words", F.col("at") + s["place"])).alias("doc_value")))
    found = hits.select("doc_id", "tie", "item", "item_id", "item_windows", "length", "position", (F.col("at") - F.col("position")).alias("start"), pairs.alias("pairs"))
    key = ["doc_id", "tie", "item", "item_id", "item_windows", "length"]
    positions = lambda name: F.array_distinct(F.flatten(F.collect_list(name)))
    judged = lambda *also: _judged(min_coverage, min_consistency, *also).alias("verdict")
    # one start each, then neighbouring starts (words were put in or left out), then all of the document
    same = F.forall("pairs", lambda p: p["item_value"].eqNullSafe(p["doc_value"]))
    one = found.groupBy(*key, "start").agg(
        F.collect_set("position").alias("positions"), F.collect_set(F.when(same, F.col("position"))).alias("unchanged"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")
    )
    in_order = Window.partitionBy(*key).orderBy("start")
    far = F.col("start") - F.lag("start").over(in_order) >= F.col("item_windows")
    one = one.withColumn("verdict", judged(_longest_span(F.col("unchanged"), F.col("length")) >= min_run)).withColumn("far", F.coalesce(far, F.lit(False)).cast("int")).withColumn("run", F.sum("far").over(in_order))
    sets = lambda: [positions(x).alias(x) for x in ("positions", "unchanged", "pairs")]
    runs = one.groupBy(*key, "run").agg(*sets(), F.max("verdict").alias("best"))
    runs = runs.withColumn("best", F.greatest("best", judged()))
    out = runs.groupBy(*key).agg(*sets(), F.max("best").alias("best")).withColumn("best", F.greatest("best", judged()))
    return out.where("best.leaks").select(
        "doc_id", "tie", "item_id", "best.n_windows", F.col("item_windows").cast("long").alias("item_windows"), "best.coverage", "best.n_slots", "best.n_changed_slots", "best.slot_consistency", "best.exact"
    )


def without_leaks(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The documents, with all their columns, that leak no item."""
    bad = leaks(docs, items, **how).select(F.col("doc_id").alias("_bad_id"), F.col("tie").alias("_bad_tie")).distinct()
    doc_id, tie = docs["doc_id"].cast("long"), F.when(docs["doc_id"].isNull(), F.xxhash64(docs["text"]))
    return docs.join(bad, doc_id.eqNullSafe(F.col("_bad_id")) & tie.eqNullSafe(F.col("_bad_tie")), "left_anti")
