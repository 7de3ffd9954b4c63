"""Matching of paragraphs, patches, page blocks and annotations.

Every join here has an equality on document plus page, prefix, anchor words or location, or takes a document's pages as
one row, from which pages are picked by number: no pair list grows with the square of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.functions.edits import METRICS
from redline.functions.text import let, normalise, strip, tokens
from redline.operators.ordered import by_document
from redline.operators.structure import page_estimate

PREFIX, SNIPPET, WINDOW = 50, 200, 3
GOOD, POOR = 0.8, 0.3


def page_count(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / 10)).cast("int")


def blocks(paragraphs: DataFrame) -> DataFrame:
    """Page layout derived from paragraphs: ten a page; every fifth block carries a bullet, as extraction does."""
    index = F.col("paragraph_index")
    pages = page_count(F.col("n_paragraphs"))
    page = page_estimate(index, F.col("n_paragraphs"), pages)
    marked = F.when((F.col("doc_id") + index) % 5 == 0, F.concat(F.lit("• "), "text")).otherwise(F.col("text"))
    return paragraphs.select(
        "doc_id", page.alias("page_no"), index.alias("block_no"), marked.alias("block_text"), pages.alias("pages"),
    )


def page_texts(block_rows: DataFrame) -> DataFrame:
    """Text of each page: its blocks in order."""
    return block_rows.groupBy("doc_id", "page_no").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("block_no", "block_text"))), lambda b: b["block_text"]), "\n"
        ).alias("page_text")
    )


def match_blocks(changes: DataFrame, block_rows: DataFrame, metric: str = "difflib") -> DataFrame:
    """The page block of each changed paragraph.

    Same normalised 50-character prefix first (the document's first such block). Otherwise the blocks on the
    estimated page and three pages each side, in page order: the first with a score over 0.8, else the best.
    A best score under 0.3 falls back to the first block of the estimated page, else of the document.
    """
    # A block's place as one number, so that "first block" is a hash aggregate.
    block = F.shiftleft(F.col("page_no").cast("long"), 32) + F.col("block_no")
    index = block_rows.withColumn("_norm", normalise(F.col("block_text")))
    form, compare = METRICS[metric]
    pages = page_count(F.col("n_paragraphs"))
    rows = changes.select(
        "doc_id", "paragraph_index", normalise(F.col("original_text")).alias("_norm"),
        page_estimate(F.col("paragraph_index"), F.col("n_paragraphs"), pages).alias("est_page"),
    ).withColumn("_prefix", F.left("_norm", F.lit(PREFIX)))
    by_prefix = (
        index.filter("_norm <> ''").groupBy("doc_id", F.left("_norm", F.lit(PREFIX)).alias("_prefix"))
        .agg(F.min(block).alias("_hit"))
    )
    looked = rows.join(by_prefix, ["doc_id", "_prefix"], "left")
    window = F.sequence(F.col("est_page") - WINDOW, F.col("est_page") + WINDOW)
    search = F.col("_hit").isNull() & (F.col("_norm") != "")
    others = index.filter("_norm <> ''").select(
        "doc_id", "page_no", "block_no", form(F.left("_norm", F.lit(SNIPPET))).alias("_other")
    )
    near = (
        looked.withColumn("_mine", F.when(search, form(F.left("_norm", F.lit(SNIPPET)))))
        .withColumn("page_no", F.explode(F.when(search, window).otherwise(F.array(F.lit(None).cast("int")))))
        .join(others, ["doc_id", "page_no"], "left")
        .withColumn("score", F.when(F.col("_other").isNotNull(), compare(F.col("_mine"), F.col("_other"))))
    )
    found = F.struct("page_no", "block_no", "score")
    best = near.groupBy("doc_id", "paragraph_index").agg(
        F.first("est_page").alias("est_page"), F.first("_hit").alias("_hit"),
        F.min(F.when(F.col("score") > GOOD, found)).alias("_good"),
        F.max_by(found, F.when(F.col("score").isNotNull(), F.struct("score", -F.col("page_no"), -F.col("block_no")))).alias("_best"),
    ).withColumn("_b", F.coalesce("_good", "_best"))
    first_on_page = index.groupBy("doc_id", "page_no").agg(F.min(block).alias("_page_first"))
    first_of_doc = first_on_page.groupBy("doc_id").agg(F.min("_page_first").alias("_doc_first"))
    ranked = best.join(first_on_page.withColumnRenamed("page_no", "est_page"), ["doc_id", "est_page"], "left").join(
        first_of_doc, "doc_id", "left"
    )
    exact = F.col("_hit").isNotNull()
    fuzzy = F.coalesce(F.col("_b.score") >= POOR, F.lit(False))
    similar = F.shiftleft(F.col("_b.page_no").cast("long"), 32) + F.col("_b.block_no")
    chosen = F.when(exact, F.col("_hit")).when(fuzzy, similar).otherwise(F.coalesce("_page_first", "_doc_first"))
    return ranked.withColumn("_c", chosen).select(
        "doc_id", "paragraph_index", "est_page", F.shiftright("_c", 32).cast("int").alias("page_no"),
        F.col("_c").bitwiseAND((1 << 32) - 1).cast("int").alias("block_no"),
        F.when(exact, "prefix").when(fuzzy, "similar").otherwise("fallback").alias("how"), F.col("_b.score").alias("score"),
    )


SEARCH_LENGTHS = (150, 70, 35)
NEAR = 2


def _best_prefix(text: Column, page: Column) -> Column:
    """struct(rank, length, at) of the longest prefix found on the page, or null."""
    out = None
    for rank, size in enumerate(SEARCH_LENGTHS):
        needle = F.left(text, F.lit(size))
        found = F.struct(F.lit(rank).alias("rank"), F.length(needle).alias("length"), F.position(needle, page).alias("at"))
        test = F.contains(page, needle)
        out = F.when(test, found) if out is None else out.when(test, found)
    return out


def locate_on_pages(changes: DataFrame, pages: DataFrame) -> DataFrame:
    """Page and offset where the corrected text, without white space around it, starts: prefixes of 150, 70, then 35 characters; for each, the
    estimated page and two pages each side first, then all other pages; lowest page wins.

    Near pages are picked by number from the document's pages. Other pages are looked up by anchor words: the words inside the first 35
    characters (its first and last word may be cut, so they are left out), up to three in a row. A page that
    holds the prefix holds those words in a row, so nothing is lost and nothing is compared blindly. Texts
    with no inner word use their first four characters instead.
    """
    total = F.col("n_paragraphs")
    text = strip(F.col("corrected_text"))
    rows = by_document(changes.filter((F.length(text) >= 4) & (F.col("corrected_text") != F.col("original_text"))).select(
        "doc_id", "paragraph_index", F.left(text, F.lit(SEARCH_LENGTHS[0])).alias("corrected_text"),
        page_estimate(F.col("paragraph_index"), total, page_count(total)).alias("est_page"),
        page_count(total).alias("_pages"),
    ))
    key, needle = ["doc_id", "paragraph_index"], ["doc_id", "corrected_text"]
    # A document's pages in one row: joined by document alone they stay where they are, and so do the texts looked for.
    books = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "page_text"))).alias("_book"))

    def leaves(low: Column, high: Column) -> Column:
        """The pages of these numbers: cut out where numbers have no gaps, else looked through."""
        book = F.col("_book")
        first = F.get(book, F.lit(0))["page_no"]
        whole = F.get(book, F.size(book) - 1)["page_no"] - first + 1 == F.size(book)
        start = F.greatest(low - first + 1, F.lit(1))
        cut = F.slice(book, start, F.greatest(high - first + 2 - start, F.lit(0)))
        return F.filter(F.when(whole, cut).otherwise(book), lambda p: p["page_no"].between(low, high))

    def spot(found: Column, far: int, page_no: Column) -> Column:
        return F.when(found.isNotNull(), F.struct(
            found["rank"].alias("rank"), F.lit(far).alias("far"), page_no.alias("page_no"), found["length"].alias("length"), found["at"].alias("at"),
        ))

    on_leaf = F.transform(leaves(F.col("est_page") - NEAR, F.col("est_page") + NEAR), lambda p: let(
        _best_prefix(F.col("corrected_text"), p["page_text"]), lambda h: spot(h, 0, p["page_no"])
    ))
    looked = rows.join(books, "doc_id", "left").select(*rows.columns, F.inline(F.array(F.struct(F.array_min(on_leaf).alias("_near")))))
    # Only documents that reach beyond the near pages need the wider search; texts found near are not read again.
    beyond = (F.col("est_page") - NEAR > 1) | (F.col("est_page") + NEAR < F.col("_pages"))
    still = (F.col("_near").isNull() | (F.col("_near.rank") > 0)) & beyond
    near = looked.select(*key, "est_page", "_near", F.when(still, F.col("corrected_text")).alias("corrected_text"))
    # Equal texts are looked for once, on all pages: where a near page holds as long a prefix, it wins all the same.
    words = tokens(F.left("corrected_text", F.lit(35)))
    inner = F.size(words) - 2
    needles = by_document(near.filter("corrected_text is not null").select(*needle)).distinct()
    anchored = needles.withColumn("_n", F.when(inner >= 1, F.least(inner, F.lit(3))).otherwise(0)).withColumn(
        "anchor",
        F.when(inner >= 1, F.concat(F.lit("w:"), F.array_join(F.slice(words, F.lit(2), F.least(inner, F.lit(3))), " ")))
        .otherwise(F.concat(F.lit("c:"), F.left("corrected_text", F.lit(4)))),
    )
    wanted = anchored.select("doc_id", "anchor", "_n").distinct()
    text = F.col("page_text")
    page_words = F.col("_words")

    def word_runs(n: int) -> Column:
        count = F.size(page_words) - n + 1
        return F.when(count > 0, F.transform(
            F.sequence(F.lit(1), count), lambda i: F.concat(F.lit("w:"), F.array_join(F.slice(page_words, i, F.lit(n)), " "))
        )).otherwise(F.array().cast("array<string>"))

    grams = F.when(F.length(text) >= 4, F.transform(
        F.sequence(F.lit(1), F.length(text) - 3), lambda i: F.concat(F.lit("c:"), F.substring(text, i, F.lit(4)))
    )).otherwise(F.array().cast("array<string>"))
    needs = wanted.groupBy("doc_id").agg(
        *[F.bool_or(F.col("_n") == n).alias(f"_need{n}") for n in range(4)], F.collect_list("anchor").alias("_wanted")
    )
    none = F.array().cast("array<string>")
    # Of a page's runs of words only the wanted ones become rows: all of them are several times the text.
    index = (
        pages.join(needs, "doc_id").select("*", F.inline(F.array(F.struct(tokens(text).alias("_words")))))
        .select("doc_id", "page_no", F.explode(F.array_intersect(F.concat(
            *[F.when(F.col(f"_need{n}"), word_runs(n)).otherwise(none) for n in (1, 2, 3)],
            F.when(F.col("_need0"), grams).otherwise(none),
        ), F.col("_wanted"))).alias("anchor"))
    )
    found = let(F.get(leaves(F.col("_no"), F.col("_no")), F.lit(0)), lambda p: let(
        _best_prefix(F.col("corrected_text"), p["page_text"]), lambda h: spot(h, 1, p["page_no"])
    ))
    far = (
        anchored.join(index, ["doc_id", "anchor"]).select(*needle, F.col("page_no").alias("_no"))
        .join(books, "doc_id").select(*needle, found.alias("_spot"))
        .filter("_spot is not null").groupBy(*needle).agg(F.min("_spot").alias("_spot"))
    )
    best = near.join(far, needle, "left").withColumn("_spot", F.least("_near", "_spot"))
    return best.select(
        *key, "est_page", F.col("_spot.page_no").alias("page_no"), F.col("_spot.length").alias("matched_length"),
        F.col("_spot.at").alias("at"), (F.col("_spot.far") == 0).alias("is_near"),
    )


def backfill_location(patches: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Location by (paragraph index, first 50 characters); the last paragraph with the same key wins."""
    key = ["doc_id", "paragraph_index", "_head"]
    known = paragraphs.withColumn("_head", F.left("text", F.lit(PREFIX))).groupBy(*key).agg(F.max("location").alias("location"))
    return patches.drop("location").withColumn("_head", F.left("original_text", F.lit(PREFIX))).join(known, key, "left").drop("_head")


def match_annotations(annotations: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches of each annotation: by its id list, else by both 50-character snippets as prefixes.

    ``annotations`` has annotation_id, doc_id, patch_ids, original_snippet, corrected_snippet. Short snippets
    are joined on their own length, so that a prefix test stays an equality.
    """
    listed = annotations.filter(F.size("patch_ids") > 0)
    by_id = listed.select("annotation_id", "doc_id", F.explode("patch_ids").alias("patch_id")).join(
        patches.select("doc_id", "patch_id"), ["doc_id", "patch_id"]
    ).select("annotation_id", "doc_id", "patch_id", F.lit("id").alias("how"))
    rest = annotations.filter(F.coalesce(F.size("patch_ids"), F.lit(0)) <= 0).select(
        "annotation_id", "doc_id",
        F.left("original_snippet", F.lit(PREFIX)).alias("_o"), F.left("corrected_snippet", F.lit(PREFIX)).alias("_c"),
    ).withColumns({"_lo": F.length("_o"), "_lc": F.length("_c")})
    sizes = rest.select("doc_id", "_lo", "_lc").distinct()
    heads = patches.select("doc_id", "patch_id", "original_text", "corrected_text").join(sizes, "doc_id").select(
        "doc_id", "patch_id", "_lo", "_lc",
        F.left("original_text", F.col("_lo")).alias("_o"), F.left("corrected_text", F.col("_lc")).alias("_c"),
    )
    by_text = rest.join(heads, ["doc_id", "_lo", "_lc", "_o", "_c"]).select(
        "annotation_id", "doc_id", "patch_id", F.lit("text").alias("how")
    )
    return by_id.unionByName(by_text)


def merge_patches(base: DataFrame, rerun: DataFrame) -> DataFrame:
    """Patch set after a re-run of some paragraphs: a new text replaces or adds, a null text drops.

    ``base`` has doc_id, paragraph_index, corrected_text; ``rerun`` the same, one row per paragraph re-run.
    """
    key = ["doc_id", "paragraph_index"]
    new = rerun.select(*key, F.col("corrected_text").alias("_new"), F.lit(True).alias("_again"))
    joined = base.select(*key, F.col("corrected_text").alias("_old")).join(new, key, "full_outer")
    action = (
        F.when(F.col("_again").isNull(), "keep")
        .when(F.col("_new").isNull() & F.col("_old").isNotNull(), "drop")
        .when(F.col("_new").isNull(), "none")
        .when(F.col("_old").isNull(), "add")
        .when(F.col("_old") != F.col("_new"), "replace")
        .otherwise("keep")
    )
    return joined.select(
        *key, F.when(F.col("_again").isNull(), F.col("_old")).otherwise(F.col("_new")).alias("corrected_text"),
        action.alias("action"),
    ).filter("action <> 'none'")
