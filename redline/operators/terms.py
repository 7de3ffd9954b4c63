"""Recurring terms of each document, and term sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline import vocab as V
from redline.functions.text import strip, tokens
from redline.operators.ordered import first_k

# Body words a document needs, candidates looked at, occurrences and characters a term needs, terms kept.
MIN_WORDS, TOP, MIN_FREQUENCY, MIN_LENGTH, KEEP = 20, 100, 3, 6, 50
#: Text whose n-grams one task counts: several hundred MB of hash table at most.
PART_CHARACTERS = 8 << 20


def ngrams(paragraphs: DataFrame) -> DataFrame:
    """Lower-cased two- and three-word runs, edge punctuation removed, at least five characters. Texts are lower-cased whole
    and each word is given its two followers; runs are put together only once they are rows."""
    words = F.col("_words")
    rows = paragraphs.select("doc_id", "paragraph_index", tokens(F.lower(strip(F.col("text")))).alias("_words"))
    rows = rows.select("doc_id", "paragraph_index", F.inline(F.transform(words, lambda w, i: F.struct(
        (i + 1).alias("pos"), w.alias("_a"), F.get(words, i + 1).alias("_b"), F.get(words, i + 2).alias("_c"),
    )))).filter(F.col("_b").isNotNull())
    pair = F.concat("_a", F.lit(" "), "_b")
    runs = F.array(F.struct(F.lit(2).alias("n"), pair.alias("term")), F.struct(F.lit(3).alias("n"), F.concat(pair, F.lit(" "), "_c").alias("term")))
    clean = F.trim(F.col("term"), F.lit(V.TERM_EDGE_CHARS))
    rows = rows.select("doc_id", "paragraph_index", "pos", F.inline(runs))
    return rows.select("doc_id", "paragraph_index", "n", "pos", clean.alias("term")).filter(F.length("term") >= 5)


def by_document(paragraphs: DataFrame) -> DataFrame:
    """The paragraphs' texts dealt by document, so that what is counted per document needs no shuffle of its own: n-grams are
    many times the text. Partitions grow in number with the text, as each holds the counts of all its n-grams."""
    characters = paragraphs.agg(F.sum(F.length("text"))).first()[0] or 0
    partitions = max(4 * int(paragraphs.sparkSession.conf.get("spark.sql.shuffle.partitions")), characters // PART_CHARACTERS)
    return paragraphs.select("doc_id", "paragraph_index", "text").repartition(partitions, "doc_id")


def enough_text(paragraphs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents with enough body words to have terms."""
    body = paragraphs.filter(F.col("location").startswith("body:"))
    head = F.size(tokens(F.left("text", F.lit(8 * min_words))))  # a text's beginning holds no more words than the text
    words = F.when(head >= min_words, head).otherwise(F.size(tokens(F.col("text"))))
    counted = body.groupBy("doc_id").agg(F.sum(words).alias("_words"))
    return counted.filter(F.col("_words") >= min_words).select("doc_id")


def candidate_terms(
    paragraphs: DataFrame, min_words: int = MIN_WORDS, top: int = TOP, min_frequency: int = MIN_FREQUENCY, min_length: int = MIN_LENGTH
) -> DataFrame:
    """The ``top`` most frequent n-grams of each document with enough body text, those long enough kept.

    Texts are shuffled, not their n-grams; ties go to the earlier first occurrence.
    """
    # Where a term first occurs, as one number (paragraph, length, position): a fixed-width buffer lets Spark
    # count in hash tables instead of sorting every n-gram.
    place = F.shiftleft(F.col("paragraph_index").cast("long"), 32) + (F.col("n") - 2).cast("long") * (1 << 31) + F.col("pos")
    counted = ngrams(by_document(paragraphs)).groupBy("doc_id", "term").agg(
        F.count("*").alias("frequency"), F.min(place).alias("first_at")
    ).filter(F.col("frequency") >= min_frequency)
    first = first_k(counted, ["doc_id"], [F.col("frequency").desc(), F.col("first_at")], top)
    return first.filter(F.length("term") >= min_length).join(enough_text(paragraphs, min_words), "doc_id", "left_semi")


def drop_related(ranked: Column) -> Column:
    """Walk the ranked terms and keep one only if it neither contains nor is contained in one kept before."""
    kind = "array<struct<rank:int,term:string,frequency:bigint,first_paragraph:int>>"
    return F.aggregate(
        ranked,
        F.array().cast(kind),
        lambda kept, t: F.when(
            F.exists(kept, lambda k: F.contains(k["term"], t["term"]) | F.contains(t["term"], k["term"])), kept
        ).otherwise(F.concat(kept, F.array(t))),
    )


def terms(paragraphs: DataFrame, protected: DataFrame | None = None, keep: int = KEEP, min_words: int = MIN_WORDS, **limits) -> DataFrame:
    """At most ``keep`` terms per document; none, protected ones included, for a document without enough body text.
    ``protected`` is (doc_id, protected_terms array) from the profile: mined terms among them are flagged, the others
    follow with frequency 0."""
    entry = F.struct(
        F.col("_rn").cast("int").alias("rank"), "term", "frequency", F.shiftright("first_at", 32).cast("int").alias("first_paragraph")
    )
    kept = candidate_terms(paragraphs, min_words, **limits).groupBy("doc_id").agg(
        drop_related(F.array_sort(F.collect_list(entry))).alias("kept")
    )
    empty = F.array().cast("array<string>")
    if protected is None:
        rows = kept.withColumn("protected_terms", empty)
    else:
        rows = protected.join(enough_text(paragraphs, min_words), "doc_id", "left_semi").join(kept, "doc_id", "left")
    mined = F.coalesce(F.col("kept"), F.array().cast("array<struct<rank:int,term:string,frequency:bigint,first_paragraph:int>>"))
    guard = F.coalesce(F.col("protected_terms"), empty)
    low_guard = F.transform(guard, lambda p: F.lower(p))
    names = F.transform(mined, lambda m: m["term"])
    flagged = F.transform(mined, lambda m: F.struct(
        m["term"].alias("term"), m["frequency"].alias("frequency"), m["first_paragraph"].alias("first_paragraph"),
        F.array_contains(low_guard, m["term"]).alias("is_protected"),
    ))
    added = F.transform(
        F.filter(guard, lambda p: ~F.array_contains(names, F.lower(p))),
        lambda p: F.struct(p.alias("term"), F.lit(0).cast("bigint").alias("frequency"),
                           F.lit(0).alias("first_paragraph"), F.lit(True).alias("is_protected")),
    )
    return rows.select("doc_id", F.posexplode(F.slice(F.concat(flagged, added), 1, keep)).alias("term_no", "t")).select(
        "doc_id", "term_no", "t.*"
    )


def term_arrays(term_rows: DataFrame) -> DataFrame:
    """One array of at most fifty terms per document, in order."""
    return term_rows.groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("term_no", "term"))), lambda t: t["term"]).alias("terms")
    )


def attach_terms(paragraphs: DataFrame, term_rows: DataFrame) -> DataFrame:
    """The document's term array on each of its paragraphs (empty when it has none)."""
    joined = paragraphs.join(term_arrays(term_rows), "doc_id", "left")
    return joined.withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def union_terms(*sets: Column) -> Column:
    """Sorted union of term arrays; nulls count as empty."""
    out = F.array().cast("array<string>")
    for s in sets:
        out = F.array_union(out, F.coalesce(s, F.array().cast("array<string>")))
    return F.array_sort(F.filter(out, lambda t: t.isNotNull()))
