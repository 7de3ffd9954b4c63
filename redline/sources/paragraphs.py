"""Paragraph scans. Each source row is split where it is read, so no scan shuffles text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline import vocab as V


def _style(index: Column, text: Column) -> Column:
    """Plain text has no styles: a short first line is a title, a very short later line a subtitle."""
    size = F.length(text)
    return F.when((index == 0) & size.between(1, 60), "Heading 1").when((index > 0) & size.between(1, 30), "Heading 2")


def from_documents(documents: DataFrame) -> DataFrame:
    """One row per line of ``text``, blank lines included, 0-based.

    A document is one source row, so its length, the next line and whether it has inner headings are known
    here without any window. They are worked out before the lines are made rows: beside a generator they would be
    worked out, and the whole text copied, once for every line.
    """
    lines = F.split("text", "\n", -1)
    keep = [c for c in documents.columns if c not in ("text", "n_chars")]
    whole = documents.select(
        *keep,
        F.regexp_extract("text", "[A-Za-z]{6,}", 0).alias("key_word"),
        lines.alias("_lines"),
    ).select(
        *keep, "key_word", "_lines", F.size("_lines").alias("n_paragraphs"),
        F.exists(F.slice("_lines", F.lit(2), F.size("_lines")), lambda t: F.length(t).between(1, 30)).alias("has_sections"),
    )
    rows = whole.select(
        *keep, "key_word", "n_paragraphs", "has_sections",
        F.inline(F.transform("_lines", lambda t, i: F.struct(
            i.alias("paragraph_index"), t.alias("text"), F.get(F.col("_lines"), i + 1).alias("next_text"),
        ))),
    )
    index = F.col("paragraph_index")
    return rows.select(
        *keep, "paragraph_index", "text",
        F.concat(F.lit("body:"), index.cast("string")).alias("location"),
        _style(index, F.col("text")).alias("style_name"),
        F.lit(False).alias("is_in_table"),
        F.contains("text", F.lit("\f")).alias("has_page_break"),
        "n_paragraphs", "has_sections",
        _style(index + 1, F.col("next_text")).alias("next_style"), "next_text", "key_word",
    )


def plain(paragraphs: DataFrame) -> DataFrame:
    """The same paragraphs without styles."""
    return paragraphs.withColumn("style_name", F.lit(None).cast("string"))


def from_turns(conversations: DataFrame) -> DataFrame:
    """One paragraph per chat turn; user turns read as dialogue."""
    return conversations.select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").cast("int").alias("paragraph_index"),
        F.when(F.col("role") == "user", F.concat(F.lit("— "), "text")).otherwise(F.col("text")).alias("text"),
        F.concat(F.lit("body:"), F.col("turn").cast("string")).alias("location"),
        F.lit(None).cast("string").alias("style_name"),
        F.lit(False).alias("is_in_table"),
        F.lit(False).alias("has_page_break"),
        "role",
    )


HTML_NOISE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<head\b.*?</head>"
HTML_OPEN = r"(?i)<(h1|h2|h3|p|li|div|footer|blockquote)\b[^>]*>"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def html_text(markup: Column) -> Column:
    """Markup without tags, entities decoded, white space collapsed."""
    out = F.regexp_replace(markup, "<[^>]*>", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.regexp_replace(F.regexp_replace(out, f"{V.WS}+", " "), V.STRIP, "")


def from_html(pages: DataFrame) -> DataFrame:
    """Block elements of a page in order. Markup is often not closed, so text is cut at opening tags only.

    Location kind is header inside nav, footer inside footer, else body. Links are kept as text.
    """
    clean = F.regexp_replace("html", HTML_NOISE, "")
    # A mark in front of each block: its tag, and whether it sits inside nav.
    marked = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(clean, "(?i)<nav\\b[^>]*>", "\u0001nav\u0002"), "(?i)</nav>", "\u0001body\u0002"),
        HTML_OPEN, "\u0001$1\u0002",
    )
    chunks = F.split(marked, "\u0001", -1)
    rows = pages.select(
        F.col("page_id").alias("doc_id"), "url",
        F.transform(chunks, lambda c: F.struct(
            F.lower(F.when(F.contains(c, F.lit("\u0002")), F.substring_index(c, "\u0002", 1)).otherwise("")).alias("tag"),
            F.when(F.contains(c, F.lit("\u0002")), F.substring(c, F.instr(c, "\u0002") + 1, F.length(c))).otherwise(c).alias("body"),
        )).alias("_chunks"),
        F.size(F.split(F.substring_index(marked, "\u0001body\u0002", 1), "\u0001", -1)).alias("_nav_end"),
        F.contains(marked, F.lit("\u0001nav\u0002")).alias("_has_nav"),
    ).select(
        "doc_id", "url", "_nav_end", "_has_nav", F.posexplode("_chunks").alias("chunk_no", "c"),
    ).select(
        "doc_id", "url", "chunk_no", F.col("c.tag").alias("tag"), html_text(F.col("c.body")).alias("text"),
        F.filter(
            F.transform(
                F.regexp_extract_all(F.col("c.body"), F.lit("(?is)<a\\b[^>]*>(.*?)</a>"), 1), lambda x: html_text(x)
            ), lambda t: t != "",
        ).alias("links"),
        F.when(F.col("c.tag") == "footer", "footer")
        .when(F.col("_has_nav") & (F.col("chunk_no") < F.col("_nav_end")), "header")
        .otherwise("body").alias("kind"),
    )
    index = F.col("chunk_no")
    return rows.select(
        "doc_id", "url", F.col("chunk_no").alias("paragraph_index"), "text",
        F.when(F.col("kind") == "body", F.concat(F.lit("body:"), index.cast("string")))
        .otherwise(F.concat("kind", F.lit(":0:"), index.cast("string"))).alias("location"),
        F.when(F.col("tag").rlike("^h[1-3]$"), F.concat(F.lit("Heading "), F.right("tag", F.lit(1))))
        .when(F.col("tag") == "li", "List").when(F.col("tag") == "blockquote", "Quote").alias("style_name"),
        F.lit(False).alias("is_in_table"), F.lit(False).alias("has_page_break"), "links",
    )
