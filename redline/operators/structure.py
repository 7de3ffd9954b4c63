"""Sections, positions, neighbours, samples and page estimates of paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from redline.functions.text import ends_abruptly, is_heading, strip, type_or_fallback
from redline.operators.ordered import BLOCK, dense, first_k, running, with_neighbours
from redline.session import checkpoint_dir, store

KEY = ["doc_id"]
CHUNK = 30
CHUNK_OVER = 40


def position_columns(opens: Column, next_opens: Column, index: Column, n: Column, chunked: Column) -> dict[str, Column]:
    """first / middle / last and the transition flag, from this row, the next one and the document's length."""
    starts = F.when(chunked, index % CHUNK == 0).otherwise(opens) | (index == 0)
    ends = F.when(chunked, index % CHUNK == CHUNK - 1).otherwise(next_opens) | (index == n - 1)
    return {
        "section_position": F.when(starts, "first").when(ends, "last").otherwise("middle"),
        "is_transition": starts & (index > 0),
    }


def with_sections(paragraphs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Adds section_index, section_position, is_transition and n_paragraphs to any paragraph table.

    A heading opens a section; text before the first one is section 0. A document without inner headings and
    with more than 40 paragraphs is cut into chunks of 30 instead.
    """
    opens = is_heading(F.col("style_name")) & F.col("location").startswith("body:") & (F.col("paragraph_index") > 0)
    rows = paragraphs.withColumn("_opens", opens)
    rows = with_neighbours(
        rows, KEY, "paragraph_index", lambda w: {"_next": F.coalesce(F.lead("_opens").over(w), F.lit(False))},
        after=1, size=size, keep_block=True,
    )
    one = F.col("_opens").cast("int")
    rows = running(rows, KEY, "paragraph_index", {"_sec": one}, {"n_paragraphs": F.lit(1), "_heads": one}, size)
    chunked = (F.col("_heads") == 0) & (F.col("n_paragraphs") > CHUNK_OVER)
    index = F.col("paragraph_index")
    place = position_columns(F.col("_opens"), F.col("_next"), index, F.col("n_paragraphs"), chunked)
    return rows.select(
        *paragraphs.columns,
        F.when(chunked, F.floor(index / CHUNK)).otherwise(F.col("_sec")).cast("int").alias("section_index"),
        *[c.alias(n) for n, c in place.items()],
        F.col("n_paragraphs").cast("int").alias("n_paragraphs"),
        chunked.alias("chunked"),
    )


def section_table(sectioned: DataFrame) -> DataFrame:
    """One row per section: inclusive paragraph range and title."""
    title = F.when(is_heading(F.col("style_name")) & ~F.col("chunked"), strip(F.col("text")))
    return (
        sectioned.withColumn("_title", F.when(title != "", title))
        .groupBy("doc_id", "section_index")
        .agg(
            F.min_by("_title", "paragraph_index").alias("section_title"),
            F.min("paragraph_index").alias("start_paragraph"),
            F.max("paragraph_index").alias("end_paragraph"),
        )
    )


def neighbours(paragraphs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Type of the next paragraph (of the full list), and text, type, kind and abrupt end of the previous usable one.

    Needs columns stripped and paragraph_type; returns usable paragraphs only.
    """
    rows = with_neighbours(
        paragraphs, KEY, "paragraph_index",
        lambda w: {"next_type": F.lead(type_or_fallback(F.col("paragraph_type"), F.col("location"))).over(w)},
        after=1, size=size, keep_block=True,
    ).filter(F.length("stripped") >= 3)
    rows = dense(rows, KEY, "paragraph_index", "kept_index", size=size)
    prev = F.struct("stripped", "paragraph_type", F.split("location", ":")[0].alias("kind"))
    rows = with_neighbours(
        rows, KEY, "kept_index",
        lambda w: {
            "_prev": F.lag(prev).over(w),
            "previous_texts": F.collect_list("stripped").over(w.rowsBetween(-3, -1)),
        },
        before=3, size=size,
    )
    return rows.select(
        *paragraphs.columns, "kept_index", "next_type", "previous_texts",
        F.col("_prev.stripped").alias("prev_text"),
        F.col("_prev.paragraph_type").alias("prev_type"),
        F.col("_prev.kind").alias("prev_kind"),
        ends_abruptly(F.col("_prev.stripped")).alias("prev_abrupt"),
    )


def page_estimate(index: Column, n: Column, pages: Column) -> Column:
    """Linear guess of the page a paragraph is on, 1-based."""
    return F.greatest(F.lit(1), F.least(F.floor(index / F.greatest(n, F.lit(1)) * pages).cast("int") + 1, pages.cast("int")))


def stratified_sample(paragraphs: DataFrame, size: int = BLOCK) -> DataFrame:
    """First, middle and last three body paragraphs over 30 characters; repeated texts once; at most nine."""
    body = paragraphs.filter(F.col("location").startswith("body:") & (F.length(strip(F.col("text"))) > 30))
    rows = dense(body, KEY, "paragraph_index", "_r", "_n", size)
    r, n = F.col("_r"), F.col("_n")
    mid = F.floor(n / 2)
    picked = rows.filter(
        (r < 3) | ((n > 6) & r.between(F.greatest(F.lit(0), mid - 1), mid + 1)) | ((n > 3) & (r >= n - 3))
    )
    once = first_k(picked, ["doc_id", "text"], [F.col("paragraph_index")], 1)
    order = Window.partitionBy("doc_id").orderBy("paragraph_index")
    return once.select("doc_id", "paragraph_index", "text", F.row_number().over(order).alias("sample_no")).filter(
        "sample_no <= 9"
    )


def section_sample(sectioned: DataFrame) -> DataFrame:
    """One line per section (the first 15): title and its first four paragraphs over ten characters, 200 each."""
    usable = sectioned.filter("section_index < 15").withColumn("_s", strip(F.col("text")))
    picked = first_k(usable.filter(F.length("_s") > 10), ["doc_id", "section_index"], [F.col("paragraph_index")], 4)
    lines = picked.groupBy("doc_id", "section_index").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.left("_s", F.lit(200)).alias("t")))), lambda x: x["t"]),
            " | ",
        ).alias("_lines")
    )
    table = section_table(sectioned.filter("section_index < 15"))
    label = F.coalesce("section_title", F.concat(F.lit("Sección "), (F.col("section_index") + 1).cast("string")))
    return table.join(lines, ["doc_id", "section_index"], "left").select(
        "doc_id", "section_index",
        F.concat(F.lit("["), label, F.lit("]: "), F.coalesce("_lines", F.lit("(vacía)"))).alias("description"),
    )


def profile_sample(paragraphs: DataFrame, keep: int = 8, longer_than: int = 20, characters: int = 300) -> DataFrame:
    """The first ``keep`` body paragraphs over ``longer_than`` characters, ``characters`` of each."""
    body = paragraphs.filter(F.col("location").startswith("body:"))
    rows = body.withColumn("_s", strip(F.col("text"))).filter(F.length("_s") > longer_than)
    return first_k(rows, KEY, [F.col("paragraph_index")], keep).select(
        "doc_id", F.col("_rn").alias("sample_no"), F.left("_s", F.lit(characters)).alias("sample")
    )


def batch_boundaries(sectioned: DataFrame, target: int) -> DataFrame:
    """Batches that end at section ends, each at least ``target`` paragraphs (the last one may be shorter).

    The cut after a batch starting at ``s`` is the end of the section that holds paragraph ``s + target - 1``.
    That gives every section start one successor; the starts reached from paragraph 0 are the batches. They
    are found by doubling the jumps, so a long document needs log2(batches) joins, not one sequential pass.
    """
    checkpoint_dir(sectioned.sparkSession)
    narrow = store(sectioned.select("doc_id", "paragraph_index", "section_index", "n_paragraphs"), "sectioned")
    spans = narrow.groupBy("doc_id", "section_index").agg(
        F.min("paragraph_index").alias("start"), F.max("paragraph_index").alias("_end"), F.max("n_paragraphs").alias("n")
    )
    ends = narrow.select("doc_id", "section_index", F.col("paragraph_index").alias("_at")).join(
        spans.select("doc_id", "section_index", "_end"), ["doc_id", "section_index"]
    ).drop("section_index")
    probes = spans.select("doc_id", "start", "n", F.least(F.col("start") + target - 1, F.col("n") - 1).alias("_at"))
    jumps = probes.join(ends, ["doc_id", "_at"]).select(
        "doc_id", "start", F.col("_end").alias("end"), F.when(F.col("_end") < F.col("n") - 1, F.col("_end") + 1).alias("next"),
    ).checkpoint()
    longest = narrow.agg(F.max("n_paragraphs")).first()[0] or 1
    rounds = max(1, (int(longest) // max(target, 1) + 1).bit_length())
    reached = jumps.filter("start = 0").select("doc_id", F.col("start").alias("at"))
    step = jumps.select("doc_id", "start", "next").filter("next is not null")
    for _ in range(rounds):
        further = reached.join(step.withColumnRenamed("start", "at"), ["doc_id", "at"]).select(
            "doc_id", F.col("next").alias("at")
        )
        reached = reached.unionByName(further).checkpoint()
        onward = step.select("doc_id", F.col("start").alias("next"), F.col("next").alias("_n2"))
        step = step.join(onward, ["doc_id", "next"]).select("doc_id", "start", F.col("_n2").alias("next")).checkpoint()
    picked = jumps.join(reached.distinct().withColumnRenamed("at", "start"), ["doc_id", "start"], "left_semi")
    numbered = dense(picked, KEY, "start", "batch_index")
    return numbered.select("doc_id", F.col("batch_index").cast("int").alias("batch_index"),
                           F.col("start").alias("start_paragraph"), F.col("end").alias("end_paragraph"))


def seed_before(order: WindowSpec) -> Column:
    """The last usable text among the five paragraphs before a row, 200 characters; null where it is empty."""
    usable = F.when(F.length("stripped") >= 3, F.left("pass0_text", F.lit(200)))
    return F.nullif(F.last(usable, ignorenulls=True).over(order.rangeBetween(-5, -1)), F.lit(""))


def batch_seeds(pass0: DataFrame, batches: DataFrame, size: int = BLOCK) -> DataFrame:
    """For each later batch, the last usable text among the five paragraphs before it, 200 characters."""
    rows = with_neighbours(pass0, KEY, "paragraph_index", lambda w: {"seed": seed_before(w)}, before=5, size=size)
    heads = batches.filter("batch_index > 0").withColumn("paragraph_index", F.col("start_paragraph"))
    return heads.join(rows.select("doc_id", "paragraph_index", "seed"), ["doc_id", "paragraph_index"]).select(
        "doc_id", "batch_index", "start_paragraph", "seed"
    )


def table_context(cells: DataFrame) -> DataFrame:
    """Header text of each cell's column, with the table's column count.

    ``cells`` has doc_id, text and a ``table:T:R:C:P`` location. Only header rows are gathered; their width is
    the number of columns of the table.
    """
    from redline.functions.text import location_parts

    parts = cells.withColumn("_l", location_parts(F.col("location"))).filter("_l.kind = 'table'")
    rows = parts.select("*", F.col("_l.i0").alias("table_no"), F.col("_l.i1").alias("row_no"), F.col("_l.i2").alias("col_index"))
    header = rows.filter("row_no = 0").groupBy("doc_id", "table_no").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("col_index", strip(F.col("text")).alias("t")))), lambda x: x["t"]
        ).alias("header_row")
    )
    return rows.join(header, ["doc_id", "table_no"], "left").select(
        "doc_id", "location", "text", "table_no", "row_no", "col_index",
        F.size("header_row").alias("num_cols"), F.get("header_row", F.col("col_index")).alias("col_header"),
        "header_row",
    )
