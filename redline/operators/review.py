"""The review state machine: decisions, edits and finalisation as functions from old rows to new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redline import vocab as V
from redline.functions.text import strip
from redline.operators.ordered import BLOCK, block_of, by_document

MAX_PER_PATCH, MAX_PER_HOUR = 3, 20
HOUR = 3600
VERDICTS = ("accepted", "rejected")


def effective_text(edited: Column, corrected: Column) -> Column:
    return F.coalesce(F.nullif(edited, F.lit("")), corrected)


def decision_source(patches: DataFrame) -> Column:
    """Who decided last; rows that a step leaves alone keep it."""
    return F.col("decision_source") if "decision_source" in patches.columns else F.lit("system")


def check_decisions(decisions: DataFrame, patches: DataFrame, doc_status: DataFrame) -> DataFrame:
    """Each decision with its verdict: valid, unknown_patch, bad_state or bad_action."""
    known = patches.select("patch_id").withColumn("_known", F.lit(True))
    state = doc_status.select("doc_id", "status")
    joined = decisions.join(state, "doc_id", "left").join(known, "patch_id", "left")
    verdict = (
        F.when(F.col("_known").isNull(), "unknown_patch")
        .when(~F.coalesce(F.col("status").isin(V.REVIEWABLE_STATES), F.lit(False)), "bad_state")
        .when(~F.col("action").isin(*VERDICTS), "bad_action")
        .otherwise("valid")
    )
    return joined.select(*decisions.columns, verdict.alias("verdict"))


def apply_decisions(patches: DataFrame, decisions: DataFrame, doc_status: DataFrame) -> DataFrame:
    """The latest valid decision per patch becomes its status. A verdict depends on patch, document and action alone, so the
    latest decision of each three stands for all of them: decisions combine before the shuffle."""
    each = decisions.filter(F.col("action").isin(*VERDICTS)).groupBy("doc_id", "patch_id", "action").agg(
        F.max(F.struct("ts", "event_id")).alias("_t")
    )
    valid = check_decisions(each.select("doc_id", "patch_id", "action", "_t.*"), patches, doc_status).filter("verdict = 'valid'")
    latest = valid.groupBy("patch_id").agg(
        F.max(F.struct("ts", "event_id", "action")).alias("_d")
    )
    return patches.join(latest, "patch_id", "left").select(
        *[c for c in patches.columns if c not in ("review_status", "decision_source")],
        F.coalesce("_d.action", "review_status").alias("review_status"),
        F.when(F.col("_d").isNotNull(), "human").otherwise(decision_source(patches)).alias("decision_source"),
        F.col("_d.ts").alias("reviewed_at"),
    )


def bulk_lookup(requested: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requested ids that exist, and those that do not."""
    ids = requested.select("patch_id").distinct()
    known = patches.select("patch_id")
    return ids.join(known, "patch_id", "left_semi"), ids.join(known, "patch_id", "left_anti")


def finalize_quick(patches: DataFrame, doc_status: DataFrame) -> DataFrame:
    """Open patches of documents under review become bulk_finalized."""
    state = doc_status.select("doc_id", F.col("status").isin(V.FINALIZABLE_STATES).alias("_may"))
    hit = F.coalesce(F.col("_may"), F.lit(False)) & F.col("review_status").isin("pending", "manual_review")
    joined = patches.join(state, "doc_id", "left")
    return joined.select(
        *[c for c in patches.columns if c not in ("review_status", "decision_source")],
        F.when(hit, "bulk_finalized").otherwise(F.col("review_status")).alias("review_status"),
        F.when(hit, "bulk_finalize").otherwise(decision_source(patches)).alias("decision_source"),
    )


def finalize_strict(patches: DataFrame, doc_status: DataFrame) -> DataFrame:
    """Per document: open patches, and whether strict finalisation is allowed."""
    counts = patches.groupBy("doc_id").agg(
        F.count("*").alias("patches"),
        F.count_if(F.col("review_status").isin("pending", "manual_review")).alias("unresolved"),
    )
    return doc_status.select("doc_id", "status").join(counts, "doc_id", "left").select(
        "doc_id", "status", F.coalesce("patches", F.lit(0)).alias("patches"),
        F.coalesce("unresolved", F.lit(0)).alias("unresolved"),
        (F.col("status").isin(V.FINALIZABLE_STATES) & (F.coalesce("unresolved", F.lit(0)) == 0)).alias("can_finalize"),
    )


def transitions(doc_status: DataFrame) -> DataFrame:
    """What each document's state allows: process, review, finalize, reopen (to candidate_ready)."""
    s = F.col("status")
    return doc_status.select(
        "doc_id", "status", s.isin(V.PROCESSABLE_STATES).alias("can_process"), s.isin(V.REVIEWABLE_STATES).alias("can_review"),
        s.isin(V.FINALIZABLE_STATES).alias("can_finalize"), (s == "completed").alias("can_reopen"),
        F.when(s == "completed", "candidate_ready").otherwise(s).alias("status_if_reopened"),
    )


def manual_edits(patches: DataFrame, edits: DataFrame, doc_status: DataFrame) -> DataFrame:
    """Edits with their verdict: 1 to 10,000 characters, at most twice the original plus 100, document of the patch under
    review. The size of the original and the state come with the patch, so that edited texts are joined once, by patch."""
    state = patches.select("patch_id", "doc_id", F.length("original_text").alias("_size")).join(
        doc_status.select("doc_id", "status"), "doc_id"
    ).drop("doc_id")
    joined = edits.join(state, "patch_id")
    size = F.length("edited_text")
    verdict = (
        F.when(~F.col("status").isin(V.REVIEWABLE_STATES), "bad_state")
        .when(~size.between(1, 10000), "bad_length")
        .when(size > F.col("_size") * 2 + 100, "too_long")
        .otherwise("accepted")
    )
    return joined.select("event_id", "patch_id", "doc_id", "ts", "edited_text", verdict.alias("verdict"))


def apply_edits(patches: DataFrame, checked: DataFrame) -> DataFrame:
    """The latest accepted edit per patch sets edited_text, status accepted and source manual_edit."""
    latest = checked.filter("verdict = 'accepted'").groupBy("patch_id").agg(
        F.max(F.struct("ts", "event_id", "edited_text")).alias("_e")
    )
    hit = F.col("_e").isNotNull()
    return patches.join(latest, "patch_id", "left").select(
        *[c for c in patches.columns if c not in ("review_status", "decision_source")],
        F.col("_e.edited_text").alias("edited_text"),
        F.when(hit, "accepted").otherwise(F.col("review_status")).alias("review_status"),
        F.when(hit, "manual_edit").otherwise(decision_source(patches)).alias("decision_source"),
    )


def recorrection_limits(requests: DataFrame) -> DataFrame:
    """Requests allowed so far: at most three per patch, twenty per document in the hour up to the request.

    The hour never needs more than the bucket of the request and the one before, so windows run per
    (document, hour bucket) with each row copied to the next bucket. The running number per patch is cut the
    same way: bucket counts are summed on a small table.
    """
    rows = requests.withColumn("_s", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = rows.withColumn("_home", F.floor(F.col("_s") / (HOUR * 1000000)))
    spread = rows.withColumn("_bucket", F.explode(F.array("_home", F.col("_home") + 1)))
    hour = Window.partitionBy("doc_id", "_bucket").orderBy("_s").rangeBetween(-HOUR * 1000000, 0)
    rows = spread.withColumn("in_hour", F.count("*").over(hour)).filter("_bucket = _home").drop("_bucket")
    counts = rows.groupBy("doc_id", "patch_id", "_home").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("patch_id").orderBy("_home").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = Window.partitionBy("patch_id", "_home").orderBy("_s", "event_id")
    rows = rows.join(counts, ["doc_id", "patch_id", "_home"]).withColumn(
        "request_no", F.col("_before") + F.row_number().over(within)
    )
    verdict = (
        F.when(F.col("request_no") > MAX_PER_PATCH, "patch_limit").when(F.col("in_hour") > MAX_PER_HOUR, "hour_limit")
        .otherwise("allowed")
    )
    return rows.select("event_id", "doc_id", "patch_id", "ts", "request_no", "in_hour", verdict.alias("verdict"))


def apply_recorrections(patches: DataFrame, results: DataFrame) -> DataFrame:
    """New texts no longer than 2.2 times the original replace the corrected text and reopen the patch."""
    joined = patches.join(results.select("patch_id", F.col("new_text")), "patch_id", "left")
    ok = F.coalesce((F.col("new_text") != "") & (F.length("new_text") <= F.length("original_text") * 2.2), F.lit(False))
    return joined.select(
        *[c for c in patches.columns if c not in ("corrected_text", "review_status", "decision_source")],
        F.when(ok, F.col("new_text")).otherwise(F.col("corrected_text")).alias("corrected_text"),
        F.when(ok, "pending").otherwise(F.col("review_status")).alias("review_status"),
        F.when(ok, "ai_recorrection").otherwise(decision_source(patches)).alias("decision_source"),
    )


def one_per_paragraph(patches: DataFrame) -> DataFrame:
    """First patch row of each paragraph with the ids of all its rows."""
    rest = [c for c in patches.columns if c not in ("doc_id", "paragraph_index", "patch_id")]
    return patches.groupBy("doc_id", "paragraph_index").agg(
        F.min_by(F.struct("patch_id", *rest), "position").alias("_p"),
        F.array_sort(F.collect_list("patch_id")).alias("patch_ids"),
    ).select("doc_id", "paragraph_index", "_p.*", "patch_ids")


def approved(patches: DataFrame, apply_mode: str = "accepted_and_auto") -> DataFrame:
    return patches.filter(F.col("review_status").isin(V.APPLY_MODES[apply_mode]))


def not_rejected(patches: DataFrame) -> DataFrame:
    return patches.filter(~F.col("review_status").isin("rejected", "gate_rejected"))


def paragraph_texts(patches: DataFrame) -> DataFrame:
    """Texts of the changed paragraphs, one row each: the patches of a paragraph all repeat its texts, once for every change."""
    return patches.filter("position = 0").select("doc_id", "paragraph_index", "location", "original_text", "corrected_text")


def apply_to_text(paragraphs: DataFrame, chosen: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Paragraphs with the chosen patches in place, of several for a place the one of lowest position. A patch whose
    original no longer matches is stale.

    ``texts``: see paragraph_texts. The patches' texts are then read there, and take no part in the steps that led to the
    choice. All rows are dealt by document once, and so is the result: pages and documents are put together without
    another shuffle of text. Of an original only its digest is sent, as it is only compared.
    """
    edited = F.col("edited_text") if "edited_text" in chosen.columns else F.lit(None).cast("string")
    more = [c for c in ("n_paragraphs",) if c in paragraphs.columns]

    def digest(text: Column) -> Column:
        return F.unhex(F.sha2(text, 256))

    pick = ["position", "patch_id", edited.alias("edited")]
    text = F.struct(digest(F.col("original_text")).alias("old"), F.col("corrected_text").alias("new")).alias("text")
    if texts is None:
        patches = chosen.select("doc_id", "location", F.struct(*pick, text).alias("_pick"), F.lit(None).alias("_text"))
    else:
        patches = chosen.select("doc_id", "location", F.struct(*pick).alias("_pick")).unionByName(
            texts.select("doc_id", "location", text.alias("_text")), allowMissingColumns=True
        )
    rows = paragraphs.select("doc_id", "paragraph_index", "location", "text", *more)
    place = Window.partitionBy("doc_id", "location")
    joined = by_document(rows.unionByName(patches.filter("location is not null"), allowMissingColumns=True)).withColumns({
        "_pick": F.min("_pick").over(place), "_text": F.max("_text").over(place),
    }).filter("paragraph_index is not null")
    put = F.col("_pick.text") if texts is None else F.when(F.col("_pick").isNotNull(), F.col("_text"))
    joined = joined.select(*rows.columns, F.col("_pick.edited").alias("_edited"), put["old"].alias("_old"), put["new"].alias("_new"))
    fits = F.coalesce(F.when(F.col("_old").isNotNull(), digest(strip(F.col("text"))) == F.col("_old")), F.lit(False))
    joined = joined.withColumn("applied", fits)
    return joined.select(
        "doc_id", "paragraph_index", "location", *more,
        F.when(F.col("applied"), effective_text(F.col("_edited"), F.col("_new"))).otherwise(F.col("text")).alias("text"),
        "applied", (F.col("_old").isNotNull() & ~F.col("applied")).alias("stale"),
    )


def render(applied: DataFrame, size: int = BLOCK) -> DataFrame:
    """Document text again, one row for each document, as it came: a document fits a row in its source. Paragraphs are
    joined in blocks of ``size`` first, so that the last step handles few pieces; the result is the same for any size."""

    def in_order(place: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, "text"))), lambda p: p["text"]), "\n").alias("text")

    pieces = applied.withColumn("_piece", block_of("paragraph_index", size)).groupBy("doc_id", "_piece").agg(
        in_order("paragraph_index"), F.count_if("applied").alias("applied"), F.count_if("stale").alias("stale")
    )
    return pieces.groupBy("doc_id").agg(in_order("_piece"), F.sum("applied").alias("applied"), F.sum("stale").alias("stale"))


def missing_patches(paragraphs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Patches whose location no longer exists."""
    return chosen.join(paragraphs.select("doc_id", "location"), ["doc_id", "location"], "left_anti")


def delete_documents(table: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Rows of a table that survive the deletion of some documents."""
    return table.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")
