"""Reports over patches, usage, audit calls and document state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redline import vocab as V
from redline.functions.text import preview, usd
from redline.operators.ordered import BLOCK, dense, running, with_neighbours


def is_model(source: Column) -> Column:
    return source.contains("chatgpt") | (source == "llm")


# --- corrections ---------------------------------------------------------------------------------------


def corrections_list(patches: DataFrame, status: str | None = None, page_no: int | None = None) -> DataFrame:
    rows = patches
    if status is not None:
        rows = rows.filter(F.col("review_status") == status)
    if page_no is not None:
        rows = rows.filter(F.col("page_no") == page_no)
    return rows.orderBy("doc_id", "page_no", "paragraph_index", "position")


def facet_filter(
    patches: DataFrame, source: str | None = None, category: str | None = None, severity: str | None = None,
    search: str | None = None,
) -> DataFrame:
    rows = patches
    if source == "languagetool":
        rows = rows.filter(F.col("source") == "languagetool")
    elif source is not None:
        rows = rows.filter(is_model(F.col("source")))
    if category is not None:
        rows = rows.filter(F.col("category") == category)
    if severity is not None:
        rows = rows.filter(F.col("severity") == severity)
    if search and search.strip():
        needle = F.lit(search.lower())
        rows = rows.filter(
            F.contains(F.lower("original_text"), needle) | F.contains(F.lower("corrected_text"), needle)
        )
    return rows


def categories(patches: DataFrame) -> DataFrame:
    return patches.filter("category <> ''").select("category").distinct()


def facet_counts(patches: DataFrame) -> DataFrame:
    """Counters of the correction history: source class, route, validation."""
    c, s = F.col("route"), F.col("review_status")
    return patches.groupBy("doc_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("source") == "languagetool").alias("rule_engine"),
        F.count_if(is_model(F.col("source"))).alias("model"),
        *[F.count_if(c == r).alias(f"route_{r}") for r in V.ROUTES],
        F.count_if(s == "auto_accepted").alias("validated"),
        F.count_if(s == "manual_review").alias("flagged"),
        F.count_if(s == "gate_rejected").alias("rejected"),
    )


def top_categories(patches: DataFrame, k: int = 4) -> DataFrame:
    return patches.filter("category is not null").groupBy("category").agg(F.count("*").alias("corrections")).orderBy(
        F.col("corrections").desc(), "category"
    ).limit(k)


def review_summary(patches: DataFrame) -> DataFrame:
    """Per document: seven status counts, three severity counts, what may be finalised."""
    s = F.col("review_status")
    counts = patches.groupBy("doc_id").agg(
        F.count("*").alias("total_patches"),
        *[F.count_if(s == v).alias(v) for v in V.REVIEW_STATUSES],
        *[F.count_if(F.col("severity") == v).alias(v) for v in V.SEVERITIES],
    )
    return counts.withColumns({
        "can_finalize_strict": (F.col("pending") == 0) & (F.col("manual_review") == 0),
        "can_finalize_quick": F.col("total_patches") > 0,
    })


def review_by_page(patches: DataFrame) -> DataFrame:
    return patches.groupBy("doc_id", "page_no", "review_status").agg(F.count("*").alias("patches"))


def join_layout(patches: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Patch → block → page, inner."""
    return patches.join(blocks, ["doc_id", "page_no", "block_no"]).join(pages, ["doc_id", "page_no"])


def with_cost(patches: DataFrame, usage: DataFrame) -> DataFrame:
    """Model cost of the paragraph, summed first and shown on the paragraph's first patch row only."""
    cost = usage.groupBy("doc_id", "paragraph_index").agg(
        F.sum("cost_e8").alias("_c"), F.sum("total_tokens").alias("_t"), F.count("*").alias("_n")
    ).withColumn("position", F.lit(0))
    return patches.join(cost, ["doc_id", "paragraph_index", "position"], "left").select(
        *patches.columns, F.col("_c").alias("cost_e8"), F.col("_t").alias("total_tokens"), F.col("_n").alias("calls")
    )


def pages_with_patch_counts(pages: DataFrame, patches: DataFrame) -> DataFrame:
    counts = patches.groupBy("doc_id", "page_no").agg(F.count("*").alias("_n"))
    return pages.join(counts, ["doc_id", "page_no"], "left").select(
        *pages.columns, F.coalesce("_n", F.lit(0)).alias("patches")
    )


def fan_out_versions(patches: DataFrame, size: int = BLOCK) -> DataFrame:
    """Running version number per document, in order of paragraph and change."""
    per_paragraph = patches.groupBy("doc_id", "paragraph_index").agg(F.count("*").alias("_rows"))
    upto = running(per_paragraph, ["doc_id"], "paragraph_index", {"_upto": F.col("_rows")}, size=size).select(
        "doc_id", "paragraph_index", (F.col("_upto") - F.col("_rows")).alias("_base")
    )
    return patches.join(upto, ["doc_id", "paragraph_index"]).withColumn(
        "version", (F.col("_base") + F.col("position") + 1).cast("long")
    ).drop("_base")


def correction_flow(patches: DataFrame, usage: DataFrame, size: int = BLOCK) -> DataFrame:
    """Steps of the correction of a document: per patch a rule step (when rules hit) and a model step.

    A model step knows how many patches came before it and the first hundred characters of the last three.
    """
    key = ["doc_id", "paragraph_index"]
    rows = fan_out_versions(patches, size).withColumn("_i", F.col("version") - 1)
    rows = with_neighbours(
        rows, ["doc_id"], "_i",
        lambda w: {"context_preview": F.collect_list(preview(F.col("corrected_text"), 100)).over(w.rowsBetween(-3, -1))},
        before=3, size=size,
    )
    cost = usage.groupBy(*key).agg(F.sum("cost_e8").alias("cost_e8"))
    rows = rows.join(cost, key, "left")
    rule = F.when(F.col("rule_hits") > 0, F.struct(
        F.lit("languagetool").alias("type"), F.lit(0).cast("long").alias("context_blocks"),
        F.lit(None).cast("array<string>").alias("context_preview"), F.lit(None).cast("long").alias("cost_e8"),
    ))
    model = F.when(is_model(F.col("source")), F.struct(
        F.lit("chatgpt_style").alias("type"), F.col("_i").alias("context_blocks"), "context_preview", "cost_e8",
    ))
    steps = rows.select(
        "doc_id", "paragraph_index", F.col("_i").alias("block_no"),
        F.posexplode(F.array_compact(F.array(rule, model))).alias("_k", "_s"),
    )
    steps = steps.select("doc_id", "paragraph_index", "block_no", (F.col("block_no") * 2 + F.col("_k")).alias("_order"), "_s.*")
    return dense(steps, ["doc_id"], "_order", "step", size=2 * size).withColumn("step", F.col("step") + 1).drop("_order")


def flow_summary(patches: DataFrame, usage: DataFrame) -> DataFrame:
    per_doc = patches.groupBy("doc_id").agg(
        F.count("*").alias("total_blocks"),
        (F.count_if(F.col("rule_hits") > 0) + F.count_if(is_model(F.col("source")))).alias("total_requests"),
        F.count_if(F.col("source") == "languagetool").alias("rule_requests"),
        F.count_if(is_model(F.col("source"))).alias("model_requests"),
    )
    cost = usage.groupBy("doc_id").agg(F.sum("cost_e8").alias("_c"))
    return per_doc.join(cost, "doc_id", "left").select(
        *per_doc.columns, usd(F.coalesce("_c", F.lit(0))).alias("total_cost_usd")
    )


# --- analysis ------------------------------------------------------------------------------------------


def analysis_stats(typed_rows: DataFrame, sections: DataFrame, term_rows: DataFrame) -> DataFrame:
    """Per document: paragraphs, sections, terms, types map, paragraphs that may go to a model."""
    kinds = typed_rows.filter("stripped <> ''").groupBy("doc_id", "paragraph_type").agg(
        F.count("*").alias("n"), F.count_if("requires_model").alias("m")
    )
    per_doc = kinds.groupBy("doc_id").agg(
        F.sum("n").alias("non_empty_paragraphs"),
        F.sum("m").alias("needing_model"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("paragraph_type", "n")))).alias("paragraph_types"),
    )
    totals = typed_rows.groupBy("doc_id").agg(F.count("*").alias("total_paragraphs"))
    secs = sections.groupBy("doc_id").agg(F.count("*").alias("sections_detected"))
    found = term_rows.groupBy("doc_id").agg(
        F.count("*").alias("_terms"), F.count_if("is_protected").alias("_protected")
    )
    return totals.join(per_doc, "doc_id", "left").join(secs, "doc_id", "left").join(found, "doc_id", "left").select(
        "doc_id", "total_paragraphs", F.coalesce("non_empty_paragraphs", F.lit(0)).alias("non_empty_paragraphs"),
        "sections_detected", F.coalesce("_terms", F.lit(0)).alias("terms_extracted"),
        F.coalesce("_protected", F.lit(0)).alias("terms_protected"),
        F.coalesce("needing_model", F.lit(0)).alias("needing_model"), "paragraph_types",
    )


def share_of_types(typed_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Type counts with their share; the window runs over the handful of grouped rows."""
    by = by or []
    counts = typed_rows.filter("stripped <> ''").groupBy(*by, "paragraph_type").agg(F.count("*").alias("paragraphs"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return counts.withColumn("share", F.col("paragraphs") / F.sum("paragraphs").over(whole))


def gate_outcomes(proposals: DataFrame) -> DataFrame:
    return proposals.filter("gated").select(F.explode("gates").alias("g")).groupBy(F.col("g.gate_name").alias("gate_name")).agg(
        F.count_if("g.passed").alias("ok"), F.count_if(~F.col("g.passed")).alias("failed")
    )


def route_counts(proposals: DataFrame) -> DataFrame:
    """Language × route with subtotals."""
    return proposals.cube("lang", "route").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("paragraphs"), F.count_if("gated").alias("gated"),
        F.count_if(F.col("review_status") == "gate_rejected").alias("rejected"),
        F.count_if(F.col("review_status") == "manual_review").alias("flagged"),
    )


# --- cost ----------------------------------------------------------------------------------------------


def cost_summary(usage: DataFrame) -> DataFrame:
    calls, docs, cost = F.col("total_calls"), F.col("total_documents"), F.col("_c")
    return usage.agg(
        F.count("*").alias("total_calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("cost_e8"), F.lit(0)).alias("_c"), F.countDistinct("doc_id").alias("total_documents"),
    ).select(
        "total_calls", "prompt_tokens", "completion_tokens", "total_tokens", "total_documents", usd(cost).alias("total_cost_usd"),
        (cost / F.greatest(docs, F.lit(1))).alias("avg_e8_per_document"), (cost / F.greatest(calls, F.lit(1))).alias("avg_e8_per_call"),
    )


def cost_by_model(usage: DataFrame) -> DataFrame:
    """Grand total and per-model rows in one pass (grouping sets)."""
    return usage.groupingSets([[], [F.col("model_used")]], F.col("model_used")).agg(
        F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"), usd(F.sum("cost_e8")).alias("cost_usd"),
    )


def cost_by_document(usage: DataFrame, documents: DataFrame) -> DataFrame:
    """Usage is summed per document before it meets the document rows."""
    per_doc = usage.groupBy("doc_id").agg(
        F.count("*").alias("total_calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum("total_tokens").alias("total_tokens"),
        usd(F.sum("cost_e8")).alias("total_cost_usd"),
    )
    return documents.join(per_doc, "doc_id")


def paged(df: DataFrame, order: list[Column], skip: int = 0, limit: int = 50) -> DataFrame:
    """One page of a list; the order must end in a unique key."""
    return df.orderBy(*order).offset(skip).limit(limit)


def document_totals(doc_rows: DataFrame, usage: DataFrame) -> DataFrame:
    """Token totals per document, with the legacy columns where there is no usage row."""
    per_doc = usage.groupBy("doc_id").agg(F.sum("total_tokens").alias("_t"), F.sum("cost_e8").alias("_c"))
    tokens, legacy = F.coalesce("_t", F.lit(0)), F.coalesce("legacy_tokens", F.lit(0))
    use_legacy = (tokens == 0) & (legacy > 0)
    return doc_rows.join(per_doc, "doc_id", "left").select(
        "doc_id", F.when(use_legacy, legacy).otherwise(tokens).alias("total_tokens"),
        F.when(use_legacy, F.coalesce("legacy_cost_e8", F.lit(0))).otherwise(F.coalesce("_c", F.lit(0))).alias("cost_e8"),
        use_legacy.alias("is_legacy"),
    )


def cost_share(usage: DataFrame) -> DataFrame:
    """Cost of each document over the highest one: the maximum is a scalar subquery, not a global window."""
    per_doc = usage.groupBy("doc_id").agg(F.sum("cost_e8").alias("cost_e8"))
    top = per_doc.agg(F.max("cost_e8")).scalar()
    return per_doc.select("doc_id", "cost_e8", (F.col("cost_e8") / top).alias("share"))


# --- audit ---------------------------------------------------------------------------------------------


def audit_list(
    audit: DataFrame, pass_number: int | None = None, purpose: str | None = None, has_error: bool | None = None
) -> DataFrame:
    rows = audit
    if pass_number is not None:
        rows = rows.filter(F.col("pass_number") == pass_number)
    if purpose:
        rows = rows.filter(F.col("call_purpose") == purpose)
    if has_error is not None:
        rows = rows.filter(F.col("error_text").isNotNull() if has_error else F.col("error_text").isNull())
    return rows.orderBy("doc_id", "paragraph_index", "pass_number")


def audit_content(audit: DataFrame) -> Column:
    return F.get_json_object("response_json", "$.choices[0].message.content")


def reversions(audit: DataFrame) -> Column:
    """How many reverted terms a second-pass response lists."""
    parsed = F.from_json(audit_content(audit), "struct<reverted_destructions:array<struct<original_term:string>>>")
    return F.when(F.col("pass_number") == 2, F.greatest(F.coalesce(F.size(parsed["reverted_destructions"]), F.lit(0)), F.lit(0))).otherwise(0)


def audit_stats(audit: DataFrame) -> DataFrame:
    """Per document. Distinct paragraphs are counted by grouping paragraphs first, so a big document spreads."""
    per_paragraph = audit.withColumn("_rev", reversions(audit)).groupBy("doc_id", "paragraph_index").agg(
        F.count("*").alias("_n"), F.count_if(F.col("pass_number") == 1).alias("_p1"),
        F.count_if(F.col("pass_number") == 2).alias("_p2"), F.sum("_rev").alias("_rev"),
        F.count_if(F.col("error_text").isNotNull()).alias("_err"),
    )
    return per_paragraph.groupBy("doc_id").agg(
        F.sum("_n").alias("total_calls"), F.sum("_p1").alias("pass1_calls"), F.sum("_p2").alias("pass2_calls"),
        F.count("paragraph_index").alias("paragraphs_with_audit"), F.sum("_rev").alias("reversions"), F.sum("_err").alias("errors"),
    )


def audit_by_paragraph(audit: DataFrame, only_second_pass: bool = False) -> DataFrame:
    rows = audit.groupBy("doc_id", F.coalesce("paragraph_index", F.lit(-1)).alias("paragraph_index")).agg(
        F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"), F.bool_or(F.col("pass_number") == 2).alias("has_pass2"),
        F.array_sort(F.collect_list("pass_number")).alias("passes"),
    )
    return rows.filter("has_pass2") if only_second_pass else rows


def audit_detail(audit: DataFrame) -> DataFrame:
    """All calls of a paragraph with their raw responses, by pass (a paragraph has at most a few)."""
    call = F.struct("pass_number", "call_purpose", "model_used", "total_tokens", "error_text", "response_json")
    return audit.groupBy("doc_id", "paragraph_index").agg(F.array_sort(F.collect_list(call)).alias("calls"))


def audit_diff(patches: DataFrame, audit: DataFrame) -> DataFrame:
    """Original, first-pass and final text of a paragraph next to what each pass cost; latest patch row wins."""
    key = ["doc_id", "paragraph_index"]
    latest = patches.groupBy(*key).agg(
        F.max_by(F.struct("original_text", "corrected_text", "review_status"), "position").alias("_p")
    )
    calls = audit.groupBy(*key).pivot("pass_number", [1, 2]).agg(
        F.first("total_tokens").alias("tokens"), F.first("model_used").alias("model")
    )
    first = audit.filter("pass_number = 1").select(*key, "pass0_text")
    return latest.join(calls, key, "full_outer").join(first, key, "left").select(
        *key, F.col("_p.original_text").alias("original_text"), F.col("pass0_text").alias("pass1_text"),
        F.col("_p.corrected_text").alias("final_text"), F.col("_p.review_status").alias("review_status"),
        F.col("1_tokens").alias("pass1_tokens"), F.col("1_model").alias("pass1_model"),
        F.col("2_tokens").alias("pass2_tokens"), F.col("2_model").alias("pass2_model"), F.col("2_tokens").isNotNull().alias("has_pass2"),
    )


# --- documents -------------------------------------------------------------------------------------------


def stage_dimension(spark) -> DataFrame:
    """Nine rows, fixed."""
    return spark.createDataFrame(V.STAGES, "status string, stage_start double, stage_end double, stage_label string")


def progress(doc_status: DataFrame) -> DataFrame:
    """Progress, ETA and stall flag. Time is the ``as_of`` column; nothing reads the clock."""
    rows = doc_status.join(F.broadcast(stage_dimension(doc_status.sparkSession)), "status", "left")
    s = F.col("status")
    current, total = F.col("stage_current"), F.col("stage_total")
    fraction = F.when((total > 0) & current.isNotNull(), F.least(current / total, F.lit(1.0))).otherwise(0.0)
    share = (
        F.when(s == "completed", 1.0).when(s.isin("pending_review", "candidate_ready"), 0.85)
        .when(s.isin("uploaded", "failed") | F.col("stage_start").isNull(), 0.0)
        .otherwise(F.col("stage_start") + (F.col("stage_end") - F.col("stage_start")) * fraction)
    )
    idle = s.isin("uploaded", "completed", "pending_review", "candidate_ready")
    stalled = F.unix_timestamp("as_of") - F.unix_timestamp("heartbeat_at") > V.STALL_SECONDS
    elapsed = F.unix_timestamp("as_of") - F.unix_timestamp("stage_started_at")
    eta = F.when((current > 0) & (total > 0) & ~stalled & (elapsed > 0), (total - current) / (current / elapsed))
    return rows.select(
        "doc_id", "status", share.alias("progress"), F.when(~idle, F.col("stage_label")).alias("stage_label"),
        F.when(~idle, stalled).alias("is_stalled"), F.when(~idle, eta).alias("eta_seconds"),
    )


def dashboard(doc_status: DataFrame) -> DataFrame:
    s = F.col("status")
    return doc_status.agg(
        F.count("*").alias("documents"),
        F.count_if(~s.isin("uploaded", "completed", "failed", "pending_review", "candidate_ready")).alias("processing"),
        F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"),
        F.sum(F.coalesce("total_pages", F.lit(0))).alias("total_pages"),
    )


def pages_by_status(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id", "status").agg(F.count("*").alias("pages"))


def batch_progress(batches: DataFrame) -> DataFrame:
    return batches.groupBy("doc_id").agg(
        F.count("*").alias("batches"), F.count_if(F.col("status") == "completed").alias("completed"),
        (F.count_if(F.col("status") == "completed") / F.count("*")).alias("share"),
    )


def error_catalogue(catalogue: DataFrame, corrected: DataFrame) -> DataFrame:
    """Seeded errors against corrected text: fixed when the expected form is there and the wrong one is gone.

    ``catalogue``: error_id, doc_id, paragraph_index, category, wrong, expected. ``corrected``: doc_id,
    paragraph_index, run, text.
    """
    fixed = F.contains("text", F.col("expected")) & ((F.col("wrong") == "") | ~F.contains("text", F.col("wrong")))
    return catalogue.join(corrected, ["doc_id", "paragraph_index"]).groupBy("category").pivot("run", ["A", "B"]).agg(
        F.count_if(fixed).alias("fixed"), F.count(F.lit(1)).alias("errors")
    )
