"""From paragraphs to proposed changes: profile, type, position, first pass, route, gates, disposition.

The whole chain is column expressions over the paragraph scan: nothing is shuffled until a report groups rows.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline import vocab as V
from redline.functions import edits, gates, protect, routing
from redline.functions.text import classify, contains_any, cost_e8, readability, requires_model, strip
from redline.operators.structure import CHUNK_OVER, page_estimate, position_columns
from redline.sources.presets import presets

STYLE = V.CORPUS_STYLE
ACCENTED = "áéíóúüñÁÉÍÓÚÜÑ"
PLAIN = "aeiouunAEIOUUN"
#: Columns of the proposals that patches() reads.
PATCH = [
    "doc_id", "lang", "paragraph_index", "n_paragraphs", "location", "stripped", "ops", "reverted", "applied", "route", "review_status",
    "review_reason", "origin", "final_text", "changed",
]
#: Columns of the proposals that patches() and usage() read.
PATCH_AND_USAGE = [
    "doc_id", "lang", "source", "paragraph_index", "n_paragraphs", "location", "intervention_level", "stripped", "pass0_text", "ops",
    "reverted", "applied", "route", "rewrite_ratio", "review_status", "review_reason", "origin", "final_text", "changed",
]


def fence(rows: DataFrame, names: list[str]) -> DataFrame:
    """Compute these columns here, once. A generator stops the optimiser from copying their long expressions
    into every filter and projection above."""
    keep = [c for c in rows.columns if c not in names]
    return rows.select(*keep, F.inline(F.array(F.struct(*names))))


def with_profile(paragraphs: DataFrame) -> DataFrame:
    """Profile columns per paragraph: preset ``doc_id % 10``, stronger intervention for one source, and the
    document's key word as an extra protected term."""
    fields = ["preset_no", "intervention_level", "max_rewrite_ratio", "max_expansion_ratio", "readability_min",
              "readability_max", "protected_terms", "disabled_rules"]
    table = F.broadcast(presets(paragraphs.sparkSession).select(*fields))
    rows = paragraphs.withColumn("preset_no", (F.col("doc_id") % 10).cast("int")).join(table, "preset_no")
    word = F.when(F.col("key_word") != "", F.array("key_word")).otherwise(F.array().cast("array<string>"))
    return rows.withColumn(
        "intervention_level", F.when(F.col("source") == "src0", "agresiva").otherwise(F.col("intervention_level"))
    ).withColumn("protected_terms", F.array_union("protected_terms", word))


def typed(paragraphs: DataFrame, terms: Column | None = None) -> DataFrame:
    """Adds stripped text, paragraph type and whether a model may touch it."""
    rows = fence(paragraphs.withColumn("stripped", strip(F.col("text"))), ["stripped"])
    kind = classify(F.col("stripped"), F.col("location"), F.col("style_name"), F.col("is_in_table"), terms)
    return rows.withColumn("paragraph_type", kind).withColumn("requires_model", requires_model(F.col("paragraph_type")))


def positioned(paragraphs: DataFrame) -> DataFrame:
    """Section position from the scan's own look-ahead; equal to structure.with_sections, without its shuffle."""
    index, n = F.col("paragraph_index"), F.col("n_paragraphs")
    chunked = ~F.col("has_sections") & (n > CHUNK_OVER)
    opens = F.col("style_name").isNotNull() & (index > 0)
    place = position_columns(opens, F.col("next_style").isNotNull(), index, n, chunked)
    return paragraphs.withColumns(place)


def first_pass(paragraphs: DataFrame) -> DataFrame:
    """Rule-corrected text with its log. The engine decision says whether the rules may touch this type and which of them
    are off; edits inside protected spans are undone. ``regions`` are the spans of the original, looked for only where
    something can change, and ``pass0_regions`` the same ones where they stand in the corrected text."""
    c = chain_columns(paragraphs.sparkSession.sparkContext.applicationId)
    rows = fence(paragraphs.withColumns({"_engine": c["engine"], "regions": c["regions"]}), ["_engine", "regions"])
    rows = fence(rows.withColumn("_fix", c["fix"]), ["_fix"])
    rows = rows.withColumns({
        "pass0_text": F.col("_fix.text"), "ops": F.col("_fix.ops"), "reverted": F.col("_fix.reverted"), "applied": c["applied"],
    })
    return rows.withColumn("pass0_regions", c["moved"]).drop("_fix", "_engine")


@cache
def chain_columns(application: str) -> dict[str, Column]:
    """The long expressions of the chain over its own column names. They are put together once for each application, as
    that takes thousands of calls into the JVM."""
    text = F.col("stripped")
    change = contains_any(text, [*edits.literals(V.EDIT_RULES), *[wrong for wrong, _ in STYLE]])
    fixed = edits.fix(text, V.EDIT_RULES, F.col("_engine.disabled_rules"), F.col("regions"))
    untouched = F.struct(text.alias("text"), F.array().alias("ops"), F.array().alias("reverted")).cast(edits.FIXED)
    ops = F.col("_fix.ops")
    return {
        "engine": routing.engines(F.col("paragraph_type"), F.col("disabled_rules")),
        "regions": F.when(change, protect.detect_regions(text, F.col("protected_terms"))).otherwise(protect.no_regions()),
        "fix": F.when(F.col("_engine.apply_rules"), fixed).otherwise(untouched),
        "applied": F.when(F.size("_fix.reverted") == 0, ops).otherwise(edits.applied(ops, F.col("regions"))),
        "moved": edits.moved(F.col("regions"), F.col("applied")),
        "styled": edits.style_fix(F.col("pass0_text"), STYLE, F.col("pass0_regions")),
    }


def stressed(text: Column) -> Column:
    """For test corpora: defects of a model's answer that make every gate fail somewhere."""
    doc, index = F.col("doc_id"), F.col("paragraph_index")
    return (
        F.when((doc % 17 == 0) & (index % 5 == 0), "")
        .when(doc % 13 == 0, F.concat(text, F.lit(" "), F.left(text, F.lit(40))))
        .when(doc % 11 == 0, F.translate(text, ACCENTED, PLAIN))
        .when((doc % 7 == 0) & (F.col("key_word") != ""), F.replace(text, F.col("key_word"), F.lit("")))
        .otherwise(text)
    )


def routed(paragraphs: DataFrame) -> DataFrame:
    choice = routing.route(
        F.col("pass0_text"), F.col("paragraph_type"), F.size("ops"), F.col("intervention_level"),
        F.col("is_transition"), F.col("section_position"),
    )
    return paragraphs.withColumn("_r", choice).withColumn("route", F.col("_r.route")).withColumn(
        "route_reason", F.col("_r.reason")
    ).drop("_r")


def prepared(documents: DataFrame) -> DataFrame:
    """Scan → usable paragraphs with profile, type, position, first pass and route."""
    from redline.sources.paragraphs import from_documents

    rows = typed(positioned(with_profile(from_documents(documents)))).filter(F.length("stripped") >= 3)
    rows = fence(rows.drop("next_text", "next_style"), ["paragraph_type", "section_position", "is_transition"])
    return fence(routed(first_pass(rows)), ["pass0_text", "ops", "reverted", "applied", "pass0_regions", "route", "route_reason"])


def proposed(rows: DataFrame, metric: str = "jaccard", rounded: bool = True, stress: bool = False) -> DataFrame:
    """Style step outside protected spans, gates and disposition. Keeps every row; ``changed`` marks those that became
    patches. A Python metric gets nulls for rows that no gate looks at."""
    styled = chain_columns(rows.sparkSession.sparkContext.applicationId)["styled"]
    rows = fence(rows.withColumn("candidate", F.when(F.col("route") == "skip", F.col("pass0_text")).otherwise(styled)), ["candidate"])
    if stress:
        rows = fence(rows.withColumn("candidate", F.when(F.col("route") == "skip", F.col("candidate")).otherwise(stressed(F.col("candidate")))), ["candidate"])
    gated = (F.col("route") != "skip") & (F.col("candidate") != F.col("stripped"))
    digits = 4 if rounded else None
    ratio = gates.rewrite_ratio(F.when(gated, F.col("stripped")), F.when(gated, F.col("candidate")), metric, digits)
    score = F.when(gated, readability(F.col("candidate"), 2 if rounded else None))
    rows = rows.withColumn("gated", gated).withColumns({"rewrite_ratio": F.when(gated, ratio), "_score": score})
    results = gates.run_gates(
        F.col("stripped"), F.col("candidate"), F.col("max_expansion_ratio"), F.col("max_rewrite_ratio"),
        F.col("protected_terms"), F.col("rewrite_ratio"), F.col("readability_min"), F.col("readability_max"),
        F.col("_score"), rounded,
    )
    rows = rows.withColumn("gates", F.when(F.col("gated"), results))
    rows = rows.withColumn("_d", F.when(F.col("gated"), gates.disposition(F.col("gates"))))
    status = F.coalesce("_d.status", F.lit("auto_accepted"))
    styled = (F.col("candidate") != F.col("pass0_text")) & (status != "gate_rejected")
    final = F.when(status == "gate_rejected", F.col("pass0_text")).otherwise(F.col("candidate"))
    rows = rows.select(
        *[c for c in rows.columns if c not in ("_d", "_score")],
        status.alias("review_status"), F.col("_d.reason").alias("review_reason"),
        F.when(styled, "languagetool+chatgpt").otherwise("languagetool").alias("origin"),
        final.alias("final_text"), (final != F.col("stripped")).alias("changed"),
    )
    return fence(rows, [
        "candidate", "gated", "rewrite_ratio", "gates", "review_status", "review_reason", "origin", "final_text", "changed",
    ])


def proposals(documents: DataFrame, metric: str = "jaccard", rounded: bool = False, stress: bool = False) -> DataFrame:
    """One row per usable paragraph with its decision; patches are the rows where ``changed``."""
    return proposed(prepared(documents), metric, rounded, stress)


def patches(proposal_rows: DataFrame) -> DataFrame:
    """One row per change of each changed paragraph; a single row when there is no change list."""
    index = F.col("paragraph_index")
    styled = F.col("origin").contains("chatgpt")
    style_change = F.struct(
        F.lit("STYLE").alias("rule_id"), F.lit(None).cast("string").alias("original"),
        F.lit(None).cast("string").alias("replacement"), F.lit(V.STYLE_CATEGORY).alias("category"),
    )
    done = F.transform("applied", lambda e: F.struct(e["rule_id"], e["original"], e["replacement"], e["category"]))
    changes = F.when(styled, F.concat(F.array(style_change), done))
    pages = F.greatest(F.lit(1), F.ceil(F.col("n_paragraphs") / 10)).cast("int")
    rows = proposal_rows.filter("changed").select(
        "doc_id", "lang", "paragraph_index", "location", F.col("stripped").alias("original_text"),
        F.col("final_text").alias("corrected_text"), F.col("origin").alias("source"), "route", "review_status",
        "review_reason", F.size("ops").alias("rule_hits"), F.size("reverted").alias("reverted"), "n_paragraphs",
        page_estimate(index, F.col("n_paragraphs"), pages).alias("page_no"),
        F.posexplode_outer(changes).alias("_pos", "_change"),
    )
    position = F.coalesce("_pos", F.lit(0))
    severity = F.create_map(*[F.lit(x) for pair in V.SEVERITY_OF.items() for x in pair])
    return rows.select(
        F.concat_ws("-", "doc_id", "paragraph_index", position).alias("patch_id"),
        *[c for c in rows.columns if not c.startswith("_")], position.alias("position"),
        F.col("_change.category").alias("category"), F.element_at(severity, F.col("_change.category")).alias("severity"),
        F.col("_change.rule_id").alias("rule_id"), F.col("_change.original").alias("change_original"),
        F.col("_change.replacement").alias("change_replacement"),
        F.when(F.col("source").contains("chatgpt"), "model").otherwise("rules").alias("model_used"),
    )


def usage(proposal_rows: DataFrame) -> DataFrame:
    """Model calls: one per routed paragraph, a second one where the second pass runs."""
    again = routing.second_pass(F.col("route"), F.col("rewrite_ratio"), F.col("intervention_level"), F.col("changed"))
    size = F.length("pass0_text")
    rows = proposal_rows.filter("route <> 'skip'").select(
        "doc_id", "paragraph_index", "route", "lang", "source",
        F.explode(F.when(again, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("pass_number"),
        (200 + F.floor(size / 4)).cast("long").alias("prompt_tokens"),
        (50 + F.floor(size / 4)).cast("long").alias("completion_tokens"),
        F.col("stripped").alias("original_text"), "pass0_text", "final_text",
    )
    second = F.col("pass_number") == 2
    return rows.select(
        "*",
        F.when(second, "editorial").otherwise(F.col("route")).alias("model_used"),
        F.when(second, "audit_pass2").otherwise(F.concat(F.lit("correction_"), F.col("route"))).alias("call_type"),
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        cost_e8(F.col("prompt_tokens"), F.col("completion_tokens")).alias("cost_e8"),
    )


def audit_log(usage_rows: DataFrame) -> DataFrame:
    """Calls with their raw response JSON; some fail; second passes list ``doc_id % 3`` reversions."""
    failed = (F.col("doc_id") + F.col("paragraph_index")) % 37 == 0
    second = F.col("pass_number") == 2
    reverted = F.transform(
        F.filter(F.array(F.lit(1), F.lit(2)), lambda i: i <= F.col("doc_id") % 3),
        lambda i: F.struct(i.cast("string").alias("original_term")),
    )
    content = F.when(second, F.to_json(F.struct(F.col("final_text").alias("final_text"), reverted.alias("reverted_destructions")))).otherwise(
        F.to_json(F.struct(F.lit("correct").alias("action"), F.col("final_text").alias("corrected_text")))
    )
    response = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    return usage_rows.select(
        "doc_id", "paragraph_index", "pass_number", "model_used", "prompt_tokens", "completion_tokens",
        "total_tokens", "cost_e8", "original_text", "pass0_text", "final_text",
        F.when(second, "contextual_audit").otherwise("mechanical_correction").alias("call_purpose"),
        F.when(failed, "timeout").alias("error_text"),
        F.when(~failed, response).alias("response_json"),
    )


def triage_report(proposal_rows: DataFrame) -> DataFrame:
    """Corpus triage: language × route × decision with counts and summed readability parts."""
    from redline.functions.text import sentence_count, syllable_count, word_count

    return proposal_rows.groupBy("lang", "route", "review_status").agg(
        F.count("*").alias("paragraphs"),
        F.count_if("changed").alias("changed"),
        F.sum(F.size("ops")).cast("long").alias("rule_hits"),
        F.sum(word_count(F.col("stripped"))).cast("long").alias("words"),
        F.sum(syllable_count(F.col("stripped"))).cast("long").alias("syllables"),
        F.sum(sentence_count(F.col("stripped"))).cast("long").alias("sentences"),
    )
