"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.llm import decontaminate, filter_audit, hard_negatives, html_render, jaccard_join, kneser_ney, norm_search, oracle, phrase_automata, quality_model, repetition, source_mixing, token_output, toxicity
from redline.session import store


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    """The public vocabulary file; its folder comes with the installed package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_output(spark: SparkSession, folder: str) -> DataFrame:
    segments = store(token_output.encode_documents(table(spark, folder, "documents"), tokenizer_path()), "token-segments")
    return token_output.read_documents(segments)


def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_render.render_pages(table(spark, folder, "pages"))


def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, folder, "documents")).drop("tie", "comp")


#: Language weights that the mixture should have, in words.
MIX_TARGETS = {"en": 0.52, "de": 0.17, "fr": 0.17, "es": 0.14}


def language_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labelled documents: their language."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")


def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rated = source_mixing.rates(docs, language_labels(docs, table(spark, folder, "labels")), MIX_TARGETS)
    each = [F.col("p")[k].alias(f"p_{name}") for k, name in enumerate(MIX_TARGETS)]
    return rated.select("doc_id", "n_words", *each, "rate", source_mixing.copies(F.col("rate"), F.col("doc_id")).cast("long").alias("copies"))


def op5_repetition_rules(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, folder, "documents"))


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, rest = table(spark, folder, "documents"), quality_model.crc_rest(3)
    model = quality_model.fit(docs, table(spark, folder, "labels"), usable=rest != 1)
    scored = quality_model.score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select(
        "doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).drop("text")


def op8_template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("tie")


def op9_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return kneser_ney.score_documents(table(spark, folder, "documents"), train=quality_model.crc_rest(10) != 0)


def op10_repeated_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_automata.remove_repeats(table(spark, folder, "documents"), with_text=False).drop("kept_text")


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_norm_search(spark: SparkSession, folder: str) -> DataFrame:
    return norm_search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_html_text": op2_html_text,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_source_mixing": op4_source_mixing,
    "op5_repetition_rules": op5_repetition_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_toxicity": op7_toxicity,
    "op8_template_decontamination": op8_template_decontamination,
    "op9_lm_scores": op9_lm_scores,
    "op10_repeated_phrases": op10_repeated_phrases,
    "op11_filter_audit": op11_filter_audit,
    "op12_norm_search": op12_norm_search,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL: dict[str, str] = {
    "op3_jaccard_join": oracle.jaccard_components(jaccard_join.SHINGLE, jaccard_join.PERCENT),
    "op5_repetition_rules": oracle.repetition(repetition.NGRAM_LIMITS, repetition.LINE_LIMIT),
    "op10_repeated_phrases": oracle.repeated_phrases(phrase_automata.WINDOW),
    "op11_filter_audit": oracle.filter_audit(),
    "op12_norm_search": oracle.norm_search(50, 5),
    "op13_hard_negatives": oracle.hard_negatives(100, 5, 5),
}
