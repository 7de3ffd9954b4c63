"""The corpus pipeline: documents to token files, in five stages. Each stage's result is written as Parquet and read again
as the documents of the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redline.llm import decontaminate, jaccard_join, quality_model, source_mixing, token_output
from redline.llm.queries import MIX_TARGETS, language_labels, table, tokenizer_path
from redline.session import store

#: Near-duplicates: word shingles of this length, sharing this percentage of their union or more.
SHINGLE, PERCENT = 5, 80
#: Pieces that a token encoder keeps, for its task only: workers share an executor with what four stages have left there.
PIECES_KEPT = 1 << 16
#: Documents that go to a Python worker at a time: both sides of the pipe hold a batch, the usual one 10,000 whole texts.
ROWS_A_BATCH = 1024


def small_batches(spark: SparkSession) -> None:
    """From here on: no batch of more rows than ROWS_A_BATCH."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key))
    spark.conf.set(key, str(min(rows, ROWS_A_BATCH) if rows > 0 else ROWS_A_BATCH))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among docs, doesn't reject (score 1/2 or more)."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    named = docs.columns
    kept = quality_model.score(docs.withColumnRenamed("score", "_own_score"), model).where("score >= 0.5").drop("score")
    return kept.withColumnRenamed("_own_score", "score").select(named)


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return jaccard_join.one_of_each(docs, shingle=SHINGLE, percent=PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the fitted rates say."""
    return source_mixing.mixed(docs, language_labels(docs, table(spark, sf_dir, "labels")), MIX_TARGETS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder; what comes back are the documents as read from them."""
    small_batches(spark)
    return token_output.read_documents(store(token_output.encode_documents(docs, tokenizer_path(), pieces_kept=PIECES_KEPT, keep_encoder=False), "token-segments"))


STAGES = [
    ("quality_classifier", good_quality),
    ("jaccard_join", first_of_near_copies),
    ("decontamination", without_benchmark),
    ("source_mixing", mixed_to_targets),
    ("token_output", token_files),
]
ORACLE_SQL = None  # trained models, tokenizer: SQL can't express them; tests check each stage's rows by plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
