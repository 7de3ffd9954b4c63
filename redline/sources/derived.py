"""Tables derived from the stored corpus, lazily and once per instance."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redline import vocab as V
from redline.operators import match, review, structure, terms, triage
from redline.session import store
from redline.sources import paragraphs as scan

AS_OF = "2024-02-01 00:00:00"
STATUSES = ["uploaded"] + [s[0] for s in V.STAGES] + ["completed", "failed"]


class Corpus:
    """The stored tables of one folder and what is derived from them.

    ``deal``: on one machine, a table of a single file is one split; this deals the rows of the text tables to so many
    partitions. By default text is never shuffled before it is split up.
    """

    def __init__(self, spark: SparkSession, path: str, deal: int | None = None):
        self.spark, self.path, self.deal = spark, path, deal

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.deal) if self.deal else df

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self._dealt(self.table("documents"))

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def paragraphs(self) -> DataFrame:
        return scan.from_documents(self.documents)

    @cached_property
    def html(self) -> DataFrame:
        return scan.from_html(self._dealt(self.table("pages")))

    @cached_property
    def turns(self) -> DataFrame:
        return scan.from_turns(self.table("conversations"))

    @cached_property
    def typed(self) -> DataFrame:
        return triage.typed(self.paragraphs)

    @cached_property
    def sectioned(self) -> DataFrame:
        columns = ["doc_id", "paragraph_index", "text", "location", "style_name"]
        return structure.with_sections(self.paragraphs.select(*columns))

    @cached_property
    def protected(self) -> DataFrame:
        """Protected terms of each document: those of its preset and its key word, read from the document row."""
        rows = self.documents.select("doc_id", "source", F.regexp_extract("text", "[A-Za-z]{6,}", 0).alias("key_word"))
        return triage.with_profile(rows).select("doc_id", "protected_terms")

    @cached_property
    def terms(self) -> DataFrame:
        return terms.terms(self.paragraphs, self.protected)

    @cached_property
    def prepared(self) -> DataFrame:
        return triage.prepared(self.documents)

    @cached_property
    def proposals(self) -> DataFrame:
        """Decisions with the native similarity and unrounded values, as SQL engines can check them."""
        return triage.proposed(self.prepared, "jaccard", False, stress=True)

    def keep_proposals(self, columns: list[str] | None = None) -> None:
        """Store the proposals once, for plans that read patches or usage in several branches: all columns, or those named."""
        self.__dict__["proposals"] = store(self.proposals.select(*columns) if columns else self.proposals, "proposals")

    def keep_patches(self, columns: list[str]) -> None:
        """Store these columns of the patches once, for plans that read nothing else of the chain."""
        self.__dict__["patches"] = store(self.patches.select(*columns), "patches")

    def keep_changes(self) -> None:
        """Store the changed proposals once, for plans that read nothing but patches of the chain, in several branches. Patches
        are made where they are read: each repeats its paragraph's texts, so stored ones would hold them once for every change."""
        changed = self.proposals.filter("changed").select(*triage.PATCH)
        self.__dict__["patches"] = triage.patches(store(changed, "changes"))

    @cached_property
    def patches(self) -> DataFrame:
        return triage.patches(self.proposals)

    @cached_property
    def usage(self) -> DataFrame:
        return triage.usage(self.proposals)

    @cached_property
    def audit(self) -> DataFrame:
        return triage.audit_log(self.usage)

    @cached_property
    def blocks(self) -> DataFrame:
        return match.blocks(self.paragraphs)

    @cached_property
    def decisions(self) -> DataFrame:
        """Events as review decisions on the first change of an early paragraph of some document."""
        doc = F.col("event_id") % self.table("documents").agg(F.count("*")).scalar()
        action = (
            F.when(F.col("event_type") == "click", "accepted").when(F.col("event_type") == "error", "rejected")
            .when(F.col("event_type") == "purchase", "edit").when(F.col("event_type") == "signup", "recorrect").otherwise("note")
        )
        return self.events.withColumn("doc_id", doc).select(
            "event_id", "ts", "doc_id",
            F.concat_ws("-", "doc_id", F.col("user_id") % 5, F.lit(0)).alias("patch_id"), action.alias("action"), "user_id",
        )

    @cached_property
    def edits(self) -> DataFrame:
        """Manual edits: the corrected text repeated ``event_id % 4`` times, so some are empty or too long."""
        asked = self.decisions.filter("action = 'edit'").select("event_id", "ts", "patch_id")
        known = self.patches.select("patch_id", "doc_id", "paragraph_index")
        text = review.paragraph_texts(self.patches).select("doc_id", "paragraph_index", "corrected_text")
        return asked.join(known, "patch_id").join(text, ["doc_id", "paragraph_index"]).select(
            "event_id", "ts", "patch_id", "doc_id", F.expr("repeat(corrected_text, cast(event_id % 4 as int))").alias("edited_text"),
        )

    @cached_property
    def doc_status(self) -> DataFrame:
        """State and progress per document, by its id; times are relative to a fixed moment."""
        doc = F.col("doc_id")
        total = F.size(F.split("text", "\n", -1))
        base = F.lit(AS_OF).cast("timestamp")

        def back(seconds: Column) -> Column:
            return F.timestamp_seconds(F.unix_timestamp(base) - seconds)

        return self.documents.select(
            "doc_id", "source", F.get(F.array(*[F.lit(s) for s in STATUSES]), (doc % 12).cast("int")).alias("status"),
            total.alias("stage_total"), (doc % (total + 1)).cast("int").alias("stage_current"),
            match.page_count(total).alias("total_pages"), base.alias("as_of"),
            back(doc % 300).alias("heartbeat_at"), back(doc % 3600 + 60).alias("stage_started_at"),
            back(doc * 60).alias("created_at"),
        )

    @cached_property
    def layout_pages(self) -> DataFrame:
        """Pages of each document with a status by page number."""
        page = F.explode(F.sequence(F.lit(1), F.col("total_pages")))
        return self.doc_status.select("doc_id", page.alias("page_no")).withColumn(
            "status", F.when((F.col("doc_id") + F.col("page_no")) % 9 == 0, "failed").otherwise("corrected")
        )

    @cached_property
    def batches(self) -> DataFrame:
        return store(structure.batch_boundaries(self.sectioned, 20), "batches")

    @cached_property
    def cells(self) -> DataFrame:
        """Customers as table cells: one table per nation, a header row, one row per customer."""
        rows = self.table("customer").select(
            F.col("c_nationkey").cast("long").alias("doc_id"), F.col("c_custkey").alias("_r"),
            F.array("c_name", "c_mktsegment", F.col("c_custkey").cast("string")).alias("_v"),
        )
        header = rows.select("doc_id").distinct().select(
            "doc_id", F.lit(-1).cast("long").alias("_r"),
            F.array(F.lit("name"), F.lit("segment"), F.lit("key")).alias("_v"),
        )
        return header.unionByName(rows).select("doc_id", "_r", F.posexplode("_v").alias("_c", "text")).select(
            "doc_id", "text", F.concat_ws(":", F.lit("table"), F.lit(0), F.col("_r") + 1, "_c", F.lit(0)).alias("location"),
        )
