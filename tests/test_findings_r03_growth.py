"""Cases of the third round's findings on growth: what is worked out once a document, and what is written."""

import re

import pytest
from pyspark.sql import functions as F

from redline.plans.queries import REGISTRY
from redline.sources import paragraphs as scan
from redline.sources.derived import Corpus


def test_scan_works_out_a_document_once(spark):
    """F15 to F17, F8: the search for inner headings ran again, and the whole text was copied, for each line of a document."""
    docs = spark.createDataFrame([(1, "Title\nSome longer line of text, over thirty characters\nshort\n"), (2, "one"), (3, "")], "doc_id long, text string")
    rows = scan.from_documents(docs)
    above, below = rows._jdf.queryExecution().optimizedPlan().toString().split("Generate inline")
    assert "exists(" in below and "exists(" not in above and "_lines" not in above
    assert not re.search(r"\[[^\]]*_lines", below.splitlines()[0].rsplit(", [", 1)[1])  # what the generator gives on
    got = [tuple(r) for r in rows.orderBy("doc_id", "paragraph_index").select("doc_id", "paragraph_index", "n_paragraphs", "has_sections", "next_style").collect()]
    assert got == [
        (1, 0, 4, True, None), (1, 1, 4, True, "Heading 2"), (1, 2, 4, True, None), (1, 3, 4, True, None), (2, 0, 1, False, None), (3, 0, 1, False, None),
    ]


@pytest.mark.parametrize("name,left_out", [("apply_modes", {"corrected_text", "final_text", "stripped", "gates"}), ("point_lookup", {"text", "candidate", "gates"})])
def test_stored_tables_hold_what_is_read(spark, corpus, monkeypatch, name, left_out):
    """F15, F16: every column of the proposals was written, the paragraph's text five times over."""
    from redline.sources import derived

    kept, plain = [], derived.store
    monkeypatch.setattr(derived, "store", lambda df, what: kept.append(set(df.columns)) or plain(df, what))
    rows = REGISTRY[name][0](Corpus(spark, corpus.path))
    assert kept and not left_out & kept[0]
    assert rows.count() > 0
