"""The pipeline and the registered queries of the folder."""

import importlib

import pytest
from check_oracle import connect, difference
from conftest import SMALL

import corpus_pipeline
from redline.llm import decontaminate, queries, token_output


def test_stages_keep_documents_columns(spark):
    docs = queries.table(spark, SMALL, "documents")
    names, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.store(stage(spark, docs, SMALL), f"test-{name}")
        assert docs.columns == names
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert before is None or ids <= before
        before = ids
        if name == "decontamination":
            assert decontaminate.leaks(docs, queries.table(spark, SMALL, "benchmark")).count() == 0
        if name == "quality_classifier":
            labels = {r.doc_id: r.quality for r in queries.table(spark, SMALL, "labels").collect()}
            kept = [y for d, y in labels.items() if d in ids]
            assert sum(kept) >= 0.97 * sum(labels.values()) and kept.count(0) <= 0.4 * list(labels.values()).count(0)
        if name == "jaccard_join":
            texts = [frozenset(zip(*[(r.text or "").lower().split()[i:] for i in range(5)])) for r in docs.collect()]
            close = sum(1 for i, a in enumerate(texts) for b in texts[:i] if a and b and len(a & b) >= 0.8 * len(a | b))
            assert close == 0
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).orderBy("start").collect()
    encoder = token_output.PieceEncoder(queries.tokenizer_path())
    assert len(got) == docs.count()
    assert sum(r.n_tokens for r in got) == sum(len(encoder.whole(r.text or "")) // 4 + 1 for r in docs.select("text").collect())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_covers_its_table_and_fits_its_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    if name.startswith(("op8_", "op12_", "op13_")):
        assert len(got) > 0
    elif name.startswith("op11_"):
        assert len(got) == 600 * queries.table(spark, SMALL, "documents").select("lang").distinct().count()
    else:
        source = "pages" if name.startswith("op2_") else "documents"
        assert len(got) == queries.table(spark, SMALL, source).count()
    if name in queries.SQL:
        assert difference(got, connect(SMALL).execute(queries.SQL[name]).df()) is None


def test_each_operator_is_registered():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()}
    assert "pipeline" in names
