"""Batches of the pipeline's token stage: whole texts went to Python workers 10,000 at a time."""

import corpus_pipeline


def test_token_files_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        for before, after in (("10000", "1024"), ("0", "1024"), ("7", "7")):
            spark.conf.set(key, before)
            docs = spark.createDataFrame([(i, f"text {i} of some words\n" * (i % 3)) for i in range(40)], "doc_id long, text string")
            got = corpus_pipeline.token_files(spark, docs, None).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()
            assert spark.conf.get(key) == after
            assert [r["doc_id"] for r in got] == list(range(40)) and got[0]["start"] == 0
            assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    finally:
        spark.conf.unset(key)
