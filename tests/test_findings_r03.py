"""Cases of the third round's findings."""

import contextlib
import time

import numpy as np
import pyarrow as pa
from check_oracle import connect, difference
from conftest import SMALL
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from redline import vocab as V
from redline.functions import protect, text
from redline.llm import block_exchange, kneser_ney
from redline.operators import terms
from redline.streaming import jobs


def folder_of(spark, tmp_path, **tables):
    """A folder with these rows of documents (or another table) in the small tables' schema."""
    for name, rows in tables.items():
        schema = spark.read.parquet(f"{SMALL}/{name}.parquet").schema
        spark.createDataFrame(rows, schema).toPandas().to_parquet(f"{tmp_path}/{name}.parquet", coerce_timestamps="us")
    return str(tmp_path)


def against_sql(spark, folder, name):
    got = queries()[name](spark, folder).toPandas()
    assert difference(got, connect(folder).execute(oracle_sql()[name]).df()) is None
    return got


def document(doc_id, text):
    return (doc_id, text, "en", "src1", len(text))


def test_boundary_check_no_seed_from_unusable_paragraph(spark, tmp_path):
    """The paragraph before a head is too short to use: no approximate seed."""
    lines = [f"Paragraph number {i} is long enough to be no heading at all." for i in range(19)]
    whole = "\n".join([*lines, "ab", "A short heading", *lines])
    got = against_sql(spark, folder_of(spark, tmp_path, documents=[document(1, whole)]), "boundary_check")
    assert got["approx_seed"].tolist() == [""] and got["real_seed"].tolist() == [lines[-1]]


def test_lexicon_fix_whole_chain(spark, tmp_path):
    line = "hola, lo facil y lo dificil tambien esta en el parrafo  teh end!! ###"
    got = against_sql(spark, folder_of(spark, tmp_path, documents=[document(1, line)]), "lexicon_fix")
    assert got["fixed"].tolist() == ["Hola, lo fácil y lo difícil también está en el párrafo the end! "]


def test_first_hit_fix_whole_list(spark, tmp_path):
    rows = [document(1, "A veces sale por que no, dijo el jefe"), document(2, "one of the two to the left"), document(3, "no es por que no")]
    got = against_sql(spark, folder_of(spark, tmp_path, documents=rows), "first_hit_fix")
    assert sorted(got["fixed"]) == ["En ocasiones sale por que no, dijo el jefe", "no es porque no", "one of two to the left"]


def test_request_rate_over_batches(spark, tmp_path):
    """Hours that reach over micro-batches are reported once and whole; what is kept is one row for each document and five
    minutes, where it was one for each of twelve hours."""
    rows = spark.read.parquet(f"{SMALL}/events.parquet")
    step = rows.agg((F.max("event_id") / 5 + 1).cast("long")).first()[0]
    for i in range(5):
        rows.filter((F.col("event_id") >= i * step) & (F.col("event_id") < (i + 1) * step)).coalesce(1).write.parquet(f"{tmp_path}/p{i}")
    stream = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    requests = stream.select(F.col("user_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))
    folder = jobs.new_folder(spark, "rate")
    got = jobs.request_rate(requests, folder, 1).toPandas()
    want = connect(SMALL).execute(oracle_sql()["stream_rate"]).df()
    assert len(got) and difference(got, want) is None
    kept = spark.read.parquet(f"{folder}/counts/v0")
    assert kept.count() == kept.select("doc_id", "slot").distinct().count() <= step


def test_strip_is_linear_in_inner_space(spark):
    """A long run of white space inside a text: the pattern looked for the text's end from each of its characters."""
    rows = spark.createDataFrame([("  x" + " " * 300_000 + "y　\n",), (" \x1f ",), ("",), (None,)], "t string")
    started = time.monotonic()
    got = [r[0] for r in rows.select(text.strip(F.col("t"))).collect()]
    assert got == ["x" + " " * 300_000 + "y", "", "", None] and time.monotonic() - started < 20


def test_strip_and_syllables_as_the_patterns_say(spark):
    odd = ["  teh ", "Été rhythm, brr 123 _ y", "İstanbul İx", "x\u0085", "a​ ", "nth\tAEIOU pfff\n"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    mute = rf"(?<![\p{{L}}\p{{N}}_])[\p{{L}}\p{{N}}_&&[^{V.VOWEL_RUN[1:-2]}]]+(?![\p{{L}}\p{{N}}_])"
    low = F.lower("t")
    syllables = F.regexp_count(low, F.lit(V.VOWEL_RUN)) + F.regexp_count(low, F.lit(mute))
    for r in rows.select(text.strip(F.col("t")), F.regexp_replace("t", V.STRIP, ""), text.syllable_count(F.col("t")), syllables).collect():
        assert r[0] == r[1] and r[2] == r[3]


def test_region_hints_lose_nothing(spark):
    odd = ["x isbn-13: 978-3 16 148410 0", "DOI: 10.1234/ab", "doi 10.1000.10/x", "Http://a", "(García y López, 1999)", "[1, 22]", "el 3 De enero de 1999", "Visto con María Pérez ayer", "a. María Pérez"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    for reason, pattern in [*V.REGION_PATTERNS, ("proper_name", V.PROPER_NAME)]:
        hits = rows.filter(F.col("t").rlike(pattern))
        assert hits.count() > 0 and hits.filter(~protect.HINTS[reason](F.col("t"))).count() == 0, reason


def test_terms_shuffle_texts_not_ngrams(spark, corpus):
    """Between the texts' shuffle and the counts of their n-grams there is none."""
    plan = terms.candidate_terms(corpus.paragraphs, min_words=0)._jdf.queryExecution().executedPlan().toString()
    counting = plan[plan.index("Window"):] if "Window" in plan else plan
    above = counting[:counting.index("REPARTITION_BY_NUM")]
    assert "ENSURE_REQUIREMENTS" not in above, above


def test_pair_questions_travel_as_bytes():
    """A training count of a pair is one byte of a question, unless it is large."""
    counts = np.array([0, 1, 254, 255, 70_000])
    values = np.arange(5, dtype=np.uint64)
    asked = block_exchange.questions(0, values, 1, 5, counts[None, :])
    assert len(asked.column("extra")[0].as_py()) == 5 + 2 * 8
    assert block_exchange.Asked(asked, 1).extra[0].tolist() == counts.tolist()


def test_language_model_sends_pair_counts_packed(spark, monkeypatch):
    asked = []
    ask = block_exchange.questions
    monkeypatch.setattr(block_exchange, "questions", lambda *args: asked.append(args) or ask(*args))
    docs = spark.createDataFrame([(1, "a b a b c")], "doc_id long, text string")
    captured = {}
    monkeypatch.setattr(type(docs.groupBy("doc_id")), "applyInArrow", lambda self, fn, schema: captured.setdefault(fn.__name__, fn) and docs)
    with contextlib.suppress(Exception):
        kneser_ney.score_documents(docs, F.lit(True))
    table = pa.table({"doc_id": [1], "text": ["a b a b c"], "train": [True]})
    captured["ask_pairs"]([pa.scalar(0)], table)
    assert asked[0][4].ndim == 2
