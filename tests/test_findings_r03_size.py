"""Cases of the third round's findings on figures at 6 GB: what is worked out once, and what grows with the text."""

import re

import pytest
from pyspark.sql import functions as F

from redline import vocab as V
from redline.functions import edits, protect, text
from redline.operators import terms

SPACE = "".join(chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def test_chain_lowers_no_text_for_each_pattern_or_term(corpus):
    """Captions and protected terms: a paragraph was lower-cased whole for each pattern, each term and each use of a gate."""
    plan = corpus.proposals._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"(?<!THEN )RLIKE\(lower\(stripped#", plan)
    assert not re.search(r"Contains\(lower\((stripped|candidate)#", plan)
    assert "[!][!]|" not in "".join(re.findall(r"RLIKE\([^)]*\)", plan))


@pytest.mark.parametrize("name", ["tokens", "captions", "rules", "isbn"])
def test_short_cuts_lose_nothing(spark, name):
    odd = [f"a{c}b {c}" for c in map(chr, [*range(1, 0x250), *range(0x2000, 0x2070), 0x3000, 0xFEFF])] + ["", SPACE, "a" + SPACE + "ñ"]
    odd += ["Fig. 3: x", "FIGURA 12 - x", "Gráfico 1.", "GRÁFICO 1.", "fuente: x", "Elaboración propia. x", "İmagen 1.", "mapas 1.", "Notas", "NOTA -", None]
    odd += ["no!!yes", "a teh b", "x $$$y&&&", " .", "adn  ", "***%%%###", "iSbN", "isBN 9", "ISbn", "isb n"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    t = F.col("t")
    short, plain = {
        "tokens": (text.tokens(t), F.filter(F.split(t, f"{V.WS}+", -1), lambda w: w != "")),
        "captions": (
            text.classify(t, F.lit("body:0"), F.lit(None).cast("string"), F.lit(False)) == "pie_imagen",
            (t != "") & ~t.rlike(V.DIALOGUE) & ~t.rlike(V.LIST_ITEM) & (F.lower(t).rlike(V.CAPTION_NUMBERED) | F.lower(t).rlike(V.CAPTION_ATTRIBUTION)),
        ),
        "rules": (edits.found_edits(t)["original"], F.regexp_extract_all(t, F.lit(edits.any_of(V.EDIT_RULES)), 0)),
        "isbn": (protect.HINTS["isbn"](t) | ~F.contains(F.lower(t), F.lit("isbn")), t.isNotNull() | F.lit(None)),
    }[name]
    for row in rows.select("t", short.alias("short"), plain.alias("plain")).collect():
        assert (row["short"] or None) == (row["plain"] or None), row


def test_ngrams_of_odd_texts(spark):
    lines = ["«Alpha, beta. (gamma) delta's", "ΑΣ ΟΔΟΣ. ΣΑΣ", " a  b c d ", "one", ". . .,", "İSTANBUL UP Été", ""]
    rows = spark.createDataFrame(list(enumerate(lines)), "paragraph_index int, text string").withColumn("doc_id", F.lit(1).cast("long"))
    words = text.tokens(text.strip(F.col("text")))
    split = {r[0]: r[1] for r in rows.select("paragraph_index", words).collect()}
    want = [(p, n, i + 1, " ".join(w[i:i + n]).strip(V.TERM_EDGE_CHARS)) for p, w in split.items() for n in (2, 3) for i in range(len(w) - n + 1)]
    low = spark.createDataFrame(want, "p int, n int, pos int, term string").withColumn("term", F.lower("term")).filter(F.length("term") >= 5)
    assert sorted(terms.ngrams(rows).select("paragraph_index", "n", "pos", "term").collect()) == sorted(low.collect())


def test_partitions_of_texts_grow_with_the_text(corpus, monkeypatch):
    """Their number was the same for any text, so that a task's counts of n-grams grew with it."""
    usual = terms.by_document(corpus.paragraphs).rdd.getNumPartitions()
    monkeypatch.setattr(terms, "PART_CHARACTERS", 1000, raising=False)
    characters = corpus.paragraphs.agg(F.sum(F.length("text"))).first()[0]
    assert usual < terms.by_document(corpus.paragraphs).rdd.getNumPartitions() == characters // 1000


def test_enough_text_from_beginnings(spark):
    """Body words are counted in a text's beginning where that holds enough of them; it was cut into words whole."""
    texts = ["a " * 19, "a " * 20, "x" * 500 + " b" * 19, "x" * 500 + " b" * 18, "y " * 5000]
    rows = spark.createDataFrame([(i, f"body:{i}", t) for i, t in enumerate(texts)], "doc_id long, location string, text string")
    found = terms.enough_text(rows, 20)
    assert sorted(r[0] for r in found.collect()) == [1, 2, 4]
    assert "substring(text" in found._jdf.queryExecution().optimizedPlan().toString()
