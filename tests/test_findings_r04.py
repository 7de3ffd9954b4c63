"""Cases of the fourth round's findings on disk: how often a text travels, what is stored, and that it is still the whole job."""

import random

import pytest
from pyspark.sql import functions as F

from redline.operators import corrector, match, review
from redline.plans import queries
from redline.plans.queries import REGISTRY
from redline.sources import derived
from redline.sources.derived import Corpus


def dealt(df):
    """Names of the columns that each exchange of a plan sends; one that is read again counts once."""
    spark, found = df.sparkSession, []
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    nodes = [df.select("*")._jdf.queryExecution().executedPlan()]
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Exchange":
            found.append({node.output().apply(i).name() for i in range(node.output().size())})
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_a_paragraphs_texts_are_stored_once(spark, corpus):
    """a patch row repeats its paragraph's texts for every change; the rows that get stored, and sent, don't."""
    own = Corpus(spark, corpus.path)
    own.keep_changes()
    kept = spark.read.parquet(own.patches.inputFiles()[0].rsplit("/", 1)[0])
    assert kept.count() == corpus.proposals.filter("changed").count() == review.paragraph_texts(own.patches).count() < own.patches.count()
    assert own.patches.exceptAll(corpus.patches).count() == 0 == corpus.patches.exceptAll(own.patches).count()
    same = own.patches.groupBy("doc_id", "paragraph_index").agg(F.count_distinct("original_text", "corrected_text", "location").alias("n"))
    assert same.filter("n <> 1").count() == 0


@pytest.fixture
def by_shuffle(spark, monkeypatch):
    """Small tables are dealt here as large ones are; gives the columns of the tables that get stored."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    kept, plain = [], derived.store
    monkeypatch.setattr(derived, "store", lambda df, what: kept.append(set(df.columns)) or plain(df, what))
    yield kept
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_locate_deals_each_text_once(spark, corpus, by_shuffle):
    """all columns of the proposals were stored, and paragraphs, patches and pages were dealt anew for each step and use."""
    sent = dealt(REGISTRY["locate_on_page"][0](Corpus(spark, corpus.path)))
    assert by_shuffle and not {"text", "candidate", "pass0_text", "gates"} & by_shuffle[0]
    assert sum("text" in names for names in sent) == 1 and not any({"page_text", "_book"} & names for names in sent)
    assert not any({"original_text", "block_text", "_words"} & names for names in sent)
    assert {"patch_id", "corrected_text"} not in [names & {"patch_id", "corrected_text"} for names in sent]


@pytest.mark.parametrize("gap", [False, True])
def test_equal_texts_are_located_each_from_its_own_page(spark, gap):
    """Equal texts are looked for once; near and far, and prefixes found on a near and a farther page, stay apart."""
    line = "Una misma frase que se repite por todo el documento, palabra por palabra, hasta el final " * 2
    pages = [(1, p, f"página {p}\n" + (line if p in (3, 9) else line[:40] if p == 6 else "nada")) for p in range(1, 13) if not (gap and p in (1, 5, 10))]
    changes = [(1, i, "otro", line, 120) for i in (0, 25, 60, 85, 110)] + [(1, 119, "otro", "no está en ninguna página", 120), (1, 70, "otro", "nada", 120)]
    got = match.locate_on_pages(
        spark.createDataFrame(changes, "doc_id long, paragraph_index int, original_text string, corrected_text string, n_paragraphs int"),
        spark.createDataFrame(pages, "doc_id long, page_no int, page_text string"),
    ).collect()
    mine = {r.paragraph_index: (r.page_no, r.matched_length, r.is_near) for r in got}
    assert mine == {
        0: (3, 150, True), 25: (3, 150, True), 60: (9, 150, True), 85: (9, 150, True), 110: (3, 150, False), 119: (None, None, None), 70: (7, 4, True),
    }


def test_render_deals_each_text_once(spark, corpus, by_shuffle):
    """texts were dealt by patch for decisions, edits and their state, by paragraph, by place, by block and by document."""
    sent = dealt(REGISTRY["final_render"][0](Corpus(spark, corpus.path)))
    assert by_shuffle and not {"text", "candidate", "pass0_text", "gates"} & by_shuffle[0]
    assert sum("text" in names for names in sent) == 1 and sum("corrected_text" in names for names in sent) == 1
    assert not any("original_text" in names or {"patch_id", "corrected_text"} <= names for names in sent)


PATCH = "patch_id string, doc_id long, paragraph_index int, position int, location string, original_text string, corrected_text string, edited_text string, review_status string"


@pytest.mark.parametrize("apart", [False, True])
def test_text_of_the_first_chosen_patch_is_applied(spark, apart):
    rng = random.Random(7)
    lines = [(d, i, rng.choice(["uno", " dos ", "tres", ""]), f"body:{i}") for d in (1, 2) for i in range(30)]
    paras = spark.createDataFrame(lines, "doc_id long, paragraph_index int, text string, location string")
    rows = []
    for d, i, text, where in lines + [(1, 99, "x", "body:99"), (3, 0, "uno", "body:0")]:
        for p in range(rng.randint(0, 3)):
            if p == 0 or not apart:
                texts = rng.choice([text.strip(), text.strip(), "otro", None]), rng.choice(["nuevo", "", None])
            rows.append((f"{d}-{i}-{p}", d, i, p, where, *texts, rng.choice(["", None, "a mano"]), rng.choice(["accepted", "rejected"])))
    patches = spark.createDataFrame(rows, PATCH)
    chosen = patches.filter("review_status = 'accepted'")
    got = review.apply_to_text(paras, chosen.drop("original_text", "corrected_text"), review.paragraph_texts(patches)) if apart else review.apply_to_text(paras, chosen)
    mine = {(r.doc_id, r.paragraph_index): (r.text, r.applied, r.stale) for r in got.collect()}
    want = {}
    for d, i, text, where in lines:
        first = min((r for r in rows if r[1] == d and r[4] == where and r[8] == "accepted"), key=lambda r: r[3], default=None)
        fits = first is not None and first[5] is not None and first[5] == text.strip()
        want[d, i] = ((first[7] or first[6]) if fits else text, fits, first is not None and first[5] is not None and not fits)
    assert mine == want


def test_edits_and_decisions_of_many_events(spark):
    """The latest of each kind stands for all: order by time, then event; what isn't a verdict or not under review doesn't count."""
    rng = random.Random(3)
    state = spark.createDataFrame([(1, "pending_review"), (2, "uploaded")], "doc_id long, status string")
    patches = spark.createDataFrame([(f"{d}-0-{p}", d, "uno", "dos", "pending") for d in (1, 2) for p in range(4)], "patch_id string, doc_id long, original_text string, corrected_text string, review_status string")
    events = [(e, f"2024-01-0{rng.randint(1, 4)}", d, f"{d}-0-{rng.randint(0, 5)}", rng.choice(["accepted", "rejected", "note"])) for e in range(200) for d in (1, 2)]
    decisions = spark.createDataFrame(events, "event_id long, ts string, doc_id long, patch_id string, action string")
    got = {r.patch_id: (r.review_status, r.reviewed_at) for r in review.apply_decisions(patches, decisions, state).collect()}
    for p in range(4):
        last = max((t, e, a) for e, t, d, patch, a in events if patch == f"1-0-{p}" and a != "note")
        assert got[f"1-0-{p}"] == (last[2], last[0]) and got[f"2-0-{p}"] == ("pending", None)
    edits = spark.createDataFrame([(1, "t", "1-0-0", 1, "x" * 106), (2, "t", "1-0-1", 1, "x" * 107), (3, "t", "2-0-1", 2, "x"), (4, "t", "1-0-9", 1, "x"), (5, "t", "1-0-2", 1, "")], "event_id long, ts string, patch_id string, doc_id long, edited_text string")
    assert {r.event_id: r.verdict for r in review.manual_edits(patches, edits, state).collect()} == {1: "accepted", 2: "too_long", 3: "bad_state", 5: "bad_length"}


def test_batches_deal_each_text_once(spark, corpus, by_shuffle, monkeypatch):
    """the first pass was stored and dealt anew for starts, sums, batches, seeds and heads, and all that a batch made was stored."""
    kept, plain = {}, queries.store
    monkeypatch.setattr(queries, "store", lambda df, what: kept.setdefault(what, plain(df, what)))
    sent = dealt(corrector.correct_batches(queries._pass0(corpus), corpus.batches, corrector.stock_corrector))
    assert sum("pass0_text" in names for names in sent) == 1
    REGISTRY["assembled_patches"][0](corpus)
    rows, heads = kept["corrected"], kept["corrected"].filter("head_text is not null")
    assert set(kept) == {"corrected"} and rows.count() < corpus.paragraphs.filter("length(trim(text)) >= 3").count()
    assert rows.filter("head_text is null and context is not null").count() == 0
    assert heads.count() == rows.filter("is_tail").count() == heads.select("doc_id", "batch_index").distinct().count()


def assembled_by_hand(given, texts, cuts, run):
    """Batches from approximate seeds, then heads again until each has seen the last text before it, all at once each time."""
    batches = []
    for k, (a, b) in enumerate(cuts):
        before = [i for i in range(max(0, a - 5), a) if len(texts[i]) >= 3]
        seed = previous = (given[before[-1]][:200] or None) if k and before else None
        made = {}
        for i in range(a, b + 1):
            if len(texts[i]) >= 3:
                made[i] = previous = run(given[i], previous)
        if made:
            batches.append([seed or "", made, dict(made)])
    while True:
        wrong = [(x, list(y[2].values())[-1][:200]) for y, x in zip(batches, batches[1:]) if list(y[2].values())[-1][:200] != x[0]]
        if not wrong:
            break
        for x, real in wrong:
            x[0], x[2][min(x[2])] = real, run(given[min(x[2])], real)
    want = []
    for _, old, new in batches:
        for i in old:
            if new[i] != texts[i]:
                want.append((i, new[i], "keep" if new[i] == old[i] else "add" if old[i] == texts[i] else "replace"))
    return [(n, *w) for n, w in enumerate(sorted(want))]


@pytest.mark.parametrize("block,records", [(4096, 10000), (8, 3)])
def test_batches_and_heads_like_by_hand(spark, monkeypatch, block, records):
    """Documents of one batch, of many, of single texts; the long ones dealt by batch; and several Arrow batches a task."""
    monkeypatch.setattr(corrector, "BLOCK", block)
    rng, rows, cut_rows, docs = random.Random(11), [], [], {}
    for doc in range(12):
        n = rng.choice([1, 3, 7, 20, 40])
        texts = [rng.choice(["uno dos", "", "x", "tres, cuatro", "largo " * 50]) for _ in range(n)]
        given = [t if rng.random() < 0.7 else rng.choice(["", t + "!"]) for t in texts]
        ends = sorted({n - 1, *rng.sample(range(n), rng.randint(0, n // 2))})
        cuts = list(zip([0, *(e + 1 for e in ends)], ends))
        docs[doc] = given, texts, cuts
        rows += [(doc, i, t, g) for i, (t, g) in enumerate(zip(texts, given))]
        cut_rows += [(doc, k, a, b) for k, (a, b) in enumerate(cuts)]
    pass0 = spark.createDataFrame(rows, "doc_id long, paragraph_index int, stripped string, pass0_text string")
    batches = spark.createDataFrame(cut_rows, "doc_id long, batch_index int, start_paragraph int, end_paragraph int")

    def run(text, before):
        return f"{text}<{(before or '')[:8]}>" if len(text) % 3 and before else text

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    made = corrector.correct_batches(pass0, batches, run)
    for corrected in (made, corrector.to_assemble(made)):
        got = corrector.assembled_patches(corrected, corrector.repaired_heads(corrected, pass0, run)).collect()
        for doc in docs:
            assert [(r.patch_no, r.paragraph_index, r.corrected_text, r.action) for r in got if r.doc_id == doc] == assembled_by_hand(*docs[doc], run)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
