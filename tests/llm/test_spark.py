"""The operators as Spark jobs on small awkward tables, against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from redline.llm import components, decontaminate, jaccard_join, kneser_ney, phrase_automata, quality_model, repetition, source_mixing, token_output, toxicity
from redline.llm.html_render import render_pages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, block int, tie long, cls long"


def documents(spark, rows):
    """Documents with more columns, some named as the operators' own."""
    return spark.createDataFrame([(d, t, "en", "src0", len(t or ""), 0.5, 7, 1, 2) for d, t in rows], SCHEMA)


def corpus_rows(seed=1, n=60):
    draw = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("th", "er", "on", "an", "re", "ti") for b in ("a", "e", "st", "ing", "ed", "ou")]
    base = [" ".join(draw.choice(vocab) for _ in range(draw.randrange(5, 120))) for _ in range(n // 3)]
    rows = []
    for i in range(n):
        words = draw.choice(base).split()
        for _ in range(draw.randrange(0, 4)):
            words[draw.randrange(len(words))] = draw.choice(vocab).title()
        if draw.random() < 0.3:
            words = draw.choice(base).split()[:30] + words
        rows.append((i * 3 % 101, " ".join(words)))
    return rows + [(500, None), (501, ""), (502, " \n "), (503, "one"), (504, "one"), (505, "One two"), (None, rows[0][1]), (None, None), (7, rows[1][1]), (7, rows[1][1]), (506, " ".join(base) * 12)]


@pytest.fixture(scope="module")
def rows():
    return corpus_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return documents(spark, rows).repartition(5)


def tuples(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=lambda t: tuple((x is None, x) for x in t))


def no_documents(spark):
    return documents(spark, [(1, "x")]).where("doc_id = 2")


def test_repetition_rows(spark, docs, rows):
    got = tuples(repetition.repetition_rules(docs), "doc_id", "n_words")
    assert got == sorted(((d, len((t or "").split())) for d, t in rows), key=lambda t: (t[0] is None, t))
    assert repetition.repetition_rules(no_documents(spark)).count() == 0


def test_token_files(spark, docs, rows):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    encoder = token_output.PieceEncoder(path)
    segments = token_output.encode_documents(docs, path)
    got = token_output.read_documents(segments).orderBy("start").collect()
    at, last = 0, None
    assert len(got) == len(rows)
    want = Counter()
    for d, t in rows:
        code = (encoder.whole(t) if t else b"") + (2).to_bytes(4, "little")
        want[d, len(code) // 4, zlib.crc32(code)] += 1
    for r in got:
        assert r.start == at and (last is None or r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ids = {r.doc_id: r.ids for r in token_output.read_ids(segments).where("doc_id = 505").collect()}
    assert ids[505][-1] == 2
    assert token_output.read_documents(token_output.encode_documents(no_documents(spark), path)).count() == 0


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def plain_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))], [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("percent,block_bytes,group", [(85, 2 << 20, 64), (60, 3000, 2), (100, 500, 1)])
def test_jaccard_components(spark, docs, rows, percent, block_bytes, group):
    got = jaccard_join.jaccard_components(docs, percent=percent, block_bytes=block_bytes, group=group)
    want, _ = plain_components(rows, 4, percent)
    assert tuples(got, "doc_id", "n_shingles", "component_id") == sorted(want, key=lambda t: tuple((x is None, x) for x in t))


def test_matrix_finds_links_that_centres_miss(spark):
    """A chain: each text links to the next only, so most links run beside the centres."""
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[i * 4 : i * 4 + 100])) for i in range(60)]
    got = jaccard_join.jaccard_components(documents(spark, chain), group=3)
    assert {r.component_id for r in got.collect()} == {0}
    want, _ = plain_components(chain, 4, 85)
    assert tuples(got, "doc_id", "n_shingles", "component_id") == sorted(want)


def test_one_of_each(spark, docs, rows):
    got = jaccard_join.one_of_each(docs, shingle=5, percent=80)
    _, comp = plain_components(rows, 5, 80)
    want = {}
    empty = 0
    for (d, t), c in zip(rows, comp):
        if not (t or "").split():
            empty += 1
        elif c not in want or (d is None, d) < want[c]:
            want[c] = (d is None, d)
    assert got.columns == docs.columns
    assert got.count() == len(want) + empty
    assert {r.doc_id for r in got.collect() if (r.text or "").split()} == {d for _, d in want.values()}
    assert jaccard_join.one_of_each(no_documents(spark)).count() == 0


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)] + [(500, x) for x in range(501, 600)]
    nodes = sorted({x for e in links for x in e} | {999})
    top = {x: x for x in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    got = components.components(spark.createDataFrame([(x,) for x in nodes], "cls long"), spark.createDataFrame(links, "a long, b long"))
    assert tuples(got, "cls", "comp") == [(x, find(x)) for x in nodes]


def plain_strip(rows, window):
    first = {}
    for d, t in rows:
        w = (t or "").split()
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i : i + window])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, t in rows:
        w = (t or "").split()
        gone = set()
        for i in range(len(w) - window + 1):
            f = first.get(tuple(w[i : i + window]))
            if f is not None and (d is None or f < d):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t))


@pytest.mark.parametrize("block_bytes", [2 << 20, 2000, 300])
def test_repeated_phrases(spark, docs, rows, block_bytes):
    got = phrase_automata.remove_repeats(docs, block_bytes=block_bytes)
    assert tuples(got, "doc_id", "n_words", "n_removed", "kept_sha256") == plain_strip(rows, 13)


def test_no_phrases(spark):
    assert phrase_automata.remove_repeats(no_documents(spark)).count() == 0


def plain_lm(texts, train):
    toks = [(t or "").encode().lower().split() + [0] for t in texts]
    c, b = Counter(), Counter()
    for w, learn in zip(toks, train):
        if learn:
            c.update(w)
            b.update(zip([1] + w[:-1], w))
    n, v, k = sum(c.values()), len(c), Counter(w for _, w in b)
    cv, kinds = Counter(), Counter()
    for (x, _), m in b.items():
        cv[x] += m
        kinds[x, min(m, 3)] += 1
    d, e = (kneser_ney.discounts([sum(x == i for x in table.values()) for i in (1, 2, 3, 4)]) for table in (b, k))
    freed = sum(e[min(x, 3)] for x in k.values())
    word = lambda w: (max(k[w] - e[min(k[w], 3)], 0) + freed / (v + 1)) / len(b) if b else 1 / (v + 1)

    def p(x, w):
        if not cv[x]:
            return word(w)
        return (max(b[x, w] - d[min(b[x, w], 3)], 0) + sum(d[i] * kinds[x, i] for i in (1, 2, 3)) * word(w)) / cv[x]

    base = lambda w: math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))
    return [(len(w), sum(c[x] > 0 for x in w), n, sum(map(base, w)), sum(math.log10(p(x, y)) for x, y in zip([1] + w[:-1], w))) for w in toks]


@pytest.mark.parametrize("block_bytes,rest", [(2 << 20, 10), (1500, 3), (1500, 1)])
def test_language_model(spark, docs, rows, block_bytes, rest):
    train = [d is not None and zlib.crc32(str(d).encode()) % rest != 0 for d, _ in rows]
    want = sorted(plain_lm([t for _, t in rows], train), key=lambda x: x[:1] + x[3:])
    got = kneser_ney.score_documents(docs, quality_model.crc_rest(rest) != 0, block_bytes=block_bytes).collect()
    got = sorted(((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=lambda x: x[:1] + x[3:])
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [x for g in got for x in g[3:]] == pytest.approx([x for w in want for x in w[3:]])


def test_language_model_of_nothing(spark):
    assert kneser_ney.score_documents(no_documents(spark), F.lit(True)).count() == 0


def labelled(spark, n=240):
    good, bad = "a quiet text about the river and the old town where people walk".split(), "buy now !!! cheap &&& click $$$ win ***".split()
    draw, rows, labels = random.Random(9), [], []
    for i in range(n):
        y = i % 3 > 0
        toxic = i % 5 == 0
        words = [draw.choice(good if y else bad) for _ in range(40)] + (["idiot", "scum", "moronic"][: 1 + i % 3] if toxic else [])
        rows.append((i, " ".join(words)))
        labels.append((i, int(y), int(toxic)))
    labels += [(None, 1, 1), (3, None, None), (4, 9, 9), (9999, 0, 1), (0, 0, 1)]
    return documents(spark, rows + [(1000, None), (1001, ""), (None, "river town")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    rest = quality_model.crc_rest(3)
    model = quality_model.fit(docs, labels, usable=rest != 1)
    got = quality_model.score(docs, model).select("doc_id", "text", "score", (rest == 1).alias("held")).collect()
    held = [r for r in got if r.held and r.doc_id < 1000]
    assert len(held) > 40 and all((r.score >= 0.5) == (r.doc_id % 3 > 0) for r in held)
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    blank = quality_model.fit(docs, labels.where("false"))
    assert {r.score for r in quality_model.score(docs, blank).collect()} == {0.5}
    assert quality_model.score(no_documents(spark), model).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels.where("doc_id < 160"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].is_toxic == (i % 5 == 0) for i in range(160, 240))
    assert not got[1000].is_toxic and 0 <= got[1000].severity <= 3
    worst = [got[i].severity for i in range(160, 240) if i % 5 == 0 and i % 3 == 2]
    least = [got[i].severity for i in range(160, 240) if i % 5 == 0 and i % 3 == 0]
    assert min(worst) > max(least)
    none = toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0"))).agg(F.max("severity")).first()[0]
    assert none < 1e-9


ITEMS = [(1, "The train leaves at 10 km per hour and Anna walks 25 miles while Anna counts 10 steps home today."), (2, "too short"), (3, None), (None, "a plain item of six words"), (5, "12 13 14 15 16 17 18 19 20")]


def test_leaks(spark):
    same = ITEMS[0][1]
    other = "the train leaves at 90 km per hour, and Bob walks 35 miles while Bob counts 90 steps home today"
    mixed = "the train leaves at 90 km per hour and Bob walks 35 miles while Carl counts 7 steps home today"
    rows = [(1, "Before. " + same + " after"), (2, "x y z " + other), (3, mixed), (4, "the train leaves at noon"), (5, None), (6, ""), (None, same), (8, "they said a plain item of six words there"), (9, "1 2 3 4 5 6 7 8 9")]
    items = spark.createDataFrame([(i, t, 3) for i, t in ITEMS], "item_id long, text string, doc_id long")
    docs = documents(spark, rows)
    got = decontaminate.leaks(docs, items)
    assert tuples(got, "doc_id", "item_id", "exact") == [(1, 1, True), (2, 1, False), (8, None, True), (None, 1, True)]
    slots = {r.doc_id: r for r in got.collect()}
    assert slots[2].slot_consistency == 1 and (slots[2].n_changed_slots, slots[2].n_slots) == (3, 5)  # the units stay
    left = decontaminate.without_leaks(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 9]
    assert decontaminate.leaks(docs, items.where("false")).count() == 0
    assert decontaminate.without_leaks(no_documents(spark), items).count() == 0
    same_twice = items.union(items.where("item_id = 1"))
    assert decontaminate.leaks(docs, same_twice).where("doc_id = 1").count() == 2


def test_leaks_of_several_occurrences(spark):
    same = ITEMS[0][1]
    other = "the train leaves at 90 km per hour and Bob walks 35 miles while Bob counts 90 steps home today"
    third = "the train leaves at 70 km per hour and Carl walks 45 miles while Carl counts 70 steps home today"
    mixed = "the train leaves at 90 km per hour and Bob walks 35 miles while Carl counts 7 steps home today"
    spaced = lambda numbers, extra="": " ".join((f"{extra} " if i == 20 else "") + (str(numbers[i // 10]) if i % 10 == 5 else f"word{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(40))
    far = " z" * 90 + " "
    rows = [(1, f"{same} {other}"), (2, other + far + third), (3, f"{mixed} {same} {mixed}"), (4, f"{mixed} {mixed}"), (5, spaced([9] * 4, "more") + far + spaced([1, 2, 3, 4])), (6, spaced([1, 2, 3, 4]))]
    items = spark.createDataFrame([ITEMS[0], (2, spaced([10] * 4))], "item_id long, text string")
    got = decontaminate.leaks(documents(spark, rows), items)
    assert tuples(got, "doc_id", "item_id", "exact") == [(1, 1, True), (2, 1, False), (3, 1, True), (5, 2, False)]


def test_leaks_behind_marks_and_in_another_case(spark):
    same, apart = ITEMS[0][1], "Visitors see Anna Berg and Carl Lund near Paul Holm before Rosa Falk meets Otto Lind at noon"
    rows = [(1, f"--- *** {same}"), (2, f"so ... then -- {same}"), (3, same.replace("and Anna", "--- and ... Anna")), (4, same.upper()), (5, apart.lower()), (6, f"<num> <b> > {apart.upper()}"), (7, "Visitors see nobody at noon")]
    items = spark.createDataFrame([ITEMS[0], (2, apart)], "item_id long, text string")
    got = decontaminate.leaks(documents(spark, rows), items)
    assert tuples(got, "doc_id", "item_id", "exact", "coverage") == [(1, 1, True, 1.0), (2, 1, True, 1.0), (3, 1, True, 1.0), (4, 1, True, 1.0), (5, 2, True, 1.0), (6, 2, True, 1.0)]


def test_template_words_stand_where_the_words_stand(spark):
    texts = ["a -- b", "---\na\n***", "... \u2014 x", "<num> <name> Anna <b>Bob</b>", "I saw 3 KM -5% \u00e9t\u00e9 \u0130x Bob\u2019s (Carl).", "x \u00a0 y", "", None, "\U0001f600 a\u0301 \u0301"]
    clean = decontaminate.without_lone_marks(F.col("text"))
    both = documents(spark, list(enumerate(texts))).select(decontaminate.words_of(clean).alias("w"), *[decontaminate.words_of(f(decontaminate.template_text(clean))).alias(f.__name__) for f in (decontaminate.typed, decontaminate.untyped)])
    assert all(len(r.w) == len(r.typed) == len(r.untyped) for r in both.collect())


def test_leaks_of_excerpts_and_unsearched_items(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(59)]
    numbers = "12 13 14 15 16 17 18 19 20"
    items = spark.createDataFrame([(1, " ".join(words)), (2, "Too short!"), (3, numbers), (4, " -- "), (5, "Rate 3 7 1.5 9")], "item_id long, text string")
    rows = [(1, "a " + " ".join(words[20:33]) + " b"), (2, " ".join(words[20:32])), (3, " ".join(words[:12] + ["x"] + words[12:24])), (4, "is TOO short, or not"), (5, f"row {numbers} end"), (6, "12 13 14 15 16 17 18 19 21 1"), (7, "rate 3 7 1.5 9."), (8, "rate 3 7 15 9"), (9, "too -- long")]
    got = decontaminate.leaks(documents(spark, rows), items)
    assert tuples(got, "doc_id", "item_id", "exact") == [(1, 1, True), (4, 2, True), (5, 3, True), (6, 3, True), (7, 5, True)]


def test_mixing(spark):
    draw = random.Random(3)
    words = {"en": "the and of with that".split(), "fr": "le la avec pour dans".split()}
    rows = [(i, "en" if i % 4 else "fr") for i in range(200)]
    data = [(i, " ".join(draw.choice(words[k]) for _ in range(draw.randrange(20, 60))), k, "keep") for i, k in rows] + [(900, None, "en", "keep"), (None, "the of", "en", "keep")]
    docs = spark.createDataFrame(data, "doc_id long, text string, domain string, p string")
    known = docs.where("doc_id < 100").select("doc_id", "domain").union(spark.createDataFrame([(None, "en"), (5, None), (6, "xx")], "doc_id long, domain string"))
    targets = {"en": 1.0, "fr": 2.0}
    got = source_mixing.rates(docs, known, targets).collect()
    total = [sum(r.rate * r.n_words * r.p[k] for r in got) for k in (0, 1)]
    assert total[1] / total[0] == pytest.approx(2, abs=0.01)
    assert all(r.rate >= 0 and sum(r.p) == pytest.approx(1) for r in got) and len(got) == len(data)
    now = [sum(r.n_words * r.p[k] for r in got) for k in (0, 1)]
    assert sum(total) == pytest.approx(source_mixing.MARGIN * max(now[0] * 3, now[1] * 1.5), rel=0.01)
    mixed = source_mixing.mixed(docs, known, targets)
    assert mixed.columns == docs.columns
    rate = {r.doc_id: r.rate for r in got}
    times = Counter(r.doc_id for r in mixed.collect())
    assert all(abs(times[d] - x) < 1 for d, x in rate.items())
    fewer = source_mixing.rates(docs, known, targets, total=now[0] * 0.3)
    assert fewer.agg(F.min("rate")).first()[0] >= 0
    assert source_mixing.mixed(docs.where("false"), known, targets).count() == 0


def test_mixing_of_a_domain_that_no_label_has(spark):
    """Its target can't be met: nothing is repeated in its stead, the others meet theirs, and the result says so."""
    draw = random.Random(4)
    words = {"en": "the and of with that".split(), "fr": "le la avec pour dans".split()}
    data = [(i, " ".join(draw.choice(words["fr" if i % 3 == 0 else "en"]) for _ in range(40)), "fr" if i % 3 == 0 else "en") for i in range(150)] + [(150, None, None), (151, "le " * 5000, "fr")]
    docs = spark.createDataFrame(data, "doc_id long, text string, domain string")
    got = source_mixing.rates(docs, docs.select("doc_id", "domain"), {"en": 0.4, "fr": 0.4, "xx": 0.2}).collect()
    total = [sum(r.rate * r.n_words * r.p[k] for r in got) for k in range(3)]
    assert total[0] / total[1] == pytest.approx(1, abs=0.01) and total[2] == 0
    assert max(r.rate for r in got) < 4 and not any(r.met for r in got)
    assert all(r.met for r in source_mixing.rates(docs, docs.select("doc_id", "domain"), {"en": 0.5, "fr": 0.5}).select("met").collect())
    none = source_mixing.rates(docs, docs.where("false").select("doc_id", "domain"), {"en": 0.5, "fr": 0.5}).collect()
    assert {(r.rate, r.met) for r in none} == {(1.0, False)}


def test_mixed_works_posteriors_out_once(spark, docs):
    """The copies are read from stored posteriors: the plan cuts no text."""
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    mixed = source_mixing.mixed(docs, labelled, {"en": 1.0})
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "xxhash64" in plan
    assert mixed.columns == docs.columns


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a<p>b", 3), (2, None, None, 4), (None, "v", "", 5), (1, "u", "<p>a<p>b", 3)], "page_id long, url string, html string, text long")
    got = render_pages(pages)
    assert tuples(got, "page_id", "text", "n_chars") == [(1, "a\n\nb", 4), (1, "a\n\nb", 4), (2, "", 0), (None, "", 0)]
