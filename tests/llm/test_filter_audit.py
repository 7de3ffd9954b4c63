"""The filter audit against a walk over every document in every order."""

import random
import re
from itertools import permutations
from math import comb

import numpy as np
import pytest

from redline.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, part string, failed int, v_docs long, digest string"


def plain(rows, labels):
    """Result rows by walking each document through each order."""
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    fails = []
    for d, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words),
            100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), d is not None and d > first[t],
        )
        fails.append((part or "", {f for f, hit in zip("ABCDE", tests) if hit}, d in good, d in toxic))
    out, total = {}, {}
    for order in permutations("ABCDE"):
        for part in {p for p, *_ in fails}:
            left = [f for f in fails if f[0] == part]
            for step, name in enumerate(order, 1):
                gone = [f for f in left if name in f[1]]
                kept = [f for f in left if name not in f[1]]
                failing = sum(name in f[1] for f in fails if f[0] == part)
                unique = sum({name} == f[1] for f in fails if f[0] == part)
                out[part, "".join(order), step] = [len(kept), len(gone), failing - len(gone), unique, sum(f[2] for f in gone), sum(f[3] for f in gone)]
                total[part, name] = total.get((part, name), 0) + len(gone)
                left = kept
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows_and_labels():
    draw = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    texts = [None, "", " ", "one", "A B", "#", "é" * 100, "Ünï\u00a0cödé " * 60, "X" * 11 + "y" * 89, "X" * 10 + "y" * 90]
    texts += [" ".join(vocab[:100]), " ".join(vocab[:99]), " ".join(vocab[:80] + vocab[:20]), " ".join(vocab[:79] + vocab[:21]), " ".join(vocab) * 40 + " $"]
    for _ in range(20):
        words = [draw.choice(vocab).upper() if draw.random() < 0.2 else draw.choice(vocab) for _ in range(draw.randrange(50, 300))]
        texts.append(" ".join(words) + draw.choice(["", "", "|"]))
    rows = [(i * 7 % 997, draw.choice(texts), draw.choice(["en", "de", None, ""])) for i in range(300)]
    rows += [(5000, "one", "en")] * 3 + [(None, "one", "en"), (None, None, None), (4999, "one", "de"), (-1, texts[-1], "en")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 997, 2)] + [(5000, 0, 1), (5000, 1, None), (None, 1, 1), (77777, 1, 1)]
    return rows, labels


@pytest.fixture(scope="module")
def case():
    return rows_and_labels()


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "own", 31, 9, "mine") for r in rows], SCHEMA).repartition(7)
    return docs, spark.createDataFrame([(*r, "other") for r in labels], "doc_id long, quality int, toxic int, lang string")


def test_audit_against_a_walk(spark, case):
    docs, labels = frames(spark, *case)
    got = filter_audit.audit(docs, labels).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got} == plain(*case)
    assert len(got) == 600 * 3


def test_audit_of_another_part_and_of_nothing(spark, case):
    docs, labels = frames(spark, *case)
    got = filter_audit.audit(docs, labels, part="part").collect()
    assert len(got) == 600 and {r.part for r in got} == {"own"}
    assert filter_audit.audit(docs.where("doc_id = 123456"), labels).count() == 0
    none = filter_audit.audit(docs, labels.where("false")).agg({"good_lost": "max", "toxic_lost": "max"}).first()
    assert tuple(none) == (0, 0)


def test_a_third_of_all_rows_one_text(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same text' ELSE concat('w', id) END AS text", "'en' AS lang")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels).where("filter_order = 'EABCD' AND step = 1").first()
    assert (got.removed, got.kept) == (999, 2001)


def test_weights_solve_the_kernel_weighted_least_squares():
    n, sets = 5, range(32)
    value = np.array([random.Random(s).randrange(1000) if s else 0 for s in sets], float)
    phi = np.array(filter_audit.shapley_weights(n)) @ value / 120
    assert phi.sum() == pytest.approx(value[31])
    has = np.array([[s >> i & 1 for i in range(n)] for s in sets], float)
    size = has.sum(axis=1).astype(int)
    weight = np.array([(n - 1) / (comb(n, k) * k * (n - k)) if 0 < k < n else 0 for k in size])
    slope = has.T @ (weight * (has @ phi - value))
    assert np.ptp(slope) == pytest.approx(0, abs=1e-9)  # stationary along the constraint
