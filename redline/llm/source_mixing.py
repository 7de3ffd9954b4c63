"""Mixing documents to target domain weights by soft membership, in DataFrame operations only.

A labelled table tells the domain of some documents. A naive Bayes classifier on hashed words, counted from a bounded
sample of them, gives every document a posterior p over the domains (tempered, as words repeat each other's evidence).
Document rates r >= 0 are then fitted so that the expected domain totals sum_d r_d * words_d * p_dk meet the targets T_k,
by projected gradient on the least squares sum_k (total_k - T_k)^2 / now_k, from r = 1: each step is one aggregation of
the document rows, to as many numbers as there are domains; rows replay the steps, so no rates are stored in between. With
weights 1 / now_k the step length 1 never overshoots. Steps end when all targets are met within TOLERANCE, or when PATIENCE
more of them bring the misfit down by less than STALLED of itself: then no rates meet the targets, those reached are the
least-squares fit, and met is false. A token is a word here (a run of non-spaces), as SQL functions cut them.

The targets' scale is MARGIN above the smallest at which no domain has to shrink in total, so documents are repeated
rather than lost; pass total to set it.

Defined results: null and empty texts have no words, the prior as posterior, and a rate as all others. A target domain
without labelled rows can't be told: its posterior is 0, no document is repeated for it, the others are fitted to their own
targets, and met is false; without any labelled rows all rates are 1. Labelled rows with a null or foreign domain are left out; a doc_id labelled
twice counts once for each of its domains. Repeated rows and null doc_ids are documents of their own. Empty tables give
no rows. Other columns are ignored by rates() and kept by mixed().
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.llm.decontaminate import WORD_GAP
from redline.session import store

PLACES = 4096
MAX_ROWS = 4000
SHARP_WORDS = 30
TOLERANCE = 1e-4
PATIENCE, STALLED = 10, 0.01
#: Log prior of a domain that no labelled row has.
NEVER = -1e6
MARGIN = 1.02


def word_places(text: Column) -> Column:
    """Hash place of each word, A-Z lower-cased by lower()."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(PLACES)).cast("int"))


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], max_rows: int = MAX_ROWS) -> tuple[list[list[float]], list[float]]:
    """Log chances of the word places and log prior, for each domain. labelled has doc_id and domain; the max_rows rows
    with the smallest hash of the id are used, a bounded number that is broadcast to the documents."""
    known = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain")).where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).distinct()
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(max_rows)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    prior = {r.domain: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    counts = chosen.select("domain", F.explode(word_places(F.col("text"))).alias("place")).groupBy("domain", "place").agg(F.count("*").alias("n"))
    table = {d: [0.5] * PLACES for d in domains}
    for r in counts.collect():  # len(domains) * PLACES rows at most
        table[r.domain][r.place] += r["n"]
    chances = []
    for d in domains:
        total = sum(table[d])
        chances.append([math.log(x / total) for x in table[d]])
    rows = sum(prior.values()) + len(domains)
    return chances, [math.log((prior[d] + 1) / rows) if d in prior else NEVER for d in domains]


def constant(values: list) -> Column:
    """A (nested) array of doubles as one constant, however long: the optimiser folds the parsing away."""
    kind = "array<array<double>>" if values and isinstance(values[0], list) else "array<double>"
    return F.from_json(F.lit(json.dumps(values)), kind)


def _sum_over_places(chances: Column) -> Column:
    return F.aggregate("places", F.lit(0.0), lambda a, w: a + F.get(chances, w))


def with_posteriors(docs: DataFrame, chances: list[list[float]], prior: list[float]) -> DataFrame:
    """docs with n_words long and p array<double> (the domains' posteriors) of each document; map-side."""
    some = docs.withColumn("places", word_places(F.col("text"))).withColumn("n_words", F.size("places").cast("long"))
    sums = [_sum_over_places(constant(each)) for each in chances]
    temper = F.least("n_words", F.lit(SHARP_WORDS)) / F.greatest("n_words", F.lit(1))
    some = some.withColumn("score", F.array(*[s * temper + F.lit(q) for s, q in zip(sums, prior)])).drop("places")
    some = some.withColumn("e", F.transform("score", lambda x: F.exp(x - F.array_max("score"))))
    some = some.withColumn("p", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y))).drop("score", "e")
    if max(prior) == NEVER:
        some = some.withColumn("p", F.transform("p", lambda x: F.lit(0.0)))
    return some


def posteriors(docs: DataFrame, chances: list[list[float]], prior: list[float]) -> DataFrame:
    """doc_id, n_words and p of each document."""
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_posteriors(some, chances, prior).select("doc_id", "n_words", "p")


def rate_after(steps: list[list[float]]) -> Column:
    """The rate of a row after the projected steps so far, from 1."""
    if not steps:
        return F.lit(1.0)
    dot = lambda s: F.aggregate(F.zip_with("p", s, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(constant(steps), F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - dot(s)))


def fit_steps(rows: DataFrame, weights: list[float], total: float | None = None) -> tuple[list[list[float]], bool]:
    """The steps of the projected gradient, and whether the totals are within TOLERANCE of the targets after them."""
    size = len(weights)

    def totals(steps):
        rate = rate_after(steps)
        got = rows.agg(*[F.sum(rate * F.col("n_words") * F.col("p")[k]) for k in range(size)]).first()
        return [float(x or 0.0) for x in got]

    now = totals([])
    if not sum(now):
        return [], False
    share = [w / sum(weights) for w in weights]
    if total is None:
        total = MARGIN * max(n / s for n, s in zip(now, share) if s > 0)
    target, steps, held, misfits = [s * total for s in share], [], now, []
    while True:
        off = [h - t if n > 0 else 0.0 for h, t, n in zip(held, target, now)]  # what no document has can't be fitted
        if all(abs(x) <= TOLERANCE * total for x in off):
            return steps, all(n > 0 or t == 0 for n, t in zip(now, target))
        misfits.append(sum(x * x / max(n, 1.0) for x, n in zip(off, now)))
        if len(misfits) > PATIENCE and misfits[-1] > (1 - STALLED) * misfits[-1 - PATIENCE]:
            return steps, False
        steps.append([x / max(n, 1.0) for x, n in zip(off, now)])
        held = totals(steps)


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, n_words, p (posteriors in the order of the targets) and rate of each document, and met: do the rates meet
    the targets?"""
    domains = list(targets)
    rows = store(posteriors(docs, *fit(docs, labelled, domains, max_rows)), "posteriors")
    steps, met = fit_steps(rows, list(targets.values()), total)
    return rows.withColumn("rate", rate_after(steps)).withColumn("met", F.lit(met))


def copies(rate: Column, key: Column) -> Column:
    """Whole copies of a document: the rate, its fraction decided by the key's hash, so that sums keep the rates."""
    chance = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents, with all their columns, each as often as its rate says. Documents are written once, with their
    posteriors, from which all else is worked out; no text is shuffled."""
    domains = list(targets)
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("_key"), F.col("text"))
    rows = store(with_posteriors(packed, *fit(docs, labelled, domains, max_rows)).drop("text"), "posteriors")
    steps, _ = fit_steps(rows, list(targets.values()), total)
    out = rows.select("_row", copies(rate_after(steps), F.col("_key")).alias("_times")).where("_times > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
