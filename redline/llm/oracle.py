"""DuckDB SQL for the queries that SQL can express, written from their definitions alone."""

from __future__ import annotations

GAP = r"[\x20\x09-\x0D]+"
DOCS = "d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"
WORDS = f"""w AS (SELECT r, w, row_number() OVER (PARTITION BY r ORDER BY i) AS i FROM (
    SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, string_split_regex({{text}}, '{GAP}') AS ws FROM d)) WHERE w <> '')"""


def _windows(name: str, n: int, more: str = "") -> str:
    """Each run of n words by its first word: r, i, key."""
    return f"""{name} AS (SELECT r, i, array_to_string(ws, ' ') AS key FROM (
        SELECT r, i, list(w) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS ws FROM w) WHERE len(ws) = {n}{more})"""


def _covered(name: str, windows: str, hit: str, n: int) -> str:
    """Words that a chosen window covers: r, i."""
    return f"{name} AS (SELECT DISTINCT r, i + unnest(range({n})) AS i FROM {windows} WHERE {hit})"


def repetition(ngram_limits: dict[int, float], line_limit: float) -> str:
    parts = [DOCS, WORDS.format(text="text")]
    for n in (3, *ngram_limits):
        parts.append(_windows(f"g{n}", n))
        parts.append(f"h{n} AS (SELECT r, i, count(*) OVER (PARTITION BY r, key) AS times FROM g{n})")
        parts.append(_covered(f"c{n}", f"h{n}", "times > 1", n))
        parts.append(f"s{n} AS (SELECT r, count(*) AS words, sum(length(w)) AS chars FROM c{n} JOIN w USING (r, i) GROUP BY r)")
    parts.append(f"""l AS (SELECT r, length(regexp_replace(line, '{GAP}', '', 'g')) AS chars, row_number() OVER (PARTITION BY r, line ORDER BY i) AS seen
        FROM (SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT r, string_split(text, chr(10)) AS ls FROM d)) WHERE regexp_replace(line, '{GAP}', '', 'g') <> '')""")
    parts.append("ls AS (SELECT r, count(*) FILTER (seen > 1) AS dup, coalesce(sum(chars) FILTER (seen > 1), 0) AS chars FROM l GROUP BY r)")
    parts.append("ws AS (SELECT r, count(*) AS n, sum(length(w)) AS chars FROM w GROUP BY r)")
    grams = ", ".join(f"coalesce(s{n}.chars, 0)::BIGINT AS dup_{n}gram_chars" for n in ngram_limits)
    joins = " ".join(f"LEFT JOIN s{n} ON s{n}.r = d.r" for n in (3, *ngram_limits))
    good = " AND ".join([f"dup_line_chars <= {line_limit} * word_chars", *[f"dup_{n}gram_chars <= {limit} * word_chars" for n, limit in ngram_limits.items()]])
    parts.append(f"""a AS (SELECT doc_id, coalesce(ws.n, 0)::BIGINT AS n_words, coalesce(ws.chars, 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(ls.dup, 0)::BIGINT AS n_dup_lines,
        coalesce(s3.words, 0)::BIGINT AS n_repeat_words, coalesce(ls.chars, 0)::BIGINT AS dup_line_chars, {grams}
        FROM d LEFT JOIN ws ON ws.r = d.r LEFT JOIN ls ON ls.r = d.r {joins})""")
    parts.append("b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)")
    return f"WITH {', '.join(parts)} SELECT *, NOT base_failed AND {good} AS kept FROM b"


def repeated_phrases(window: int) -> str:
    return f"""WITH {DOCS}, {WORDS.format(text="text")}, {_windows("g", window)},
    h AS (SELECT g.r, g.i, d.doc_id, min(d.doc_id) OVER (PARTITION BY g.key) AS first_id FROM g JOIN d USING (r)),
    {_covered("c", "h", "first_id < coalesce(doc_id, 9223372036854775807)", window)},
    k AS (SELECT w.r, count(*) AS n, count(c.i) AS gone, string_agg(CASE WHEN c.i IS NULL THEN w.w END, ' ' ORDER BY w.i) AS kept
        FROM w LEFT JOIN c ON c.r = w.r AND c.i = w.i GROUP BY w.r)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""


def jaccard_components(shingle: int, percent: int) -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE {DOCS}, {WORDS.format(text=lower)}, {_windows("g", shingle)},
    s AS (SELECT DISTINCT r, key FROM g UNION ALL SELECT r, string_agg(w, ' ' ORDER BY i) || chr(0) FROM w GROUP BY r HAVING count(*) < {shingle}),
    n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
    p AS (SELECT a.r AS a, b.r AS b, count(*) AS n_both FROM s a JOIN s b ON a.key = b.key AND a.r < b.r GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * n_both >= {percent} * (x.n + y.n - n_both)),
    u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, u.b FROM reach JOIN u ON u.a = reach.b)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(x.doc_id) FROM reach JOIN d x ON x.r = reach.b WHERE reach.a = d.r) AS component_id
    FROM d LEFT JOIN n ON n.r = d.r"""


def filter_audit() -> str:
    """Each order is walked as it is told: a step removes what fails its filter and no filter before it."""
    letters = "(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f)"
    return f"""WITH RECURSIVE {DOCS.replace("doc_id, ", "doc_id, coalesce(lang, '') AS part, ")}, {WORDS.format(text="text")},
    n AS (SELECT r, count(*) AS n, count(DISTINCT w) AS n_distinct FROM w GROUP BY r),
    g AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
    c AS (SELECT d.r, part, coalesce(g.good, false) AS good, coalesce(g.toxic, false) AS toxic, concat(
        CASE WHEN coalesce(n.n, 0) < 100 THEN 'A' ELSE '' END,
        CASE WHEN 100 * coalesce(n_distinct, 0) < 80 * coalesce(n.n, 0) THEN 'B' ELSE '' END,
        CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END,
        CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
        CASE WHEN d.doc_id > first_id THEN 'E' ELSE '' END) AS fails
        FROM d LEFT JOIN n USING (r) LEFT JOIN g ON g.doc_id = d.doc_id JOIN m USING (text)),
    o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || f FROM o, {letters} WHERE NOT contains(filter_order, f)),
    s AS (SELECT filter_order, k AS step, filter_order[k] AS f, filter_order[1:k - 1] AS before FROM o, range(1, 6) t(k) WHERE length(filter_order) = 5),
    u AS (SELECT part, fails, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM c GROUP BY ALL),
    x AS (SELECT part, filter_order, step, f, docs, good, toxic, contains(fails, f) AS hit, fails = f AS only_f,
        len(list_filter(string_split(before, ''), lambda b: b <> '' AND contains(fails, b))) > 0 AS gone FROM u, s),
    y AS (SELECT part, filter_order, step, f, coalesce(sum(docs) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(docs) FILTER (hit AND NOT gone), 0) AS removed,
        coalesce(sum(docs) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(docs) FILTER (only_f), 0) AS unique_fails,
        coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost FROM x GROUP BY ALL)
    SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
        unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
        (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM y"""


VECTORS = """v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


def norm_search(divisor: int, k: int) -> str:
    return f"""WITH {VECTORS},
    p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % {divisor} = 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM p)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM o WHERE rank <= {k}"""


def hard_negatives(divisor: int, positives: int, negatives: int) -> str:
    return f"""WITH {VECTORS},
    l AS (SELECT r, vec_id, e, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM v WHERE label IS NOT NULL),
    p AS (SELECT a.r, a.vec_id AS anchor_id, a.label = c.label AS same, c.r AS other, c.vec_id, list_inner_product(a.e, c.e)::BIGINT AS score
        FROM l a JOIN l c ON a.r <> c.r WHERE a.vec_id % {divisor} = 0),
    s AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM p WHERE same),
    n AS (SELECT s.r, s.anchor_id, s.vec_id AS positive_id, s.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
        row_number() OVER (PARTITION BY s.r, s.other ORDER BY n.score DESC, n.vec_id) AS rank
        FROM s JOIN p n ON n.r = s.r AND NOT n.same AND 80 * s.score <= 100 * n.score AND n.score <= s.score WHERE s.place <= {positives})
    SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives}"""
