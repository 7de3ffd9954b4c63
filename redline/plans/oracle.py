"""The derived tables as SQL, for an engine that shares no code with Spark. Only used to check results.

``with_tables(select)`` puts the tables a statement names in front of it.
"""

from __future__ import annotations

import re

from redline import vocab as V
from redline.functions.edits import any_of
from redline.operators import triage
from redline.sources import paragraphs as scan
from redline.sources.derived import AS_OF, STATUSES


def q(text: str | None) -> str:
    """SQL string literal."""
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, {q(V.STRIP)}, '', 'g')"


def tokens(c: str) -> str:
    return f"list_filter(string_split_regex({c}, {q(V.WS + '+')}), lambda w: w <> '')"


def rx(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def hits(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {q(pattern)}))"


def normalise(c: str) -> str:
    inner = strip(f"lower({c})")
    return f"regexp_replace({inner}, {q(V.WS + '+')}, ' ', 'g')"


def sentences(c: str) -> str:
    return (
        f"greatest(1, len(list_filter(string_split_regex({c}, {q(V.SENTENCE_END)}), "
        f"lambda s: regexp_matches(s, {q('[^' + V.SPACE + ']')}))))"
    )


def words(c: str) -> str:
    return hits(c, V.WORD)


def syllables(c: str) -> str:
    return (
        f"coalesce(list_sum(list_transform(regexp_extract_all(lower({c}), {q(V.WORD)}), "
        f"lambda w: greatest(1, len(regexp_extract_all(w, {q(V.VOWEL_RUN)}))))), 0)::BIGINT"
    )


def readability(c: str) -> str:
    return (
        f"CASE WHEN length({strip(c)}) < 10 OR {words(c)} = 0 THEN 0.0::DOUBLE ELSE 206.84::DOUBLE - "
        f"60 * ({syllables(c)}::DOUBLE / {words(c)}::DOUBLE) - 1.02::DOUBLE * ({words(c)}::DOUBLE / {sentences(c)}::DOUBLE) END"
    )


def spanish(c: str) -> str:
    return f"({hits(c, V.SPANISH_CHAR)}::DOUBLE / greatest(length({c}), 1)::DOUBLE)"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def str_list(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


def chain(c: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        c = f"replace({c}, {q(a)}, {q(b)})"
    return c


ANY_RULE = any_of(V.EDIT_RULES)
_replacements = "MAP {" + ", ".join(f"{q(wrong)}: {q(right)}" for _, _, wrong, right, _ in V.EDIT_RULES) + "}"


def found(c: str, pattern: str = ANY_RULE) -> str:
    return f"regexp_extract_all({c}, {q(pattern)})"


def pieces(c: str, pattern: str = ANY_RULE) -> str:
    return f"string_split_regex({c}, {q(pattern)})"


def match_start(found: str, pieces: str, i: str) -> str:
    """Place, from 0, of the i-th match."""
    return f"(list_sum(list_transform({pieces}[1:{i}], lambda p: length(p))) + coalesce(list_sum(list_transform({found}[1:{i} - 1], lambda f: length(f))), 0))::BIGINT"


def joined(pieces: str, values: str) -> str:
    """Pieces with a value after each but the last."""
    return f"(coalesce(array_to_string(list_transform(range(1, len({pieces})), lambda i: {pieces}[i] || {values}[i]), ''), '') || {pieces}[len({pieces})])"


def fixed(found: str, pieces: str) -> str:
    return joined(pieces, f"list_transform({found}, lambda f: {_replacements}[f])")


def _region_hits() -> str:
    """Matches of each pattern, of proper names with the two characters before them, which they are told by, and of terms."""
    parts = []
    listed = [(reason, p, 0) for reason, p in V.REGION_PATTERNS] + [("proper_name", V.PROPER_NAME.replace("(?<=[^.!?]\\s)", "[^.!?]\\s"), 2)]
    for k, (reason, pattern, lead) in enumerate(listed):
        parts.append(f"""SELECT doc_id, paragraph_index, {k} AS pat, i, {q(reason)} AS reason, {match_start('found', 'pieces', 'i')} + {lead} AS start_at, substr(found[i], {lead + 1}) AS text
            FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, paragraph_index, {found('stripped', pattern)} AS found, {pieces('stripped', pattern)} AS pieces
                FROM t_typed WHERE regexp_matches(stripped, {q(pattern)})))""")
    parts.append("""SELECT doc_id, paragraph_index, 100 + j AS pat, i, 'profile_term' AS reason, spot AS start_at, substr(stripped, spot + 1, length(term)) AS text
        FROM (SELECT *, (list_sum(list_transform(ps[1:i], lambda p: length(p))) + (i - 1) * length(term))::BIGINT AS spot
            FROM (SELECT *, unnest(range(1, len(ps))) AS i FROM (SELECT *, string_split(lower(stripped), lower(term)) AS ps
                FROM (SELECT doc_id, paragraph_index, stripped, unnest(protected_terms) AS term, generate_subscripts(protected_terms, 1) AS j FROM t_typed))))""")
    return " UNION ALL ".join(parts)


def first_hit(c: str, pairs: list[tuple[str, str]]) -> str:
    cases = " ".join(f"WHEN contains({c}, {q(a)}) THEN replace({c}, {q(a)}, {q(b)})" for a, b in pairs)
    return f"CASE {cases} ELSE {c} END"


def first_of(c: str, words: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({c}, {q(w)}) THEN {q(w)}" for w in words) + " END"


def one_of(c: str, pairs: list[tuple[str, str]]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in pairs) + " END"


def classify(s: str, location: str, style: str, table: str = "false", terms: str | None = None) -> str:
    dense = ""
    if terms:
        dense = (
            f"WHEN len({terms}) > 0 AND len(list_filter({terms}, lambda t: contains(lower({s}), lower(t))))::DOUBLE / "
            f"len({tokens(s)})::DOUBLE > {V.TERM_DENSITY}::DOUBLE THEN 'explicacion_tecnica' "
        )
    head = f"regexp_matches(lower({style}), 'heading|título|titulo')"
    return (
        f"CASE WHEN {s} = '' THEN 'vacio' WHEN starts_with({location}, 'header:') THEN 'encabezado' "
        f"WHEN starts_with({location}, 'footer:') THEN 'footer' "
        f"WHEN {table} OR starts_with({location}, 'table:') THEN 'celda_tabla' "
        f"WHEN {head} AND contains({style}, '1') THEN 'titulo' WHEN {head} THEN 'subtitulo' "
        f"WHEN regexp_matches(lower({style}), 'quote|cita') THEN 'cita' "
        f"WHEN regexp_matches(lower({style}), 'list') THEN 'lista' WHEN contains(lower({style}), 'title') THEN 'titulo' "
        f"WHEN {rx(s, V.DIALOGUE)} THEN 'dialogo' WHEN {rx(s, V.LIST_ITEM)} THEN 'lista' "
        f"WHEN {rx(f'lower({s})', V.CAPTION_NUMBERED)} OR {rx(f'lower({s})', V.CAPTION_ATTRIBUTION)} THEN 'pie_imagen' "
        f"{dense}ELSE 'narrativo' END"
    )


def page_of(index: str, n: str, pages: str) -> str:
    return f"greatest(1, least(floor({index}::DOUBLE / greatest({n}, 1)::DOUBLE * {pages})::BIGINT + 1, {pages}))::BIGINT"


def jaccard(a: str, b: str) -> str:
    x, y = f"list_distinct({tokens(a)})", f"list_distinct({tokens(b)})"
    both = f"len(list_intersect({x}, {y}))"
    union = f"(len({x}) + len({y}) - {both})"
    return f"CASE WHEN {union} = 0 THEN 1.0::DOUBLE ELSE {both}::DOUBLE / {union}::DOUBLE END"


def _preset_rows() -> str:
    def value(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return str_list(v)
        if isinstance(v, float):
            return f"{v}::DOUBLE"
        return q(v) if v is None or isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(value(v) for v in row) + ")" for row in V.PRESETS)


def _stage_rows() -> str:
    return ", ".join(f"({q(s)}, {a}::DOUBLE, {b}::DOUBLE, {q(l)})" for s, a, b, l in V.STAGES)


def _route_case() -> str:
    size = f"length({strip('pass0_text')})"
    return (
        f"CASE WHEN paragraph_type IN {in_list(V.SKIP_TYPES)} THEN 'skip|type:' || paragraph_type "
        "WHEN paragraph_type = 'cita' THEN 'skip|quote_preserve' "
        f"WHEN {size} < 30 AND rule_hits = 0 AND NOT is_transition THEN 'skip|short_clean' "
        "WHEN is_transition THEN 'editorial|section_transition' "
        f"WHEN section_position IN ('first', 'last') AND {size} > 80 THEN 'editorial|section_' || section_position "
        f"WHEN paragraph_type = 'narrativo' AND {size} > 300 AND {hits(strip('pass0_text'), V.SUBORDINATE)} >= 2 THEN 'editorial|complex_syntax' "
        f"WHEN paragraph_type = 'dialogo' AND {size} > 200 THEN 'editorial|long_dialogue' "
        f"WHEN intervention_level = 'agresiva' AND {size} > 200 THEN 'editorial|aggressive_long' "
        f"WHEN paragraph_type IN {in_list(V.CHEAP_TYPES)} THEN 'cheap|type:' || paragraph_type "
        "WHEN intervention_level = 'minima' THEN 'cheap|minimal_intervention' "
        f"WHEN rule_hits = 0 AND {size} < 150 THEN 'cheap|short_clean_text' ELSE 'cheap|default' END"
    )


_entities = "{}"
for _name, _char in scan.ENTITIES:
    _entities = f"replace({_entities}, {q(_name)}, {q(_char)})"


def html_text(c: str) -> str:
    bare = _entities.format(f"regexp_replace({c}, '<[^>]*>', ' ', 'g')")
    flat = f"regexp_replace({bare}, {q(V.WS + '+')}, ' ', 'g')"
    return f"regexp_replace({flat}, {q(V.STRIP)}, '', 'g')"


TABLES: dict[str, str] = {
    "t_lines": """SELECT doc_id, lang, source, key_word, unnest(ls) AS text, (generate_subscripts(ls, 1) - 1)::BIGINT AS paragraph_index,
        len(ls)::BIGINT AS n_paragraphs
        FROM (SELECT doc_id, lang, source, regexp_extract(text, '[A-Za-z]{6,}') AS key_word, string_split(text, chr(10)) AS ls FROM documents)""",
    "t_paras": """SELECT *, 'body:' || paragraph_index AS location,
        CASE WHEN paragraph_index = 0 AND length(text) BETWEEN 1 AND 60 THEN 'Heading 1'
             WHEN paragraph_index > 0 AND length(text) BETWEEN 1 AND 30 THEN 'Heading 2' END AS style_name,
        lead(text) OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS next_text,
        bool_or(paragraph_index > 0 AND length(text) BETWEEN 1 AND 30) OVER (PARTITION BY doc_id) AS has_sections
        FROM t_lines""",
    "t_sectioned": """SELECT *,
        CASE WHEN chunked THEN paragraph_index // 30 ELSE sum((opens AND NOT chunked)::BIGINT) OVER (PARTITION BY doc_id ORDER BY paragraph_index) END::BIGINT AS section_index,
        CASE WHEN starts THEN 'first' WHEN ends THEN 'last' ELSE 'middle' END AS section_position,
        starts AND paragraph_index > 0 AS is_transition
        FROM (SELECT *, (CASE WHEN chunked THEN paragraph_index % 30 = 0 ELSE opens END) OR paragraph_index = 0 AS starts,
            (CASE WHEN chunked THEN paragraph_index % 30 = 29 ELSE coalesce(lead(opens) OVER (PARTITION BY doc_id ORDER BY paragraph_index), false) END)
              OR paragraph_index = n_paragraphs - 1 AS ends
            FROM (SELECT *, style_name IS NOT NULL AND paragraph_index > 0 AS opens,
                NOT has_sections AND n_paragraphs > 40 AS chunked FROM t_paras))""",
    "t_sections": f"""SELECT doc_id, section_index, min(paragraph_index) AS start_paragraph, max(paragraph_index) AS end_paragraph,
        arg_min(CASE WHEN style_name IS NOT NULL AND NOT chunked THEN nullif({strip('text')}, '') END, paragraph_index) AS raw_title,
        first(CASE WHEN style_name IS NOT NULL AND NOT chunked THEN nullif({strip('text')}, '') END ORDER BY paragraph_index) AS section_title
        FROM t_sectioned GROUP BY doc_id, section_index""",
    "t_presets": f"SELECT * FROM (VALUES {_preset_rows()}) AS p({', '.join(V.PRESET_FIELDS)})",
    "t_stages": f"SELECT * FROM (VALUES {_stage_rows()}) AS s(status, stage_start, stage_end, stage_label)",
    "t_profiled": """SELECT s.* EXCLUDE (starts, ends, opens), p.preset_no,
        CASE WHEN s.source = 'src0' THEN 'agresiva' ELSE p.intervention_level END AS intervention_level,
        p.max_rewrite_ratio, p.max_expansion_ratio, p.readability_min, p.readability_max, p.disabled_rules,
        CASE WHEN s.key_word <> '' AND NOT list_contains(p.protected_terms, s.key_word) THEN list_append(p.protected_terms, s.key_word) ELSE p.protected_terms END AS protected_terms
        FROM t_sectioned s JOIN t_presets p ON p.preset_no = s.doc_id % 10""",
    "t_typed": f"""SELECT *, {classify('stripped', 'location', 'style_name')} AS paragraph_type
        FROM (SELECT *, {strip('text')} AS stripped FROM t_profiled)""",
    "t_region_hits": _region_hits(),
    "t_region_order": """SELECT *, start_at + length(text) AS end_at,
        row_number() OVER (PARTITION BY doc_id, paragraph_index ORDER BY start_at, length(text) DESC, pat, i) AS seq FROM t_region_hits""",
    "t_regions": """SELECT r.* FROM t_region_order r JOIN t_region_walk w ON w.doc_id = r.doc_id AND w.paragraph_index = r.paragraph_index AND w.seq = r.seq WHERE w.stays""",
    "t_rules": f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(q(x) for x in rule) + ')' for rule in V.EDIT_RULES)}) AS r(rule_id, category, original, replacement, message)",
    "t_matches": f"""SELECT m.*, r.rule_id, r.category, r.replacement,
        m.paragraph_type <> 'cita' AND NOT list_contains(list_concat(m.disabled_rules, {str_list(V.STYLE_RULES_OFF)}, CASE WHEN m.paragraph_type IN ('titulo', 'subtitulo') THEN {str_list(V.TITLE_RULES_OFF)} ELSE [] END), r.rule_id) AS is_on
        FROM (SELECT *, start_at + length(original) AS end_at FROM (SELECT doc_id, paragraph_index, paragraph_type, disabled_rules, i, found[i] AS original, {match_start('found', 'pieces', 'i')} AS start_at
            FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT *, {found('stripped')} AS found, {pieces('stripped')} AS pieces FROM t_typed WHERE length(stripped) >= 3)))) m
        JOIN t_rules r USING (original)""",
    "t_edits_done": """SELECT m.*, g IS NOT NULL AS is_inside, is_on AND g IS NULL AS applied, g.s || ':' || g.e || ':' || g.reason || ':' || m.original AS undone
        FROM (SELECT m.doc_id, m.paragraph_index, m.i, m.original, m.replacement, m.rule_id, m.category, m.start_at, m.end_at, m.is_on,
            arg_max({'s': r.start_at, 'e': r.end_at, 'reason': r.reason}, r.start_at) AS g
            FROM t_matches m LEFT JOIN t_regions r ON r.doc_id = m.doc_id AND r.paragraph_index = m.paragraph_index AND r.start_at < m.end_at AND r.end_at > m.start_at GROUP BY ALL) m""",
    "t_pass0": f"""SELECT t.*, CASE WHEN e.vals IS NULL THEN stripped ELSE {joined(pieces('stripped'), 'e.vals')} END AS pass0_text,
        coalesce(e.rule_hits, 0)::BIGINT AS rule_hits, coalesce(e.reverted, 0)::BIGINT AS reverted, coalesce(e.undone, []) AS undone, coalesce(e.applied, []) AS applied
        FROM t_typed t LEFT JOIN (SELECT doc_id, paragraph_index, list(CASE WHEN applied THEN replacement ELSE original END ORDER BY i) AS vals,
            count(*) FILTER (is_on) AS rule_hits, count(*) FILTER (is_on AND is_inside) AS reverted,
            list(undone ORDER BY i) FILTER (is_on AND is_inside) AS undone, list({{'rule_id': rule_id, 'category': category, 'original': original, 'replacement': replacement}} ORDER BY i) FILTER (applied) AS applied
            FROM t_edits_done GROUP BY ALL) e ON e.doc_id = t.doc_id AND e.paragraph_index = t.paragraph_index WHERE length(stripped) >= 3""",
    "t_moved": """SELECT r.doc_id, r.paragraph_index, r.start_at + coalesce(sum(length(m.replacement) - length(m.original)), 0) AS s, r.start_at + coalesce(sum(length(m.replacement) - length(m.original)), 0) + length(r.text) AS e
        FROM t_regions r LEFT JOIN t_edits_done m ON m.doc_id = r.doc_id AND m.paragraph_index = r.paragraph_index AND m.applied AND m.end_at <= r.start_at
        GROUP BY r.doc_id, r.paragraph_index, r.start_at, r.text""",
    "t_styled": f"""SELECT doc_id, paragraph_index, string_agg(pieces[i] || CASE WHEN i = len(pieces) THEN '' WHEN is_inside THEN w ELSE new END, '' ORDER BY i) AS styled FROM (
        SELECT o.doc_id, o.paragraph_index, o.i, o.pieces, o.w, o.new, count(v.s) > 0 AS is_inside
        FROM (SELECT *, (list_sum(list_transform(pieces[1:i], lambda p: length(p))) + (i - 1) * length(w))::BIGINT AS spot FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS i
            FROM (SELECT doc_id, paragraph_index, w, {one_of('w', triage.STYLE)} AS new, string_split(pass0_text, w) AS pieces
                FROM (SELECT *, {first_of('pass0_text', [a for a, _ in triage.STYLE])} AS w FROM t_routed WHERE route <> 'skip') WHERE w IS NOT NULL))) o
        LEFT JOIN t_moved v ON v.doc_id = o.doc_id AND v.paragraph_index = o.paragraph_index AND v.s < o.spot + length(o.w) AND v.e > o.spot AND o.i < len(o.pieces) GROUP BY ALL) GROUP BY ALL""",
    "t_routed": f"""SELECT * EXCLUDE (rr), split_part(rr, '|', 1) AS route, split_part(rr, '|', 2) AS route_reason
        FROM (SELECT *, {_route_case()} AS rr FROM t_pass0)""",
    "t_candidates": f"""SELECT *, route <> 'skip' AND candidate <> stripped AS gated
        FROM (SELECT *, CASE WHEN route = 'skip' THEN pass0_text WHEN doc_id % 17 = 0 AND paragraph_index % 5 = 0 THEN ''
            WHEN doc_id % 13 = 0 THEN answer || ' ' || left(answer, 40)
            WHEN doc_id % 11 = 0 THEN translate(answer, {q(triage.ACCENTED)}, {q(triage.PLAIN)})
            WHEN doc_id % 7 = 0 AND key_word <> '' THEN replace(answer, key_word, '') ELSE answer END AS candidate
            FROM (SELECT r.*, coalesce(y.styled, r.pass0_text) AS answer FROM t_routed r LEFT JOIN t_styled y ON y.doc_id = r.doc_id AND y.paragraph_index = r.paragraph_index))""",
    "t_measured": f"""SELECT *,
        CASE WHEN gated THEN CASE WHEN stripped = '' OR candidate = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - ({jaccard('stripped', 'candidate')}) END END AS rewrite_ratio,
        CASE WHEN gated THEN {readability('candidate')} END AS score,
        CASE WHEN gated THEN length(candidate)::DOUBLE / length(stripped)::DOUBLE END AS expansion,
        CASE WHEN gated THEN {spanish('stripped')} END AS es_before, CASE WHEN gated THEN {spanish('candidate')} END AS es_after,
        CASE WHEN gated THEN list_filter(protected_terms, lambda t: contains(lower(stripped), lower(t))) END AS checked
        FROM t_candidates""",
    "t_gates": f"""SELECT *,
        {rx('candidate', '[^' + V.SPACE + ']')} AS g_not_empty, expansion <= max_expansion_ratio AS g_expansion,
        rewrite_ratio <= max_rewrite_ratio AS g_rewrite,
        len(list_filter(checked, lambda t: NOT contains(lower(candidate), lower(t)))) = 0 AS g_terms,
        CASE WHEN es_before > {V.SPANISH_RATIO_FLOOR}::DOUBLE THEN es_after / es_before ELSE 1.0::DOUBLE END >= {V.SPANISH_KEPT}::DOUBLE AS g_language,
        score BETWEEN readability_min AND readability_max AS g_readability
        FROM t_measured""",
    "t_proposals": """SELECT *, CASE WHEN review_status = 'gate_rejected' THEN pass0_text ELSE candidate END AS final_text,
        CASE WHEN candidate <> pass0_text AND review_status <> 'gate_rejected' THEN 'languagetool+chatgpt' ELSE 'languagetool' END AS origin,
        (CASE WHEN review_status = 'gate_rejected' THEN pass0_text ELSE candidate END) <> stripped AS changed
        FROM (SELECT *, CASE WHEN NOT gated THEN 'auto_accepted' WHEN NOT (g_not_empty AND g_expansion AND g_terms) THEN 'gate_rejected'
            WHEN NOT (g_rewrite AND g_language AND g_readability) THEN 'manual_review' ELSE 'auto_accepted' END AS review_status FROM t_gates)""",
    "t_patches": f"""SELECT doc_id || '-' || paragraph_index || '-' || position AS patch_id, doc_id, lang, paragraph_index, position, location,
        stripped AS original_text, final_text AS corrected_text, origin AS source, route, review_status, rule_hits, n_paragraphs,
        {page_of('paragraph_index', 'n_paragraphs', 'greatest(1, ceil(n_paragraphs / 10.0))::BIGINT')} AS page_no,
        category, {one_of('category', list(V.SEVERITY_OF.items()))} AS severity, reverted,
        CASE WHEN position = 0 AND category IS NOT NULL THEN 'STYLE' WHEN position > 0 THEN applied[position].rule_id END AS rule_id,
        CASE WHEN position > 0 THEN applied[position].original END AS change_original, CASE WHEN position > 0 THEN applied[position].replacement END AS change_replacement,
        CASE WHEN contains(origin, 'chatgpt') THEN 'model' ELSE 'rules' END AS model_used
        FROM (SELECT *, CASE WHEN contains(origin, 'chatgpt') THEN CASE WHEN position = 0 THEN {q(V.STYLE_CATEGORY)} ELSE applied[position].category END END AS category
            FROM (SELECT *, unnest(range(0, CASE WHEN contains(origin, 'chatgpt') THEN 1 + len(applied) ELSE 1 END)) AS position
            FROM t_proposals WHERE changed))""",
    "t_changes": "SELECT * FROM t_patches WHERE position = 0",
    "t_usage": f"""SELECT doc_id, paragraph_index, route, lang, source, pass_number, prompt_tokens, completion_tokens,
        prompt_tokens + completion_tokens AS total_tokens, {V.PROMPT_E8} * prompt_tokens + {V.COMPLETION_E8} * completion_tokens AS cost_e8,
        CASE WHEN pass_number = 2 THEN 'editorial' ELSE route END AS model_used,
        CASE WHEN pass_number = 2 THEN 'audit_pass2' ELSE 'correction_' || route END AS call_type, stripped AS original_text, pass0_text, final_text
        FROM (SELECT *, (200 + floor(length(pass0_text) / 4.0))::BIGINT AS prompt_tokens, (50 + floor(length(pass0_text) / 4.0))::BIGINT AS completion_tokens,
            unnest(CASE WHEN route = 'editorial' OR coalesce(rewrite_ratio > {V.PASS2_REWRITE}::DOUBLE, false)
              OR (intervention_level IN {in_list(V.PASS2_LEVELS)} AND changed) THEN [1, 2]::BIGINT[] ELSE [1]::BIGINT[] END) AS pass_number
            FROM t_proposals WHERE route <> 'skip')""",
    "t_audit": """SELECT *, CASE WHEN pass_number = 2 THEN 'contextual_audit' ELSE 'mechanical_correction' END AS call_purpose,
        CASE WHEN (doc_id + paragraph_index) % 37 = 0 THEN 'timeout' END AS error_text,
        CASE WHEN pass_number = 2 AND (doc_id + paragraph_index) % 37 <> 0 THEN doc_id % 3 ELSE 0 END AS reversions FROM t_usage""",
    "t_decisions": """SELECT event_id, ts, user_id, event_id % n AS doc_id, (event_id % n) || '-' || (user_id % 5) || '-0' AS patch_id,
        CASE event_type WHEN 'click' THEN 'accepted' WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'edit' WHEN 'signup' THEN 'recorrect' ELSE 'note' END AS action
        FROM events, (SELECT count(*) AS n FROM documents)""",
    "t_status": f"""SELECT doc_id, source, ({str_list(STATUSES)})[(doc_id % 12 + 1)::BIGINT] AS status, total AS stage_total,
        (doc_id % (total + 1))::BIGINT AS stage_current, greatest(1, ceil(total / 10.0))::BIGINT AS total_pages,
        TIMESTAMP '{AS_OF}' AS as_of, TIMESTAMP '{AS_OF}' - to_seconds(doc_id % 300) AS heartbeat_at,
        TIMESTAMP '{AS_OF}' - to_seconds(doc_id % 3600 + 60) AS stage_started_at, TIMESTAMP '{AS_OF}' - to_seconds(doc_id * 60) AS created_at
        FROM (SELECT doc_id, source, len(string_split(text, chr(10)))::BIGINT AS total FROM documents)""",
    "t_pages": """SELECT doc_id, page_no, CASE WHEN (doc_id + page_no) % 9 = 0 THEN 'failed' ELSE 'corrected' END AS status
        FROM (SELECT doc_id, unnest(range(1, total_pages + 1))::BIGINT AS page_no FROM t_status)""",
    "t_checked": f"""SELECT d.*, CASE WHEN p.patch_id IS NULL THEN 'unknown_patch' WHEN NOT coalesce(s.status IN {in_list(V.REVIEWABLE_STATES)}, false) THEN 'bad_state'
        WHEN d.action NOT IN ('accepted', 'rejected') THEN 'bad_action' ELSE 'valid' END AS verdict
        FROM t_decisions d LEFT JOIN t_patches p USING (patch_id) LEFT JOIN t_status s ON s.doc_id = d.doc_id""",
    "t_decided": """SELECT p.* EXCLUDE (review_status), coalesce(d.action, p.review_status) AS review_status,
        CASE WHEN d.action IS NULL THEN 'system' ELSE 'human' END AS decision_source
        FROM t_patches p LEFT JOIN (SELECT patch_id, action FROM t_checked WHERE verdict = 'valid'
            QUALIFY row_number() OVER (PARTITION BY patch_id ORDER BY ts DESC, event_id DESC) = 1) d USING (patch_id)""",
    "t_edits": f"""SELECT *, CASE WHEN status NOT IN {in_list(V.REVIEWABLE_STATES)} THEN 'bad_state'
        WHEN length(edited_text) NOT BETWEEN 1 AND 10000 THEN 'bad_length' WHEN length(edited_text) > length(original_text) * 2 + 100 THEN 'too_long'
        ELSE 'accepted' END AS verdict
        FROM (SELECT d.event_id, d.ts, d.patch_id, p.doc_id, p.original_text, repeat(p.corrected_text, d.event_id % 4) AS edited_text, s.status
            FROM t_decisions d JOIN t_patches p USING (patch_id) JOIN t_status s ON s.doc_id = p.doc_id WHERE d.action = 'edit')""",
    "t_edited": """SELECT p.* EXCLUDE (review_status, decision_source), e.edited_text,
        CASE WHEN e.patch_id IS NULL THEN p.review_status ELSE 'accepted' END AS review_status,
        CASE WHEN e.patch_id IS NULL THEN p.decision_source ELSE 'manual_edit' END AS decision_source
        FROM t_decided p LEFT JOIN (SELECT patch_id, edited_text FROM t_edits WHERE verdict = 'accepted'
            QUALIFY row_number() OVER (PARTITION BY patch_id ORDER BY ts DESC, event_id DESC) = 1) e USING (patch_id)""",
    "t_blocks": f"""SELECT doc_id, {page_of('paragraph_index', 'n_paragraphs', 'greatest(1, ceil(n_paragraphs / 10.0))::BIGINT')} AS page_no,
        paragraph_index AS block_no, CASE WHEN (doc_id + paragraph_index) % 5 = 0 THEN '• ' || text ELSE text END AS block_text FROM t_paras""",
    "t_page_texts": "SELECT doc_id, page_no, string_agg(block_text, chr(10) ORDER BY block_no) AS page_text FROM t_blocks GROUP BY ALL",
    "t_grams": f"""SELECT doc_id, paragraph_index, n, pos, lower(trim(array_to_string(w[pos:pos + n - 1], ' '), {q(V.TERM_EDGE_CHARS)})) AS term
        FROM (SELECT doc_id, paragraph_index, w, n, unnest(range(1, len(w) - n + 2)) AS pos
            FROM (SELECT doc_id, paragraph_index, {tokens(strip('text'))} AS w FROM t_lines), (VALUES (2), (3)) AS k(n))""",
    "t_enough": f"SELECT doc_id FROM t_lines GROUP BY doc_id HAVING sum(len({tokens('text')})) >= 20",
    "t_ranked": f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rk) AS seq FROM (
        SELECT doc_id, term, frequency, first_paragraph, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, fa) AS rk
            FROM (SELECT doc_id, term, count(*) AS frequency, min((paragraph_index, n, pos)) AS fa, min(paragraph_index) AS first_paragraph
                FROM t_grams WHERE length(term) >= 5 GROUP BY doc_id, term)
            WHERE doc_id IN (SELECT doc_id FROM t_enough))
        WHERE rk <= 100 AND frequency >= 3 AND length(term) >= 6""",
    "t_kept": """SELECT doc_id, arg_max(kept, seq) AS kept FROM t_walk GROUP BY doc_id""",
    "t_protected": "SELECT doc_id, any_value(protected_terms) AS protected_terms FROM t_profiled GROUP BY doc_id",
    "t_terms": """SELECT doc_id, term_no, term, frequency, first_paragraph, is_protected FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY grp, ord) - 1 AS term_no FROM (
            SELECT k.doc_id, 0 AS grp, r.seq AS ord, r.term, r.frequency, r.first_paragraph,
                list_contains(list_transform(p.protected_terms, lambda t: lower(t)), r.term) AS is_protected
            FROM t_kept k JOIN t_ranked r ON r.doc_id = k.doc_id AND list_contains(k.kept, r.term) JOIN t_protected p ON p.doc_id = k.doc_id
            UNION ALL
            SELECT p.doc_id, 1, p.ord, p.term, 0, 0, true FROM (SELECT doc_id, unnest(protected_terms) AS term, generate_subscripts(protected_terms, 1) AS ord FROM t_protected) p
            LEFT JOIN t_kept k ON k.doc_id = p.doc_id WHERE p.doc_id IN (SELECT doc_id FROM t_enough) AND NOT coalesce(list_contains(k.kept, lower(p.term)), false)))
        WHERE term_no < 50""",
    "t_term_lists": "SELECT doc_id, list(term ORDER BY term_no) AS terms FROM t_terms GROUP BY doc_id",
    "t_batches": """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::BIGINT AS batch_index, s AS start_paragraph, e AS end_paragraph FROM t_cuts""",
    "t_html": f"""SELECT page_id, (generate_subscripts(ch, 1) - 1)::BIGINT AS paragraph_index, unnest(ch) AS chunk, nav_end, has_nav
        FROM (SELECT page_id, string_split(marked, chr(1)) AS ch, contains(marked, chr(1) || 'nav' || chr(2)) AS has_nav,
            len(string_split(string_split(marked, chr(1) || 'body' || chr(2))[1], chr(1))) AS nav_end
            FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, {q(scan.HTML_NOISE)}, '', 'g'),
                '(?i)<nav\\b[^>]*>', chr(1) || 'nav' || chr(2), 'g'), '(?i)</nav>', chr(1) || 'body' || chr(2), 'g'),
                {q(scan.HTML_OPEN)}, chr(1) || '\\1' || chr(2), 'g') AS marked FROM pages))""",
    "t_html_paras": f"""SELECT page_id, paragraph_index, tag, kind, {html_text('body')} AS text,
        list_filter(list_transform(regexp_extract_all(body, '(?is)<a\\b[^>]*>(.*?)</a>', 1), lambda x: {html_text('x')}), lambda t: t <> '') AS link_texts, len(link_texts) AS links
        FROM (SELECT *, CASE WHEN tag = 'footer' THEN 'footer' WHEN has_nav AND paragraph_index < nav_end THEN 'header' ELSE 'body' END AS kind
            FROM (SELECT *, lower(CASE WHEN contains(chunk, chr(2)) THEN split_part(chunk, chr(2), 1) ELSE '' END) AS tag,
                CASE WHEN contains(chunk, chr(2)) THEN substr(chunk, instr(chunk, chr(2)) + 1) ELSE chunk END AS body FROM t_html))""",
    "t_html_links": "SELECT * FROM t_html_paras WHERE links > 0",
    "t_cells": """SELECT nation AS doc_id, r, c, v[c + 1] AS text, 'table:0:' || r || ':' || c || ':0' AS location FROM (
        SELECT *, unnest([0, 1, 2]::BIGINT[]) AS c FROM (
            SELECT DISTINCT c_nationkey::BIGINT AS nation, 0::BIGINT AS r, ['name', 'segment', 'key'] AS v FROM customer
            UNION ALL SELECT c_nationkey::BIGINT, c_custkey + 1, [c_name, c_mktsegment, c_custkey::VARCHAR] FROM customer))""",
}
RECURSIVE: dict[str, str] = {
    "t_region_walk": """SELECT DISTINCT doc_id, paragraph_index, 0::BIGINT AS seq, -1::BIGINT AS last, false AS stays FROM t_region_order
        UNION ALL
        SELECT w.doc_id, w.paragraph_index, w.seq + 1, CASE WHEN r.start_at >= w.last THEN r.end_at ELSE w.last END, r.start_at >= w.last
        FROM t_region_walk w JOIN t_region_order r ON r.doc_id = w.doc_id AND r.paragraph_index = w.paragraph_index AND r.seq = w.seq + 1""",
    "t_link_walk": """SELECT page_id, paragraph_index, 0::BIGINT AS k, 0::BIGINT AS cursor, 0::BIGINT AS at, '' AS link FROM t_html_links
        UNION ALL
        SELECT page_id, paragraph_index, k, CASE WHEN found_at > 0 THEN cursor + found_at - 1 + length(link) ELSE cursor END, found_at, link
        FROM (SELECT w.page_id, w.paragraph_index, w.k + 1 AS k, w.cursor, p.link_texts[w.k + 1] AS link, instr(substr(p.text, w.cursor + 1), p.link_texts[w.k + 1]) AS found_at
            FROM t_link_walk w JOIN t_html_links p USING (page_id, paragraph_index) WHERE w.k < p.links)""",
    "t_walk": """SELECT doc_id, 0::BIGINT AS seq, []::VARCHAR[] AS kept FROM (SELECT DISTINCT doc_id FROM t_ranked)
        UNION ALL
        SELECT w.doc_id, w.seq + 1, CASE WHEN len(list_filter(w.kept, lambda k: contains(k, r.term) OR contains(r.term, k))) = 0 THEN list_append(w.kept, r.term) ELSE w.kept END
        FROM t_walk w JOIN t_ranked r ON r.doc_id = w.doc_id AND r.seq = w.seq + 1""",
    "t_cuts": """SELECT doc_id, n_paragraphs AS n, 0::BIGINT AS s, (SELECT min(x.end_paragraph) FROM t_sections x WHERE x.doc_id = d.doc_id AND x.end_paragraph >= least(19, d.n_paragraphs - 1)) AS e
        FROM (SELECT DISTINCT doc_id, n_paragraphs FROM t_lines) d
        UNION ALL
        SELECT c.doc_id, c.n, c.e + 1, (SELECT min(x.end_paragraph) FROM t_sections x WHERE x.doc_id = c.doc_id AND x.end_paragraph >= least(c.e + 20, c.n - 1))
        FROM t_cuts c WHERE c.e < c.n - 1""",
}


def with_tables(select: str) -> str:
    """Prefix a statement with the derived tables it needs, in order."""
    every = {**TABLES, **RECURSIVE}
    order: list[str] = []

    def need(sql: str, me: str | None = None) -> None:
        for name in sorted(set(re.findall(r"\bt_[a-z0-9_]+\b", sql))):
            if name in every and name != me and name not in order:
                need(every[name], name)
                order.append(name)

    need(select)
    if not order:
        return select
    recursive = "RECURSIVE " if any(n in RECURSIVE for n in order) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({every[n]})" for n in order) + "\n" + select
