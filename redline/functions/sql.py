"""The text and routing rules as SQL functions; Catalyst inlines them. Registered queries hold them against the column
functions over all paragraphs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from redline import vocab as V


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> None:
    """strip_text(text), readability(text), paragraph_type(text, location, style, in_table), route_of(...)."""
    rx = {n: _quoted(p) for n, p in {
        "strip": V.STRIP, "word": V.WORD, "vowels": V.VOWEL_RUN, "stops": V.SENTENCE_END, "seen": f"[^{V.SPACE}]",
        "dialogue": V.DIALOGUE, "item": V.LIST_ITEM, "numbered": V.CAPTION_NUMBERED, "credit": V.CAPTION_ATTRIBUTION,
        "clause": V.SUBORDINATE,
        "mute": rf"(?<![\p{{L}}\p{{N}}_])[\p{{L}}\p{{N}}_&&[^{V.VOWEL_RUN[1:-2]}]]+(?![\p{{L}}\p{{N}}_])",
    }.items()}
    skip, cheap = (", ".join(f"'{k}'" for k in kinds) for kinds in (V.SKIP_TYPES, V.CHEAP_TYPES))
    statements = [
        f"CREATE OR REPLACE TEMPORARY FUNCTION strip_text(t STRING) RETURNS STRING RETURN regexp_replace(t, {rx['strip']}, '')",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION readability(t STRING) RETURNS DOUBLE RETURN
            CASE WHEN length(regexp_replace(t, {rx['strip']}, '')) < 10 OR regexp_count(t, {rx['word']}) = 0 THEN 0D
            ELSE 206.84D - 60 * ((regexp_count(lower(t), {rx['vowels']}) + regexp_count(lower(t), {rx['mute']})) / regexp_count(t, {rx['word']}))
                - 1.02D * (regexp_count(t, {rx['word']}) / greatest(1, size(filter(split(t, {rx['stops']}, -1), s -> s rlike {rx['seen']})))) END""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION paragraph_type(t STRING, location STRING, style STRING, in_table BOOLEAN) RETURNS STRING RETURN
            CASE WHEN t = '' THEN 'vacio' WHEN location LIKE 'header:%' THEN 'encabezado' WHEN location LIKE 'footer:%' THEN 'footer'
            WHEN in_table OR location LIKE 'table:%' THEN 'celda_tabla'
            WHEN lower(style) rlike 'heading|título|titulo' THEN if(contains(style, '1'), 'titulo', 'subtitulo')
            WHEN lower(style) rlike 'quote|cita' THEN 'cita' WHEN lower(style) rlike 'list' THEN 'lista' WHEN lower(style) rlike 'title' THEN 'titulo'
            WHEN t rlike {rx['dialogue']} THEN 'dialogo' WHEN t rlike {rx['item']} THEN 'lista'
            WHEN lower(t) rlike {rx['numbered']} OR lower(t) rlike {rx['credit']} THEN 'pie_imagen' ELSE 'narrativo' END""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION route_of(t STRING, kind STRING, hits INT, level STRING, transition BOOLEAN, place STRING)
            RETURNS STRUCT<route: STRING, reason: STRING> RETURN
            CASE WHEN kind IN ({skip}) THEN named_struct('route', 'skip', 'reason', concat('type:', kind))
            WHEN kind = 'cita' THEN named_struct('route', 'skip', 'reason', 'quote_preserve')
            WHEN length(strip_text(t)) < 30 AND hits = 0 AND NOT transition THEN named_struct('route', 'skip', 'reason', 'short_clean')
            WHEN transition THEN named_struct('route', 'editorial', 'reason', 'section_transition')
            WHEN place IN ('first', 'last') AND length(strip_text(t)) > 80 THEN named_struct('route', 'editorial', 'reason', concat('section_', place))
            WHEN kind = 'narrativo' AND length(strip_text(t)) > 300 AND regexp_count(strip_text(t), {rx['clause']}) >= 2
                THEN named_struct('route', 'editorial', 'reason', 'complex_syntax')
            WHEN kind = 'dialogo' AND length(strip_text(t)) > 200 THEN named_struct('route', 'editorial', 'reason', 'long_dialogue')
            WHEN coalesce(level, 'moderada') = 'agresiva' AND length(strip_text(t)) > 200 THEN named_struct('route', 'editorial', 'reason', 'aggressive_long')
            WHEN kind IN ({cheap}) THEN named_struct('route', 'cheap', 'reason', concat('type:', kind))
            WHEN coalesce(level, 'moderada') = 'minima' THEN named_struct('route', 'cheap', 'reason', 'minimal_intervention')
            WHEN hits = 0 AND length(strip_text(t)) < 150 THEN named_struct('route', 'cheap', 'reason', 'short_clean_text')
            ELSE named_struct('route', 'cheap', 'reason', 'default') END""",
    ]
    for statement in statements:
        spark.sql(statement)
