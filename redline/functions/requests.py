"""Correction requests and responses as columns: the text sent out and the JSON that comes back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redline import vocab as V
from redline.functions.text import one_of, preview

RESPONSE = (
    "struct<action:string,corrected_text:string,changes:array<struct<original_fragment:string,"
    "corrected_fragment:string,category:string,severity:string,explanation:string>>,confidence:double,"
    "rewrite_ratio:double>"
)
AUDIT_RESPONSE = (
    "struct<final_text:string,reverted_destructions:array<struct<original_term:string,pass1_changed_to:string,"
    "reason:string,severity:string>>,style_improvements:array<struct<original_fragment:string,"
    "improved_fragment:string,category:string,explanation:string>>,confidence:double,pass1_quality:string>"
)


def parse_response(content: Column, max_length: Column) -> Column:
    """JSON → struct; an answer over the length limit becomes ``skip``; unreadable JSON gives a null action."""
    parsed = F.from_json(content, RESPONSE)
    too_long = F.length(F.coalesce(parsed["corrected_text"], F.lit(""))) > max_length
    changes = "array<struct<original_fragment:string,corrected_fragment:string,category:string,severity:string,explanation:string>>"
    return F.struct(
        F.when(too_long, F.lit("skip")).otherwise(parsed["action"]).alias("action"),
        F.when(too_long, F.lit("")).otherwise(parsed["corrected_text"]).alias("corrected_text"),
        F.when(too_long, F.array().cast(changes)).otherwise(parsed["changes"]).alias("changes"),
        parsed["confidence"].alias("confidence"),
        parsed["rewrite_ratio"].alias("rewrite_ratio"),
    )


def _line(label: str, value: Column) -> Column:
    """A labelled line, or null (dropped by concat_ws) when the value is null or empty."""
    return F.when(value != "", F.concat(F.lit(label), value))


def _joined(items: Column) -> Column:
    return F.array_join(items, ", ")


def profile_block(p: Column) -> Column:
    """``p`` is a profile struct, or null for the generic block."""
    head = F.concat(
        F.lit("PERFIL: "), p["register"], F.lit(" | Intervención: "), p["intervention_level"],
        F.lit(" | Audiencia: "), p["audience_type"], F.lit(" ("), p["audience_expertise"], F.lit(") | Tono: "), p["tone"],
    )
    block = F.concat_ws(
        "\n",
        head,
        F.when(p["preserve_author_voice"], "PRESERVAR VOZ DEL AUTOR: sí"),
        F.concat(F.lit("MAX REESCRITURA: "), F.floor(p["max_rewrite_ratio"] * 100).cast("string"), F.lit("%")),
        _line("PRIORIDADES: ", _joined(p["style_priorities"])),
        _line("PROTEGER TÉRMINOS: ", _joined(p["protected_terms"])),
    )
    return F.when(p.isNull(), F.lit(V.NO_PROFILE)).otherwise(block)


def structure_block(
    paragraph_type: Column, section: Column, terms: Column, page_no: Column, total_pages: Column,
    has_page_break: Column, table: Column | None, next_type: Column,
) -> Column:
    """Where the paragraph stands. ``table`` is struct(header_row, num_cols, col_index) or None."""
    hint = F.coalesce(one_of(paragraph_type, V.TYPE_HINTS), paragraph_type)
    page = F.concat(F.lit("PÁGINA: "), page_no.cast("string"))
    lines = [
        _line("TIPO: ", hint),
        _line("SECCIÓN: ", F.left(section, F.lit(120))),
        _line("TÉRMINOS ACTIVOS: ", _joined(F.slice(terms, 1, 12))),
        F.when(
            page_no > 0,
            F.when(total_pages > 0, F.concat(page, F.lit(" de "), total_pages.cast("string"))).otherwise(page),
        ),
        F.when(has_page_break, V.PAGE_BREAK_NOTE),
    ]
    if table is not None:
        header = F.coalesce(F.get(table["header_row"], table["col_index"]), F.lit(""))
        cols = table["num_cols"].cast("string")
        named = F.concat(F.lit("TABLA: columna '"), header, F.lit("' de "), cols, F.lit(" columnas"))
        plain = F.concat(F.lit("TABLA: "), cols, F.lit(" columnas"))
        lines.append(F.when(paragraph_type == "celda_tabla", F.when(header != "", named).otherwise(plain)))
    lines.append(F.concat(F.lit("SIGUIENTE: "), one_of(next_type, V.NEXT_HINTS)))
    body = F.concat_ws("\n", *lines)
    return F.when(body != "", F.concat(F.lit(V.HEAD_STRUCTURE + "\n"), body))


def context_block(prev_text: Column, prev_type: Column, abrupt: Column, kind: Column) -> Column:
    head = F.concat(
        F.lit("\n── CONTEXTO PREVIO"),
        F.when(prev_type != "", F.concat(F.lit(" ["), prev_type, F.lit("]"))).otherwise(""),
        F.when(~kind.isin("body", ""), F.concat(F.lit(" en "), kind)).otherwise(""),
        F.when(abrupt, " ⚠ continúa (termina sin punto)").otherwise(""),
        F.lit(" ──\n"),
    )
    return F.when(prev_text.isNull(), F.lit("\n── CONTEXTO PREVIO ──\nInicio de documento")).otherwise(
        F.concat(head, preview(prev_text, 350))
    )


def request_text(profile: Column, structure: Column, context: Column, text: Column, regions: Column) -> Column:
    """Blocks in fixed order; absent blocks drop out."""
    return F.concat_ws(
        "\n", profile, structure, context, F.concat(F.lit(V.HEAD_TEXT), text), F.concat(F.lit("\n"), regions)
    )


def global_block(g: Column) -> Column:
    """Document-wide context; ``g`` is struct(global_summary, dominant_voice, dominant_register,
    protected_globals array<struct<term>>, avg_sentence_length, passive_voice_ratio) or null."""
    terms = F.filter(F.transform(g["protected_globals"], lambda p: p["term"]), lambda t: t != "")
    style = F.concat_ws(
        ", ",
        F.when(g["avg_sentence_length"] != 0, F.concat(F.lit("oraciones de ~"), g["avg_sentence_length"].cast("string"), F.lit(" palabras"))),
        F.concat(F.floor(g["passive_voice_ratio"] * 100).cast("string"), F.lit("% voz pasiva")),
    )
    body = F.concat_ws(
        "\n",
        F.lit(V.GLOBAL_HEAD),
        _line("TEMA PRINCIPAL: ", F.left(g["global_summary"], F.lit(300))),
        _line("VOZ DEL AUTOR: ", F.left(g["dominant_voice"], F.lit(150))),
        F.when(
            g["dominant_register"] != "",
            F.concat(F.lit("REGISTRO BASE: "), g["dominant_register"], F.lit(" (no alterar a otro registro)")),
        ),
        _line("TÉRMINOS TÉCNICOS PROTEGIDOS GLOBALMENTE: ", _joined(terms)),
        _line("ESTILO DOMINANTE: ", style),
        F.lit(V.GLOBAL_FOOT),
    )
    return F.when(g.isNotNull(), body)


def audit_request_text(
    global_context: Column, window: Column, paragraph_type: Column, location: Column, original: Column, pass1: Column
) -> Column:
    """Second-pass request; ``window`` holds the texts before this one, oldest first (the last three are used)."""
    last = F.slice(window, F.greatest(F.size(window) - 2, F.lit(1)), F.lit(3))
    lines = F.transform(
        last, lambda t, i: F.concat(F.lit("  ["), (i + 1).cast("string"), F.lit("] "), F.left(t, F.lit(200)))
    )
    return F.concat_ws(
        "\n",
        global_context,
        F.when(
            F.size(last) > 0,
            F.concat(F.lit("── CONTEXTO PREVIO (párrafos ya auditados) ──\n"), F.array_join(lines, "\n")),
        ),
        _line("TIPO DE PÁRRAFO: ", paragraph_type),
        _line("UBICACIÓN: ", location),
        F.concat(F.lit("\n── TEXTO ORIGINAL ──\n"), original),
        F.concat(F.lit("\n── CORRECCIÓN MECÁNICA (Pasada 1) ──\n"), pass1),
        F.lit(V.AUDIT_INSTRUCTION),
    )
