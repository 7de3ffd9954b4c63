"""Scalar text functions over one paragraph."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from redline import vocab as V


def one_of(column: Column, pairs: list[tuple[str, str]]) -> Column:
    """CASE over a fixed list of (value, result); null when nothing matches."""
    out = None
    for value, result in pairs:
        test = column == value
        out = F.when(test, result) if out is None else out.when(test, result)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: The characters of V.SPACE. Trimming a set of characters reads a text's ends; the pattern tries every white space in it.
BLANKS = "".join(chr(c) for c in range(0x3001) if re.fullmatch(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{m[1]:0>4}", V.WS), chr(c)))


#: A run without white space, for Java's patterns: they try a class part by part, so printable ASCII comes first.
SOLID = f"[!-~[^{V.SPACE}]]+"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def normalise(text: Column) -> Column:
    """Lower case, stripped, inner white space collapsed: the form used for matching."""
    return F.regexp_replace(strip(F.lower(text)), f"{V.WS}+", " ")


def preview(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def tokens(text: Column) -> Column:
    """White-space separated words, no empty ones."""
    return F.regexp_extract_all(text, F.lit(SOLID), 0)


def contains_any(text: Column, literals: list[str]) -> Column:
    """Does one of a few literals occur? Each is looked for by bytes, which a pattern of them all is not."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(part)) for part in literals])


#: How a caption begins, told from this many characters, so that other texts are not lower-cased.
CAPTION_START, CAPTION_WORD = "^(?:fig|tabla|cuadro|imagen|gr[aá]fico|mapa|esquema|diagrama|fuente|nota|elaboraci)", 12


def classify(stripped: Column, location: Column, style_name: Column, is_in_table: Column, terms: Column | None = None) -> Column:
    """Paragraph type: first rule that holds. ``terms`` is the document's glossary (array of strings) or None."""
    style = F.lower(style_name)
    lowered = F.lower(stripped)
    caption = F.lower(F.when(F.lower(F.left(stripped, F.lit(CAPTION_WORD))).rlike(CAPTION_START), stripped))
    rules = (
        F.when(stripped == "", "vacio")
        .when(location.startswith("header:"), "encabezado")
        .when(location.startswith("footer:"), "footer")
        .when(is_in_table | location.startswith("table:"), "celda_tabla")
        .when(style.rlike("heading|título|titulo") & style.contains("1"), "titulo")
        .when(style.rlike("heading|título|titulo"), "subtitulo")
        .when(style.rlike("quote|cita"), "cita")
        .when(style.rlike("list|lista"), "lista")
        .when(style.contains("title"), "titulo")
        .when(stripped.rlike(V.DIALOGUE), "dialogo")
        .when(stripped.rlike(V.LIST_ITEM), "lista")
        .when(caption.rlike(V.CAPTION_NUMBERED) | caption.rlike(V.CAPTION_ATTRIBUTION), "pie_imagen")
    )
    if terms is not None:
        hits = F.size(F.filter(terms, lambda t: F.contains(lowered, F.lower(t))))
        rules = rules.when(
            (F.size(terms) > 0) & (hits / F.size(tokens(stripped)) > V.TERM_DENSITY), "explicacion_tecnica"
        )
    return rules.otherwise("narrativo")


def requires_model(paragraph_type: Column) -> Column:
    return ~paragraph_type.isin(V.NO_MODEL_TYPES)


def type_or_fallback(paragraph_type: Column, location: Column) -> Column:
    """The classified type, or what the location alone says when there is no classification."""
    return F.coalesce(
        paragraph_type,
        F.when(location.startswith("header:"), "encabezado")
        .when(location.startswith("footer:"), "footer")
        .when(location.startswith("table:"), "celda_tabla"),
    )


def is_heading(style_name: Column) -> Column:
    """One heading test shared by classification and section detection."""
    return F.coalesce(F.lower(style_name).rlike("heading|título|titulo|title"), F.lit(False))


def sentence_count(text: Column) -> Column:
    parts = F.filter(F.split(text, V.SENTENCE_END, -1), lambda s: s.rlike(f"[^{V.SPACE}]"))
    return F.greatest(F.lit(1), F.size(parts))


def word_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(V.WORD)))


def syllable_count(text: Column) -> Column:
    """Vowel runs, at least one per word: runs never cross words, so words without a vowel are counted apart, as all words
    less those that have a part from a vowel on."""
    voiced = V.VOWEL_RUN[:-1] + V.WORD[:-1] + "*"
    return let(F.lower(text), lambda low: F.regexp_count(low, F.lit(V.VOWEL_RUN)) + F.regexp_count(low, F.lit(V.WORD)) - F.regexp_count(low, F.lit(voiced)))


def readability(text: Column, digits: int | None = 2) -> Column:
    """206.84 - 60 * syllables/words - 1.02 * words/sentences; 0 for texts under ten characters."""
    parts = F.struct(
        F.regexp_count(text, F.lit(V.WORD)).alias("words"), syllable_count(text).alias("syllables"),
        sentence_count(text).alias("sentences"),
    )

    def formula(p: Column) -> Column:
        score = F.lit(206.84) - F.lit(60) * (p["syllables"] / p["words"]) - F.lit(1.02) * (p["words"] / p["sentences"])
        score = score if digits is None else F.round(score, digits)
        return F.when(p["words"] == 0, F.lit(0.0)).otherwise(score)

    return F.when(F.length(strip(text)) < 10, F.lit(0.0)).otherwise(let(parts, formula))


def readability_band(score: Column) -> Column:
    return (
        F.when(score > 80, "muy_facil")
        .when(score >= 60, "facil")
        .when(score >= 40, "normal")
        .when(score >= 20, "dificil")
        .otherwise("muy_dificil")
    )


def spanish_ratio(text: Column) -> Column:
    return F.regexp_count(text, F.lit(V.SPANISH_CHAR)) / F.greatest(F.length(text), F.lit(1))


def subordinate_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(V.SUBORDINATE))


def ends_abruptly(text: Column) -> Column:
    return (text != "") & (F.instr(F.lit(V.SENTENCE_CLOSERS), F.right(text, F.lit(1))) == 0)


def word_diff(original: Column, corrected: Column) -> Column:
    """Token i against token i, separators included: counts of tokens that differ on each side."""

    def changed(left: Column, right: Column, side: int) -> Column:
        flags = F.zip_with(
            left,
            right,
            lambda a, b: (F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit("")))
            & (F.coalesce(a if side == 0 else b, F.lit("")) != ""),
        )
        return F.size(F.filter(flags, lambda f: f))

    gap = f"{V.WS}+"
    ow, cw = F.split(original, gap, -1), F.split(corrected, gap, -1)
    og, cg = F.regexp_extract_all(original, F.lit(gap), 0), F.regexp_extract_all(corrected, F.lit(gap), 0)
    return F.struct(
        (changed(ow, cw, 0) + changed(og, cg, 0)).alias("original_changed"),
        (changed(ow, cw, 1) + changed(og, cg, 1)).alias("corrected_changed"),
    )


def cost_e8(prompt_tokens: Column, completion_tokens: Column) -> Column:
    """Call cost in 1e-8 USD: an exact integer, so sums do not depend on order."""
    return prompt_tokens * V.PROMPT_E8 + completion_tokens * V.COMPLETION_E8


def usd(e8: Column) -> Column:
    return (e8.cast("decimal(28,0)") / F.lit(100000000).cast("decimal(10,0)")).cast("decimal(18,8)")


def location_parts(location: Column) -> Column:
    """``kind:i0:i1...`` → struct(kind, i0..i3); the same field names for body, table, header and footer."""
    parts = F.split(location, ":", -1)
    fields = [F.get(parts, F.lit(0)).alias("kind")]
    fields += [F.get(parts, F.lit(i + 1)).cast("int").alias(f"i{i}") for i in range(4)]
    return F.struct(*fields)


def location_text(parts: Column) -> Column:
    """Inverse of location_parts; absent fields are dropped."""
    return F.concat_ws(":", parts["kind"], *[parts[f"i{i}"].cast("string") for i in range(4)])


def split_at_fraction(text: Column, fraction: Column) -> Column:
    """Cut a text in two at ``fraction`` of its length, moved left to a space less than 30 characters away."""
    size = F.length(text)
    cut = F.greatest(F.lit(0), F.least(F.floor(size * fraction).cast("int"), size))
    back = F.instr(F.reverse(F.left(text, cut + 1)), " ")
    space = F.when(back > 0, cut + 1 - back).otherwise(-1)
    place = F.when((cut > 0) & (cut < size) & (space > cut - 30), space + 1).otherwise(cut)
    return F.struct(
        F.regexp_replace(F.left(text, place), f"{V.WS}+$", "").alias("before"),
        F.regexp_replace(F.substring(text, place + 1, size), f"^{V.WS}+", "").alias("after"),
        place.alias("cut"),
    )
