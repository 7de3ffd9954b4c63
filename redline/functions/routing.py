"""Which correction path a paragraph takes, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redline import vocab as V
from redline.functions.text import strip, subordinate_count


def route(text: Column, paragraph_type: Column, hits: Column, level: Column, transition: Column, position: Column) -> Column:
    """struct(route, reason); the order of the rules is the priority. Lengths and clauses are those of the stripped text."""
    stripped = strip(text)
    size = F.length(stripped)
    level = F.coalesce(level, F.lit("moderada"))

    def pick(name: str, reason: Column | str) -> Column:
        return F.struct(F.lit(name).alias("route"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    by_type = F.concat(F.lit("type:"), paragraph_type)
    return (
        F.when(paragraph_type.isin(V.SKIP_TYPES), pick("skip", by_type))
        .when(paragraph_type == "cita", pick("skip", "quote_preserve"))
        .when((size < 30) & (hits == 0) & ~transition, pick("skip", "short_clean"))
        .when(transition, pick("editorial", "section_transition"))
        .when(position.isin("first", "last") & (size > 80), pick("editorial", F.concat(F.lit("section_"), position)))
        .when(
            (paragraph_type == "narrativo") & (size > 300) & (subordinate_count(stripped) >= 2),
            pick("editorial", "complex_syntax"),
        )
        .when((paragraph_type == "dialogo") & (size > 200), pick("editorial", "long_dialogue"))
        .when((level == "agresiva") & (size > 200), pick("editorial", "aggressive_long"))
        .when(paragraph_type.isin(V.CHEAP_TYPES), pick("cheap", by_type))
        .when(level == "minima", pick("cheap", "minimal_intervention"))
        .when((hits == 0) & (size < 150), pick("cheap", "short_clean_text"))
        .otherwise(pick("cheap", "default"))
    )


def engines(paragraph_type: Column, base_rules: Column) -> Column:
    """Which engine may touch a paragraph of this type, and the rules switched off for it."""
    title = paragraph_type.isin("titulo", "subtitulo")
    rules = F.array_union(base_rules, F.array(*[F.lit(r) for r in V.STYLE_RULES_OFF]))
    more = F.array_union(rules, F.array(*[F.lit(r) for r in V.TITLE_RULES_OFF]))
    return F.struct(
        (paragraph_type != "cita").alias("apply_rules"),
        (~(title | paragraph_type.isin("cita", "encabezado", "footer"))).alias("apply_model"),
        F.when(title, more).otherwise(rules).alias("disabled_rules"),
        F.when(paragraph_type == "cita", "cita_textual").alias("skip_reason"),
    )


def second_pass(route_taken: Column, rewrite: Column, level: Column, changed: Column) -> Column:
    return (
        (route_taken == "editorial")
        | F.coalesce(rewrite > V.PASS2_REWRITE, F.lit(False))
        | F.coalesce(level.isin(V.PASS2_LEVELS) & changed, F.lit(False))
    )


def token_budget(route_taken: Column) -> Column:
    return F.when(route_taken == "editorial", V.MAX_TOKENS["editorial"]).when(route_taken == "cheap", V.MAX_TOKENS["cheap"])


def dispatch(action: Column, answer: Column, pass0: Column) -> Column:
    """The model's text when it says ``correct`` and differs; in every other case the rule-corrected text."""
    return F.when((action == "correct") & (F.coalesce(answer, F.lit("")) != ""), answer).otherwise(pass0)
