"""Quality gates on a proposed correction, and the decision they lead to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redline import vocab as V
from redline.functions.edits import similarity_by
from redline.functions.text import let, readability, spanish_ratio, strip


def _gate(name: str, passed: Column, value: Column, threshold: Column, message: Column, critical: bool) -> Column:
    return F.struct(
        passed.alias("passed"), F.lit(name).alias("gate_name"), value.cast("double").alias("value"),
        threshold.cast("double").alias("threshold"), F.when(passed, F.lit("")).otherwise(message).alias("message"),
        F.lit(critical).alias("critical"),
    )


def _percent(ratio: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f%%", ratio * 100)


def not_empty(corrected: Column) -> Column:
    ok = corrected.rlike(f"[^{V.SPACE}]")
    return _gate("not_empty", ok, F.when(ok, 1.0).otherwise(0.0), F.lit(1.0), F.lit("Texto corregido está vacío"), True)


def expansion(original: Column, corrected: Column, limit: Column, digits: int | None = 4) -> Column:
    ratio = F.when(original == "", F.lit(0.0)).otherwise(F.length(corrected) / F.length(original))
    text = F.concat(F.lit("Expansión "), _percent(ratio, 1), F.lit(" excede máximo "), _percent(limit, 0))
    value = ratio if digits is None else F.round(ratio, digits)
    return _gate("expansion_ratio", ratio <= limit, value, limit, text, True)


def rewrite_ratio(original: Column, corrected: Column, metric: str = "difflib", digits: int | None = 4) -> Column:
    """1 - similarity; 0 when a side is empty."""
    ratio = F.lit(1.0) - similarity_by(metric, original, corrected)
    ratio = ratio if digits is None else F.round(ratio, digits)
    return F.when((original == "") | (corrected == ""), F.lit(0.0)).otherwise(ratio)


def rewrite(ratio: Column, limit: Column) -> Column:
    text = F.concat(F.lit("Reescritura "), _percent(ratio, 1), F.lit(" excede máximo "), _percent(limit, 0))
    return _gate("rewrite_ratio", ratio <= limit, ratio, limit, text, False)


def protected_terms(original: Column, corrected: Column, terms: Column, digits: int | None = 4) -> Column:
    """Each text is lower-cased once, however many terms there are."""

    def told(low: Column) -> Column:
        checked = F.filter(terms, lambda t: (strip(t) != "") & F.contains(low["o"], strip(F.lower(t))))
        return let(checked, lambda c: F.struct(
            F.size(c).alias("n"), F.filter(c, lambda t: ~F.contains(low["c"], strip(F.lower(t)))).alias("missing"),
        ))

    def gate(s: Column) -> Column:
        value = F.when(s["n"] == 0, F.lit(1.0)).otherwise((s["n"] - F.size(s["missing"])) / s["n"])
        value = value if digits is None else F.round(value, digits)
        text = F.concat(F.lit("Términos protegidos eliminados: "), F.array_join(s["missing"], ", "))
        return _gate("protected_terms", F.size(s["missing"]) == 0, value, F.lit(1.0), text, True)

    return let(let(F.struct(F.lower(original).alias("o"), F.lower(corrected).alias("c")), told), gate)


def language(original: Column, corrected: Column, digits: int | None = 4) -> Column:
    def gate(kept: Column) -> Column:
        value = kept if digits is None else F.round(kept, digits)
        return _gate(
            "language_preserved", kept >= V.SPANISH_KEPT, value, F.lit(V.SPANISH_KEPT),
            F.lit("Posible cambio de idioma detectado"), False,
        )

    after = spanish_ratio(corrected)
    return let(let(spanish_ratio(original), lambda before: F.when(before > V.SPANISH_RATIO_FLOOR, after / before).otherwise(F.lit(1.0))), gate)


def readability_range(score: Column, low: Column, high: Column) -> Column:
    low, high = F.coalesce(low, F.lit(-999)), F.coalesce(high, F.lit(999))
    text = F.concat(
        F.lit("Legibilidad "), F.format_string("%.1f", score), F.lit(" fuera de rango ["), low.cast("string"),
        F.lit(", "), high.cast("string"), F.lit("]"),
    )
    return _gate("readability_fh", score.between(low, high), score, low, text, False)


def run_gates(
    original: Column, corrected: Column, max_expansion: Column, max_rewrite: Column, terms: Column, ratio: Column,
    low: Column | None = None, high: Column | None = None, score: Column | None = None, rounded: bool = True,
) -> Column:
    """All gates as an array of structs. ``ratio`` is rewrite_ratio() and ``score`` readability(), each computed
    once by the caller.

    The readability gate is present only where a target range is set.
    """
    four = 4 if rounded else None
    items = [
        not_empty(corrected),
        expansion(original, corrected, F.coalesce(max_expansion, F.lit(V.MAX_EXPANSION)), four),
        rewrite(ratio, F.coalesce(max_rewrite, F.lit(V.MAX_REWRITE))),
        protected_terms(original, corrected, F.coalesce(terms, F.array().cast("array<string>")), four),
        language(original, corrected, four),
    ]
    if low is not None and high is not None:
        score = readability(corrected) if score is None else score
        items.append(F.when(low.isNotNull() | high.isNotNull(), readability_range(score, low, high)))
    return F.array_compact(F.array(*items))


def disposition(gates: Column) -> Column:
    """struct(status, reason): a critical failure rejects, another failure asks for a person."""
    critical = F.filter(gates, lambda g: ~g["passed"] & g["critical"])
    soft = F.filter(gates, lambda g: ~g["passed"] & ~g["critical"])

    def reasons(failed: Column) -> Column:
        return F.array_join(F.transform(failed, lambda g: g["message"]), "; ")

    return F.struct(
        F.when(F.size(critical) > 0, "gate_rejected").when(F.size(soft) > 0, "manual_review")
        .otherwise("auto_accepted").alias("status"),
        F.when(F.size(critical) > 0, reasons(critical)).when(F.size(soft) > 0, reasons(soft)).alias("reason"),
    )
