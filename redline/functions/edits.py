"""Rule tables, edit operations, diffs and link ranges."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redline import vocab as V
from redline.functions import arrays
from redline.functions.protect import no_regions, spans
from redline.functions.text import contains_any, let, tokens

EDIT = "struct<offset:int,length:int,original:string,replacement:string,rule_id:string,category:string,message:string>"


def replace_chain(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Ordered literal replacements, each on the result of the one before."""
    out = text
    for wrong, right in pairs:
        if wrong != right:
            out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


FIXED = f"struct<text:string,ops:array<{EDIT}>,reverted:array<struct<region_start:int,region_end:int,reason:string,had:string,restored:string>>>"


def quoted(text: str) -> str:
    """A literal as a pattern that Java and RE2 read alike."""
    return "".join(c if c.isalnum() or c == " " else f"[{c}]" for c in text)


def any_of(rules: list[tuple]) -> str:
    return "|".join(quoted(rule[2]) for rule in rules)


def literals(rules: list[tuple]) -> list[str]:
    return [rule[2] for rule in rules]


def leading(rules: list[tuple]) -> str:
    """``any_of`` for Java only, tried just where one of the literals can begin."""
    first = "".join(c if c.isalnum() else f"\\{c}" for c in sorted({rule[2][0] for rule in rules}))
    return f"(?=[{first}])(?:{any_of(rules)})"


def found_edits(text: Column, rules: list[tuple] = V.EDIT_RULES) -> Column:
    """Every match of the rules as ``array<EDIT>``, from the left; matches don't overlap."""
    fields = ["rule_id", "category", "original", "replacement", "message"]
    table = F.create_map(*[x for rule in rules for x in (
        F.lit(rule[2]), F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, rule)])
    )])
    return F.transform(spans(text, F.lit(leading(rules)), "rule"), lambda m: let(F.element_at(table, m["text"]), lambda r: F.struct(
        m["start"].alias("offset"), (m["end"] - m["start"]).alias("length"), r["original"].alias("original"),
        r["replacement"].alias("replacement"), r["rule_id"].alias("rule_id"), r["category"].alias("category"), r["message"].alias("message"),
    ))).cast(f"array<{EDIT}>")


def as_spans(ops: Column) -> Column:
    return F.transform(ops, lambda e: F.struct(e["offset"].alias("start"), (e["offset"] + e["length"]).alias("end")))


def fix(text: Column, rules: list[tuple] = V.EDIT_RULES, off: Column | None = None, regions: Column | None = None) -> Column:
    """``FIXED``: the text with the rules' edits put in, but for those that touch a protected region; all edits; and what was
    undone, one entry for each such edit, with the region it touches. Edits stand by position, the pieces between them are
    joined once, and nothing is looked up in the text again. A rule that is switched off makes no edits, but what it matches
    is still its own."""
    regions = no_regions() if regions is None else regions
    off = F.array().cast("array<string>") if off is None else off

    def done(s: Column) -> Column:
        value = lambda x, i: F.concat(F.get(s["pieces"], i), F.when(x["on"] & (x["at"] < 0), x["e"]["replacement"]).otherwise(x["e"]["original"]))
        undone = F.transform(F.filter(s["each"], lambda x: x["on"] & (x["at"] >= 0)), lambda x: let(F.get(s["regions"], x["at"]), lambda r: F.struct(
            r["start"].alias("region_start"), r["end"].alias("region_end"), r["reason"].alias("reason"),
            x["e"]["replacement"].alias("had"), x["e"]["original"].alias("restored"),
        )))
        return F.struct(
            F.concat(F.array_join(F.transform(s["each"], value), ""), F.element_at(s["pieces"], -1)).alias("text"),
            F.transform(F.filter(s["each"], lambda x: x["on"]), lambda x: x["e"]).alias("ops"), undone.alias("reverted"),
        )

    def placed(s: Column) -> Column:
        marks = F.arrays_zip(s["found"].alias("e"), arrays.touching(as_spans(s["found"]), s["regions"]).alias("at"))
        each = F.transform(marks, lambda x: F.struct(x["e"].alias("e"), x["at"].alias("at"), (~F.array_contains(off, x["e"]["rule_id"])).alias("on")))
        return let(F.struct(each.alias("each"), F.split(text, leading(rules), -1).alias("pieces"), s["regions"].alias("regions")), done)

    whole = let(F.struct(found_edits(text, rules).alias("found"), regions.alias("regions")), placed).cast(FIXED)
    none = F.struct(text.alias("text"), F.array().alias("ops"), F.array().alias("reverted")).cast(FIXED)
    return F.when(contains_any(text, literals(rules)), whole).otherwise(none)


def applied(ops: Column, regions: Column) -> Column:
    """The edits that touch no region."""
    return let(
        F.arrays_zip(ops.alias("e"), arrays.touching(as_spans(ops), regions).alias("at")),
        lambda z: F.transform(F.filter(z, lambda x: x["at"] < 0), lambda x: x["e"]),
    )


def moved(regions: Column, ops: Column) -> Column:
    """Regions of a text as they stand after edits that touch none of them: each moves by what the edits before it add."""

    def among(both: Column) -> Column:
        regions, ops = both["regions"], both["ops"]
        before = F.transform(ops, lambda e: F.struct(
            (e["offset"] + e["length"]).alias("at"), F.lit(0).alias("kind"), (F.length(e["replacement"]) - e["length"]).alias("by"), F.lit(-1).alias("i"),
        ))
        asked = F.transform(regions, lambda r, i: F.struct(r["start"].alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("by"), i.alias("i")))

        def shifted(e: Column) -> Column:
            sums = F.arrays_zip(e.alias("e"), arrays.running_sum(F.transform(e, lambda x: x["by"])).alias("by"))
            return F.transform(F.filter(sums, lambda x: x["e"]["kind"] == 1), lambda x: let(F.get(regions, x["e"]["i"]), lambda r: F.struct(
                (r["start"] + x["by"]).alias("start"), (r["end"] + x["by"]).alias("end"), r["reason"].alias("reason"), r["text"].alias("text"),
            )))

        return let(F.sort_array(F.concat(before, asked)), shifted)

    return F.when((F.size(ops) == 0) | (F.size(regions) == 0), regions).otherwise(let(F.struct(regions.alias("regions"), ops.alias("ops")), among))


def style_fix(text: Column, pairs: list[tuple[str, str]], regions: Column) -> Column:
    """The first pair that occurs in the text is applied, everywhere but in the regions (positions in this text)."""
    chosen = None
    for wrong, right in pairs:
        test, pair = F.contains(text, F.lit(wrong)), F.struct(F.lit(wrong).alias("wrong"), F.lit(quoted(wrong)).alias("pattern"), F.lit(right).alias("right"))
        chosen = F.when(test, pair) if chosen is None else chosen.when(test, pair)

    def joined(s: Column) -> Column:
        value = lambda at, i: F.concat(F.get(s["pieces"], i), F.when(at < 0, s["right"]).otherwise(s["wrong"]))
        return F.concat(F.array_join(F.transform(s["at"], value), ""), F.element_at(s["pieces"], -1))

    def careful(p: Column) -> Column:
        at = arrays.touching(spans(text, p["pattern"], "style"), regions)
        return let(F.struct(at.alias("at"), F.split(text, p["pattern"], -1).alias("pieces"), p["wrong"].alias("wrong"), p["right"].alias("right")), joined)

    return let(chosen, lambda p: F.when(p.isNull(), text).when(
        F.size(regions) == 0, F.replace(text, p["wrong"], p["right"])
    ).otherwise(careful(p)))


def first_hit(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Only the first matching pair is applied."""
    out = None
    for wrong, right in pairs:
        test, value = F.contains(text, F.lit(wrong)), F.replace(text, F.lit(wrong), F.lit(right))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(text)


def apply_edits(text: Column, edits: Column) -> Column:
    """Apply ``array<EDIT>`` from the right, so that earlier offsets stay valid."""
    return F.aggregate(
        F.sort_array(edits, asc=False),
        text,
        lambda t, e: F.concat(
            F.left(t, e["offset"]), e["replacement"], F.substring(t, e["offset"] + e["length"] + 1, F.length(t))
        ),
    )


@F.pandas_udf(T.DoubleType())
def similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio with the popularity heuristic on, as in the standard library."""
    for left, right in pairs:
        yield pd.Series([
            None if a is None or b is None else 1.0 if a == b else SequenceMatcher(None, a, b).ratio()
            for a, b in zip(left, right)
        ], dtype="float64")


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def set_jaccard(left: Column, right: Column) -> Column:
    """Share of two word sets in common; 1 when both are empty."""

    def ratio(s: Column) -> Column:
        return let(F.size(F.array_intersect(s["a"], s["b"])), lambda common: F.when(
            F.size(s["a"]) + F.size(s["b"]) == 0, F.lit(1.0)
        ).otherwise(common / (F.size(s["a"]) + F.size(s["b"]) - common)))

    return let(F.struct(left.alias("a"), right.alias("b")), ratio)


def token_jaccard(left: Column, right: Column) -> Column:
    """Share of distinct words in common. Native, linear in the text."""
    return set_jaccard(token_set(left), token_set(right))


# Similarity metrics as (form to compute once per text, comparison of two forms).
METRICS = {"difflib": (lambda text: text, similarity), "jaccard": (token_set, set_jaccard)}


def similarity_by(metric: str, left: Column, right: Column) -> Column:
    form, compare = METRICS[metric]
    return compare(form(left), form(right))


def link_ranges(text: Column, links: Column) -> Column:
    """Place each link text left to right with a moving cursor: array<struct<start,end>>. The places are written to one
    string on the way, which costs bytes where a growing array would cost its elements each time."""

    def place(acc: Column, link: Column) -> Column:
        at = F.position(link, text, acc["cursor"] + 1)

        def placed(a: Column) -> Column:
            end = a - 1 + F.length(link)
            return F.struct(end.alias("cursor"), F.concat(acc["out"], (a - 1).cast("string"), F.lit(":"), end.cast("string"), F.lit(" ")).alias("out"))

        return let(at, lambda a: F.when((link != "") & (a > 0), placed(a)).otherwise(acc))

    written = F.aggregate(
        F.coalesce(links, F.array().cast("array<string>")), F.struct(F.lit(0).alias("cursor"), F.lit("").alias("out")), place, lambda acc: acc["out"],
    )
    parts = F.filter(F.split(written, " ", -1), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(
        F.substring_index(x, ":", 1).cast("int").alias("start"), F.substring_index(x, ":", -1).cast("int").alias("end")
    ))


def touches_links(ops: Column, links: Column) -> Column:
    """Does an edit of the original overlap a link? Both are sorted and disjoint."""
    return F.exists(arrays.touching(as_spans(ops), links), lambda at: at >= 0)
