"""Protected spans: detection with offsets, overlap resolution, checks and restoration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redline import vocab as V
from redline.functions import arrays
from redline.functions.text import contains_any, let, strip

REGION = "struct<start:int,end:int,reason:string,text:string>"
REGIONS = f"array<{REGION}>"


def no_regions() -> Column:
    return F.array().cast(REGIONS)


def spans(text: Column, pattern: Column, reason: Column | str) -> Column:
    """All matches of one pattern with offsets: running sums over the lengths of the pieces between and the matches."""

    def placed(s: Column) -> Column:
        return F.transform(s["hits"], lambda hit, i: F.struct(
            (F.get(s["ends"], i) - F.length(hit)).alias("start"), F.get(s["ends"], i).alias("end"),
            (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), hit.alias("text"),
        ))

    def with_ends(cut: Column) -> Column:
        sizes = F.transform(cut["hits"], lambda hit, i: F.length(hit) + F.length(F.get(cut["pieces"], i)))
        return let(F.struct(cut["hits"].alias("hits"), arrays.running_sum(sizes).alias("ends")), placed)

    cut = F.struct(F.regexp_extract_all(text, pattern, 0).alias("hits"), F.split(text, pattern, -1).alias("pieces"))
    return F.when(F.regexp_like(text, pattern), let(cut, with_ends)).otherwise(no_regions()).cast(REGIONS)


def term_patterns(text: Column, terms: Column, reason: str) -> Column:
    """array<struct<pattern,reason>> for the literal terms that occur, any case, without the white space around them."""
    present = let(F.lower(text), lambda low: F.filter(F.transform(terms, strip), lambda t: (t != "") & F.contains(low, F.lower(t))))

    def quoted(term: Column) -> Column:
        return F.concat(F.lit(r"(?iu)\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))

    return F.transform(present, lambda t: F.struct(quoted(t).alias("pattern"), F.lit(reason).alias("reason")))


#: What a text must hold for a pattern to match, cheaper to tell than the pattern itself.
_NAME = r"[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñ]{2}"
HINTS = {
    "isbn": lambda text: contains_any(text, ["sb", "SB", "Sb", "sB"]),
    "doi": lambda text: F.contains(text, F.lit("10.")),
    "url": lambda text: F.contains(text, F.lit("://")),
    "apa_citation": lambda text: F.contains(text, F.lit("(")),
    "numeric_citation": lambda text: F.contains(text, F.lit("[")),
    "formal_date": lambda text: text.rlike(r"\d\s+[dD][eE]\s"),
    "proper_name": lambda text: text.rlike(rf"\s{_NAME}[a-záéíóúüñ]*\s+{_NAME}"),
}


def all_spans(text: Column, profile_terms: Column | None = None, glossary: Column | None = None, names: bool = True) -> Column:
    """Matches of every pattern and term. Most paragraphs hold few of them, so those that occur are listed first, and only
    they are cut out."""
    patterns = V.REGION_PATTERNS + ([("proper_name", V.PROPER_NAME)] if names else [])
    parts = [F.array_compact(F.array(*[
        F.when(HINTS[reason](text) & text.rlike(p), F.struct(F.lit(p).alias("pattern"), F.lit(reason).alias("reason"))) for reason, p in patterns
    ]))]
    if profile_terms is not None:
        parts.append(term_patterns(text, profile_terms, "profile_term"))
    if glossary is not None:
        parts.append(term_patterns(text, glossary, "glossary_term"))
    return F.flatten(F.transform(F.concat(*parts), lambda p: spans(text, p["pattern"], p["reason"])))


def resolve_overlaps(regions: Column) -> Column:
    """By start, longest first; keep a region when it starts at or after the end of the last one kept."""
    ranked = F.sort_array(F.transform(
        regions,
        lambda r, i: F.struct(
            r["start"].alias("s"), (r["start"] - r["end"]).alias("l"), i.alias("i"), r.alias("region")
        ),
    ))

    def kept(v: Column) -> Column:
        return F.transform(arrays.first_fitting(v), lambda i: F.get(v, i))

    return let(F.transform(ranked, lambda x: x["region"]), kept).cast(REGIONS)


def detect_regions(text: Column, profile_terms: Column | None = None, glossary: Column | None = None, names: bool = True) -> Column:
    return resolve_overlaps(all_spans(text, profile_terms, glossary, names))


def touched_regions(original: Column, corrected: Column, regions: Column) -> Column:
    """Regions whose text is gone after the change, whatever its case."""
    lost = F.filter(regions, lambda r: ~F.contains(F.lower(corrected), F.lower(r["text"])))
    return F.when(original == corrected, no_regions()).otherwise(lost)


def net_changes(ops: Column, reverted: Column) -> Column:
    return F.size(ops) - F.size(reverted)


def regions_text(regions: Column) -> Column:
    """Regions as lines for a correction request; null when there are none."""
    lines = F.transform(
        regions,
        lambda r: F.concat(
            F.lit('  - "'), r["text"], F.lit('" (pos '), r["start"].cast("string"), F.lit("-"),
            r["end"].cast("string"), F.lit("): "), r["reason"],
        ),
    )
    return F.when(F.size(regions) > 0, F.concat(F.lit(V.REGIONS_HEAD + "\n"), F.array_join(lines, "\n")))
