"""Registered queries: name → (function of a Corpus, checking SQL or None).

Every query runs over whole tables of the folder it is given. SQL is None where the result needs the standard
library's difflib, look-behind patterns, JSON text as written by Spark, or state; tests cover those.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redline import vocab as V
from redline.functions import edits, gates, protect, requests, routing, text
from redline.operators import analytics, corrector, match, review, structure, terms, triage
from redline.plans import oracle as O
from redline.session import store
from redline.sources import files, presets
from redline.sources import paragraphs as scan
from redline.sources.derived import Corpus
from redline.streaming import jobs

Query = Callable[[Corpus], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def joined(column: str) -> F.Column:
    return F.array_join(column, "|")


KEY = ["doc_id", "paragraph_index"]

# --- flagship ------------------------------------------------------------------------------------------


@query("triage_report", f"""SELECT lang, route, review_status, count(*) AS paragraphs, count(*) FILTER (changed) AS changed,
    sum(rule_hits)::BIGINT AS rule_hits, sum(greatest(1, {O.words('stripped')}))::BIGINT AS words, sum({O.syllables('stripped')})::BIGINT AS syllables,
    sum({O.sentences('stripped')})::BIGINT AS sentences FROM t_proposals GROUP BY ALL""")
def triage_report(c: Corpus) -> DataFrame:
    return triage.triage_report(c.proposals)


# --- scans ---------------------------------------------------------------------------------------------


@query("paragraph_scan", "SELECT doc_id, paragraph_index, text, location, style_name, n_paragraphs FROM t_paras")
def paragraph_scan(c: Corpus) -> DataFrame:
    return c.paragraphs.select(*KEY, "text", "location", "style_name", "n_paragraphs")


@query("html_block_scan", """SELECT page_id AS doc_id, paragraph_index, text, links,
    CASE WHEN kind = 'body' THEN 'body:' || paragraph_index ELSE kind || ':0:' || paragraph_index END AS location,
    CASE WHEN regexp_matches(tag, '^h[1-3]$') THEN 'Heading ' || right(tag, 1) WHEN tag = 'li' THEN 'List' WHEN tag = 'blockquote' THEN 'Quote' END AS style_name
    FROM t_html_paras""")
def html_block_scan(c: Corpus) -> DataFrame:
    return c.html.select(*KEY, "text", F.size("links").alias("links"), "location", "style_name")


@query("html_types", f"""SELECT paragraph_type, count(*) AS paragraphs FROM (SELECT {O.classify(O.strip('text'),
    "(CASE WHEN kind = 'body' THEN 'body:' ELSE kind || ':0:' END)",
    "(CASE WHEN regexp_matches(tag, '^h[1-3]$') THEN 'Heading ' || right(tag, 1) WHEN tag = 'li' THEN 'List' WHEN tag = 'blockquote' THEN 'Quote' END)")}
    AS paragraph_type FROM t_html_paras) GROUP BY ALL""")
def html_types(c: Corpus) -> DataFrame:
    return triage.typed(c.html).groupBy("paragraph_type").agg(F.count("*").alias("paragraphs"))


@query("turn_scan", f"""SELECT conv_id AS doc_id, turn AS paragraph_index, role, {O.classify('s', "('body:' || turn)", 'NULL::VARCHAR')} AS paragraph_type, length(s) AS size
    FROM (SELECT *, {O.strip("(CASE WHEN role = 'user' THEN '— ' || text ELSE text END)")} AS s FROM conversations)""")
def turn_scan(c: Corpus) -> DataFrame:
    return triage.typed(c.turns).select(*KEY, "role", "paragraph_type", F.length("stripped").alias("size"))


@query("location_codec", """SELECT doc_id, r, c, text, location, 'table' AS kind, location AS again FROM t_cells""")
def location_codec(c: Corpus) -> DataFrame:
    parts = c.cells.withColumn("p", text.location_parts(F.col("location")))
    return parts.select("doc_id", F.col("p.i1").alias("r"), F.col("p.i2").alias("c"), "text", "location", F.col("p.kind").alias("kind"),
                        text.location_text(F.col("p")).alias("again"))


@query("location_lookup", """SELECT p.doc_id, p.location, p.paragraph_index, p.text FROM t_paras p JOIN
    (SELECT DISTINCT doc_id, 'body:' || (user_id % 5) AS location FROM t_decisions) d ON d.doc_id = p.doc_id AND d.location = p.location""")
def location_lookup(c: Corpus) -> DataFrame:
    wanted = c.decisions.select("doc_id", F.concat(F.lit("body:"), (F.col("user_id") % 5).cast("string")).alias("location")).distinct()
    return c.paragraphs.join(wanted, ["doc_id", "location"], "left_semi").select("doc_id", "location", "paragraph_index", "text")


@query("preset_listing", """SELECT p.name AS key, p.ui_name AS name, p.ui_description AS description, p.ui_icon AS icon, p.intervention_level, p.register,
    count(d.doc_id) AS documents FROM t_presets p LEFT JOIN documents d ON d.doc_id % 10 = p.preset_no GROUP BY ALL""")
def preset_listing(c: Corpus) -> DataFrame:
    used = c.documents.groupBy((F.col("doc_id") % 10).cast("int").alias("preset_no")).agg(F.count("*").alias("documents"))
    names = presets.presets(c.spark).select("preset_no", F.col("name").alias("key"))
    return presets.ui_listing(c.spark).join(names, "key").join(used, "preset_no", "left").select(
        "key", "name", "description", "icon", "intervention_level", "register", F.coalesce("documents", F.lit(0)).alias("documents")
    )


@query("upload_admission", """SELECT page_id, url, upper(split_part(url, '/', -1)) AS filename_upper, n AS length,
    CASE WHEN (CASE WHEN contains(f, '.') THEN lower(split_part(f, '.', -1)) ELSE '' END) <> 'docx' THEN 'format' WHEN n > 1024 * 1024 THEN 'size' END AS reason
    FROM (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN split_part(url, '/', -1) || '.docx' ELSE split_part(url, '/', -1) END AS f, length(html) * (page_id % 400) AS n FROM pages)""")
def upload_admission(c: Corpus) -> DataFrame:
    name = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(".docx"))).otherwise(F.col("url"))
    listing = c.table("pages").select("page_id", "url", name.alias("path"), (F.length("html") * (F.col("page_id") % 400)).alias("length"))
    return files.admission(listing, limit_mb=1).select(
        "page_id", "url", F.upper(F.element_at(F.split("url", "/"), -1)).alias("filename_upper"), "length", "reason"
    )


@query("context_upsert", """SELECT doc_id, CASE WHEN n.doc_id IS NULL THEN o.words ELSE n.words END AS words, CASE WHEN n.doc_id IS NULL THEN 'old' ELSE 'new' END AS origin
    FROM (SELECT doc_id, n_chars AS words FROM documents WHERE doc_id % 2 = 0) o
    FULL JOIN (SELECT doc_id, quality + 10 * toxic AS words FROM labels) n USING (doc_id)""")
def context_upsert(c: Corpus) -> DataFrame:
    old = c.documents.filter("doc_id % 2 = 0").select("doc_id", F.col("n_chars").alias("words"), F.lit("old").alias("origin"))
    new = c.table("labels").select("doc_id", (F.col("quality") + 10 * F.col("toxic")).cast("long").alias("words"), F.lit("new").alias("origin"))
    return files.upsert(old, new)


@query("layout_flatten", """SELECT doc_id, page_no, block_no, block_text, 'Serif' AS font, (10 + block_no % 3)::DOUBLE AS font_size, block_no::DOUBLE AS y0 FROM t_blocks WHERE block_no % 7 <> 6""")
def layout_flatten(c: Corpus) -> DataFrame:
    """Blocks as layout JSON per page (every seventh an image), flattened to text blocks with their first font."""
    n = F.col("block_no")
    zero = F.lit(0).cast("double")
    span = F.struct(F.col("block_text").alias("text"), F.lit("Serif").alias("font"), (10 + n % 3).cast("double").alias("size"))
    block = F.struct(
        n.alias("block_no"), F.when(n % 7 == 6, "image").otherwise("text").alias("type"), F.array(zero, n.cast("double"), zero, zero).alias("bbox"),
        F.col("block_text").alias("text"), F.array(F.struct(F.array(span).alias("spans"))).alias("lines"),
    )
    pages = c.blocks.groupBy("doc_id", "page_no").agg(F.to_json(F.collect_list(block)).alias("blocks_json"))
    return files.flatten_layout(pages).select("doc_id", "page_no", "block_no", "block_text", "font", "font_size", "y0")


@query("json_side_table", "SELECT patch_id, corrected_text, review_status, rule_hits FROM t_patches")
def json_side_table(c: Corpus) -> DataFrame:
    """Patches written as JSON rows and read back with a declared schema."""
    path = jobs.new_folder(c.spark, "side")
    files.write_json_table(c.patches.select("patch_id", "corrected_text", "review_status", "rule_hits"), path)
    return files.read_json_table(c.spark, path, "patch_id string, corrected_text string, review_status string, rule_hits int")


@query("document_rewrite", """SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 2 ELSE 1 END::BIGINT AS run, count(*) AS paragraphs FROM t_lines GROUP BY ALL""")
def document_rewrite(c: Corpus) -> DataFrame:
    """All documents stored, then every second one processed again: its rows are replaced, not doubled."""
    path = jobs.new_folder(c.spark, "rewrite")
    rows = c.paragraphs.groupBy("doc_id").agg(F.count("*").alias("paragraphs"))
    files.rewrite_documents(rows.withColumn("run", F.lit(1)), path, 16)
    files.rewrite_documents(rows.filter("doc_id % 2 = 1").withColumn("run", F.lit(2)), path, 16)
    return c.spark.read.parquet(path).select("doc_id", "run", "paragraphs")


# --- projections and text functions -----------------------------------------------------------------------


@query("usable_paragraphs", f"SELECT doc_id, paragraph_index, stripped FROM t_typed WHERE length(stripped) >= 3")
def usable_paragraphs(c: Corpus) -> DataFrame:
    return c.typed.filter(F.length("stripped") >= 3).select(*KEY, "stripped")


def _preview_sql(n: int) -> str:
    return f"CASE WHEN length(text) > {n} THEN left(text, {n}) || '...' ELSE text END AS preview_{n}"


@query("previews", f"SELECT doc_id, paragraph_index, {', '.join(_preview_sql(n) for n in (80, 200, 300, 350, 500))} FROM t_paras")
def previews(c: Corpus) -> DataFrame:
    return c.paragraphs.select(*KEY, *[text.preview(F.col("text"), n).alias(f"preview_{n}") for n in (80, 200, 300, 350, 500)])


@query("cross_page_paragraphs", "SELECT doc_id, paragraph_index, location FROM t_paras WHERE contains(text, chr(12))")
def cross_page_paragraphs(c: Corpus) -> DataFrame:
    return c.paragraphs.filter("has_page_break").select(*KEY, "location")


@query("structural_map", f"""SELECT doc_id, paragraph_index, location, paragraph_type, section_index, section_position, has_page_break,
    {O.page_of('paragraph_index', 'n_paragraphs', 'greatest(1, ceil(n_paragraphs / 10.0))::BIGINT')} AS page_no
    FROM (SELECT *, contains(text, chr(12)) AS has_page_break FROM t_typed)""")
def structural_map(c: Corpus) -> DataFrame:
    columns = [*KEY, "text", "location", "style_name", "is_in_table", "has_page_break"]
    rows = triage.typed(structure.with_sections(c.paragraphs.select(*columns)))
    n = F.col("n_paragraphs")
    return rows.select(*KEY, "location", "paragraph_type", "section_index", "section_position", "has_page_break",
                       structure.page_estimate(F.col("paragraph_index"), n, match.page_count(n)).alias("page_no"))


@query("paragraph_types", f"""SELECT doc_id, paragraph_index, {O.classify('stripped', 'location', 'style_name', 'false', 'terms')} AS paragraph_type
    FROM (SELECT y.*, coalesce(l.terms, []::VARCHAR[]) AS terms FROM t_typed y LEFT JOIN t_term_lists l USING (doc_id))""")
def paragraph_types(c: Corpus) -> DataFrame:
    return triage.typed(terms.attach_terms(c.paragraphs, c.terms), F.col("terms")).select(*KEY, "paragraph_type")


@query("type_distribution", """SELECT lang, paragraph_type, paragraphs, paragraphs::DOUBLE / sum(paragraphs) OVER (PARTITION BY lang)::DOUBLE AS share
    FROM (SELECT lang, paragraph_type, count(*) AS paragraphs FROM t_typed WHERE stripped <> '' GROUP BY ALL)""")
def type_distribution(c: Corpus) -> DataFrame:
    return analytics.share_of_types(c.typed, ["lang"])


@query("type_fallback", """SELECT doc_id, paragraph_index, CASE WHEN starts_with(location, 'header:') THEN 'encabezado' WHEN starts_with(location, 'footer:') THEN 'footer'
    WHEN starts_with(location, 'table:') THEN 'celda_tabla' END AS paragraph_type
    FROM (SELECT page_id AS doc_id, paragraph_index, CASE WHEN kind = 'body' THEN 'body:' ELSE kind || ':0:' END AS location FROM t_html_paras)
    UNION ALL SELECT doc_id, c, 'celda_tabla' FROM t_cells""")
def type_fallback(c: Corpus) -> DataFrame:
    none = F.lit(None).cast("string")
    html = c.html.select(*KEY, "location")
    cells = c.cells.select("doc_id", text.location_parts(F.col("location"))["i2"].alias("paragraph_index"), "location")
    return html.unionByName(cells).select(*KEY, text.type_or_fallback(none, F.col("location")).alias("paragraph_type"))


@query("readability_by_lang", f"""SELECT lang, count(*) AS paragraphs, sum({O.syllables('stripped')})::BIGINT AS syllables,
    sum(greatest(1, {O.words('stripped')}))::BIGINT AS words, sum({O.sentences('stripped')})::BIGINT AS sentences FROM t_typed GROUP BY lang""")
def readability_by_lang(c: Corpus) -> DataFrame:
    s = F.col("stripped")
    return c.typed.groupBy("lang").agg(
        F.count("*").alias("paragraphs"), F.sum(text.syllable_count(s)).cast("long").alias("syllables"),
        F.sum(text.word_count(s)).cast("long").alias("words"), F.sum(text.sentence_count(s)).cast("long").alias("sentences"),
    )


@query("readability_band", f"""SELECT doc_id, paragraph_index, score, CASE WHEN score > 80 THEN 'muy_facil' WHEN score >= 60 THEN 'facil' WHEN score >= 40 THEN 'normal'
    WHEN score >= 20 THEN 'dificil' ELSE 'muy_dificil' END AS band FROM (SELECT *, {O.readability('stripped')} AS score FROM t_typed)""")
def readability_band(c: Corpus) -> DataFrame:
    rows = c.typed.select(*KEY, text.readability(F.col("stripped"), None).alias("score"))
    return rows.withColumn("band", text.readability_band(F.col("score")))


@query("spanish_char_ratio", f"SELECT doc_id, paragraph_index, {O.spanish('text')} AS ratio FROM t_paras")
def spanish_char_ratio(c: Corpus) -> DataFrame:
    return c.paragraphs.select(*KEY, text.spanish_ratio(F.col("text")).alias("ratio"))


@query("clause_counts", f"""SELECT lang, count(*) FILTER (n > 0) AS paragraphs, sum(n)::BIGINT AS clauses, max(n) AS most
    FROM (SELECT lang, {O.hits('text', V.SUBORDINATE)} AS n FROM t_paras) GROUP BY lang""")
def clause_counts(c: Corpus) -> DataFrame:
    n = F.col("n")
    return c.paragraphs.select("lang", text.subordinate_count(F.col("text")).cast("long").alias("n")).groupBy("lang").agg(
        F.count_if(n > 0).alias("paragraphs"), F.sum("n").alias("clauses"), F.max("n").alias("most")
    )


@query("normalised_keys", f"SELECT doc_id, paragraph_index, {O.normalise('text')} AS norm, left({O.normalise('text')}, 50) AS prefix FROM t_paras")
def normalised_keys(c: Corpus) -> DataFrame:
    norm = text.normalise(F.col("text"))
    return c.paragraphs.select(*KEY, norm.alias("norm"), F.left(norm, F.lit(50)).alias("prefix"))


@query("abrupt_endings", f"""SELECT doc_id, paragraph_index, stripped <> '' AND NOT contains({O.q(V.SENTENCE_CLOSERS)}, right(stripped, 1)) AS abrupt FROM t_typed""")
def abrupt_endings(c: Corpus) -> DataFrame:
    return c.typed.select(*KEY, text.ends_abruptly(F.col("stripped")).alias("abrupt"))


def _diff_sql(side: str) -> str:
    gap = O.q(V.WS + "+")
    parts = []
    for left, right in (("string_split_regex(original_text, {g})", "string_split_regex(corrected_text, {g})"),
                        ("regexp_extract_all(original_text, {g})", "regexp_extract_all(corrected_text, {g})")):
        a, b = left.format(g=gap), right.format(g=gap)
        me = "a" if side == "o" else "b"
        parts.append(
            f"(SELECT count(*) FILTER (a <> b AND {me} <> '') FROM (SELECT coalesce(x[i], '') AS a, coalesce(y[i], '') AS b "
            f"FROM (SELECT {a} AS x, {b} AS y), LATERAL (SELECT unnest(range(1, greatest(len(x), len(y)) + 1)) AS i)))"
        )
    return " + ".join(parts)


@query("word_diff", f"SELECT doc_id, paragraph_index, {_diff_sql('o')} AS original_changed, {_diff_sql('c')} AS corrected_changed FROM t_changes")
def word_diff(c: Corpus) -> DataFrame:
    rows = c.patches.filter("position = 0")
    return rows.select(*KEY, F.inline(F.array(text.word_diff(F.col("original_text"), F.col("corrected_text")))))


@query("lexicon_fix", f"SELECT doc_id, paragraph_index, {O.chain('stripped', V.LEXICON + V.CORPUS_RULES)} AS fixed FROM t_typed")
def lexicon_fix(c: Corpus) -> DataFrame:
    return c.typed.select(*KEY, edits.replace_chain(F.col("stripped"), V.LEXICON + V.CORPUS_RULES).alias("fixed"))


@query("first_hit_fix", f"""SELECT doc_id, paragraph_index, {O.first_hit('stripped', V.STYLE_OFFLINE + V.CORPUS_STYLE)} AS fixed FROM t_typed""")
def first_hit_fix(c: Corpus) -> DataFrame:
    return c.typed.select(*KEY, edits.first_hit(F.col("stripped"), V.STYLE_OFFLINE + V.CORPUS_STYLE).alias("fixed"))


@query("rule_pass", f"""SELECT doc_id, paragraph_index, length(stripped) < 3 AS skipped,
    CASE WHEN length(stripped) < 3 THEN text ELSE {O.fixed('found', 'pieces')} END AS corrected_text,
    CASE WHEN length(stripped) < 3 THEN 0 ELSE len(found) END::BIGINT AS ops,
    CASE WHEN length(stripped) < 3 OR len(found) = 0 THEN '' ELSE array_to_string(list_transform(range(1, len(found) + 1), lambda i: {O.match_start('found', 'pieces', 'i')} || ':' || found[i]), ' ') END AS log
    FROM (SELECT *, {O.found('stripped')} AS found, {O.pieces('stripped')} AS pieces FROM t_typed)""")
def rule_pass(c: Corpus) -> DataFrame:
    log = F.array_join(F.transform("ops", lambda e: F.concat_ws(":", e["offset"], e["original"])), " ")
    return corrector.first_pass_all(c.paragraphs).select(*KEY, "skipped", "corrected_text", F.size("ops").alias("ops"), log.alias("log"))


@query("block_pass", f"""SELECT doc_id, page_no, block_no, fixed AS corrected_text FROM
    (SELECT *, {O.fixed('found', 'pieces')} AS fixed FROM (SELECT *, {O.found(O.strip('block_text'))} AS found, {O.pieces(O.strip('block_text'))} AS pieces FROM t_blocks))
    WHERE length({O.strip('block_text')}) >= 3 AND fixed <> block_text""")
def block_pass(c: Corpus) -> DataFrame:
    return corrector.block_pass(c.blocks).select("doc_id", "page_no", "block_no", "corrected_text")


@query("page_split", f"""SELECT doc_id, paragraph_index, place AS cut, regexp_replace(left(stripped, place), {O.q(V.WS + '+$')}, '') AS before,
    regexp_replace(substr(stripped, place + 1), {O.q('^' + V.WS + '+')}, '') AS after
    FROM (SELECT *, CASE WHEN cut > 0 AND cut < length(stripped) AND space > cut - 30 THEN space + 1 ELSE cut END AS place
        FROM (SELECT *, CASE WHEN instr(reverse(left(stripped, cut + 1)), ' ') > 0 THEN cut + 1 - instr(reverse(left(stripped, cut + 1)), ' ') ELSE -1 END AS space
            FROM (SELECT *, greatest(0, least(floor(length(stripped) * (((doc_id + paragraph_index) % 10)::DOUBLE / 10::DOUBLE))::BIGINT, length(stripped))) AS cut FROM t_typed)))""")
def page_split(c: Corpus) -> DataFrame:
    fraction = ((F.col("doc_id") + F.col("paragraph_index")) % 10).cast("double") / 10
    cut = text.split_at_fraction(F.col("stripped"), fraction)
    return c.typed.select(*KEY, F.inline(F.array(cut))).select(*KEY, "cut", "before", "after")


@query("touched_regions", """SELECT doc_id, paragraph_index, len(regions) AS regions,
    CASE WHEN stripped = pass0_text THEN 0 ELSE len(list_filter(regions, lambda r: NOT contains(lower(pass0_text), lower(r)))) END AS touched
    FROM (SELECT *, list_filter(protected_terms, lambda t: contains(lower(stripped), lower(t))) AS regions FROM t_pass0) WHERE len(regions) > 0""")
def touched_regions(c: Corpus) -> DataFrame:
    # One region per protected term that occurs: the count of distinct terms, wherever they stand.
    present = F.filter("protected_terms", lambda t: F.contains(F.lower("stripped"), F.lower(t)))
    regions = F.transform(present, lambda t: F.struct(F.lit(0).alias("start"), F.length(t).alias("end"), F.lit("profile_term").alias("reason"), t.alias("text")))
    rows = c.prepared.withColumn("regions", regions).filter(F.size("regions") > 0)
    return rows.select(*KEY, F.size("regions").alias("regions"),
                       F.size(protect.touched_regions(F.col("stripped"), F.col("pass0_text"), F.col("regions"))).alias("touched"))


_TOKEN = r"[0-9]+(?:[.][0-9]+)+"


@query("number_spans", f"""SELECT doc_id, paragraph_index, k, hit AS text, start_at::BIGINT AS start_at, (start_at + length(hit))::BIGINT AS end_at FROM (
    SELECT doc_id, paragraph_index, k, found[k] AS hit, list_sum(list_transform(pieces[1:k], lambda p: length(p))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda f: length(f))), 0) AS start_at
    FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM (SELECT doc_id, paragraph_index, regexp_extract_all(text, {O.q(_TOKEN)}) AS found, string_split_regex(text, {O.q(_TOKEN)}) AS pieces FROM t_paras)))""")
def number_spans(c: Corpus) -> DataFrame:
    found = protect.spans(F.col("text"), F.lit(_TOKEN), "number")
    rows = c.paragraphs.select(*KEY, F.posexplode(found).alias("k", "r"))
    return rows.select(*KEY, (F.col("k") + 1).alias("k"), F.col("r.text").alias("text"), F.col("r.start").alias("start_at"), F.col("r.end").alias("end_at"))


@query("region_scan", """SELECT doc_id, paragraph_index, start_at AS "start", end_at AS "end", reason, text FROM t_regions""")
def region_scan(c: Corpus) -> DataFrame:
    """All protected spans of the stripped paragraphs after overlap resolution."""
    rows = triage.typed(triage.with_profile(c.paragraphs))
    found = protect.detect_regions(F.col("stripped"), F.col("protected_terms"))
    return rows.select(*KEY, F.inline(found)).select(*KEY, "start", "end", "reason", "text")


@query("revert_regions", """SELECT doc_id, paragraph_index, pass0_text AS text, rule_hits, reverted, rule_hits - reverted AS net_changes,
    array_to_string(undone, ' ') AS log FROM t_pass0 WHERE rule_hits > 0""")
def revert_regions(c: Corpus) -> DataFrame:
    """Paragraphs with edits: the text after those inside protected spans are undone, and what was undone where."""
    log = F.array_join(F.transform("reverted", lambda r: F.concat_ws(":", r["region_start"], r["region_end"], r["reason"], r["restored"])), " ")
    return c.prepared.filter(F.size("ops") > 0).select(
        *KEY, F.col("pass0_text").alias("text"), F.size("ops").alias("rule_hits"), F.size("reverted").alias("reverted"),
        protect.net_changes(F.col("ops"), F.col("reverted")).alias("net_changes"), log.alias("log"),
    )


@query("apply_edits", "SELECT doc_id, paragraph_index, regexp_replace(text, '[0-9]+', '<\\0>', 'g') AS text FROM t_paras WHERE regexp_matches(text, '[0-9]')")
def apply_edits(c: Corpus) -> DataFrame:
    """Edit operations built from every number in a paragraph, applied from the right."""
    found = protect.spans(F.col("text"), F.lit("[0-9]+"), "number")
    ops = F.transform(found, lambda r: F.struct(
        r["start"].alias("offset"), (r["end"] - r["start"]).alias("length"), r["text"].alias("original"),
        F.concat(F.lit("<"), r["text"], F.lit(">")).alias("replacement"), F.lit("NUM").alias("rule_id"),
        F.lit("number").alias("category"), F.lit("").alias("message"),
    ))
    return c.paragraphs.filter(F.col("text").rlike("[0-9]")).select(*KEY, edits.apply_edits(F.col("text"), ops).alias("text"))


@query("similarity_exact")
def similarity_exact(c: Corpus) -> DataFrame:
    rows = c.patches.filter("position = 0")
    ratio = edits.similarity(F.col("original_text"), F.col("corrected_text"))
    return rows.select(*KEY, ratio.alias("similarity"), F.round(1 - ratio, 4).alias("rewrite_ratio"))


@query("similarity_tokens", f"SELECT doc_id, paragraph_index, {O.jaccard('original_text', 'corrected_text')} AS similarity FROM t_changes")
def similarity_tokens(c: Corpus) -> DataFrame:
    return c.patches.filter("position = 0").select(*KEY, edits.token_jaccard(F.col("original_text"), F.col("corrected_text")).alias("similarity"))


@query("link_overlap", f"""SELECT p.page_id AS doc_id, p.paragraph_index, len(p.found) AS edits, count(l.k) FILTER (l.at > 0) AS links,
    coalesce(bool_or(len(list_filter(range(1, len(p.found) + 1), lambda i: {O.match_start('p.found', 'p.pieces', 'i')} < l.cursor AND {O.match_start('p.found', 'p.pieces', 'i')} + length(p.found[i]) > l.cursor - length(l.link))) > 0) FILTER (l.at > 0), false) AS overlaps
    FROM (SELECT *, CASE WHEN length(text) < 3 THEN [] ELSE {O.found('text')} END AS found, {O.pieces('text')} AS pieces FROM t_html_links) p JOIN t_link_walk l USING (page_id, paragraph_index)
    WHERE l.k > 0 GROUP BY ALL""")
def link_overlap(c: Corpus) -> DataFrame:
    """Web paragraphs with links: does the rule pass change text inside a link?"""
    rows = corrector.first_pass_all(c.html.filter(F.size("links") > 0))
    rows = rows.withColumn("ranges", edits.link_ranges(F.col("text"), F.col("links")))
    return rows.select(*KEY, F.size("ops").alias("edits"), F.size("ranges").alias("links"), edits.touches_links(F.col("ops"), F.col("ranges")).alias("overlaps"))


@query("call_costs", """SELECT doc_id, paragraph_index, pass_number, call_type, prompt_tokens, completion_tokens, cost_e8,
    (cost_e8::DECIMAL(28,0) / 100000000)::DECIMAL(18,8)::DOUBLE AS cost_usd FROM t_usage""")
def call_costs(c: Corpus) -> DataFrame:
    return c.usage.select(*KEY, "pass_number", "call_type", "prompt_tokens", "completion_tokens", "cost_e8",
                          text.usd(F.col("cost_e8")).cast("double").alias("cost_usd"))


@query("parse_responses", """SELECT doc_id, paragraph_index, pass_number,
    CASE WHEN error_text IS NOT NULL THEN NULL WHEN pass_number = 2 THEN NULL WHEN length(final_text) > floor(length(pass0_text) * 1.1::DOUBLE)::BIGINT THEN 'skip' ELSE 'correct' END AS action,
    CASE WHEN error_text IS NOT NULL OR pass_number = 2 THEN NULL WHEN length(final_text) > floor(length(pass0_text) * 1.1::DOUBLE)::BIGINT THEN '' ELSE final_text END AS corrected_text FROM t_audit""")
def parse_responses(c: Corpus) -> DataFrame:
    limit = F.floor(F.length("pass0_text") * 1.1).cast("int")
    parsed = requests.parse_response(analytics.audit_content(c.audit), limit)
    return c.audit.select(*KEY, "pass_number", parsed["action"].alias("action"), parsed["corrected_text"].alias("corrected_text"))


_DISPATCH = """SELECT doc_id, paragraph_index, CASE WHEN error_text IS NULL AND final_text <> '' AND length(final_text) <= floor(length(pass0_text) * 1.1::DOUBLE)::BIGINT THEN final_text ELSE pass0_text END AS text
    FROM t_audit WHERE pass_number = 1"""


@query("response_dispatch", _DISPATCH)
def response_dispatch(c: Corpus) -> DataFrame:
    limit = F.floor(F.length("pass0_text") * 1.1).cast("int")
    rows = c.audit.filter("pass_number = 1")
    parsed = requests.parse_response(analytics.audit_content(rows), limit)
    return rows.withColumn("p", parsed).select(*KEY, routing.dispatch(F.col("p.action"), F.col("p.corrected_text"), F.col("pass0_text")).alias("text"))


def _profile(c: Corpus) -> DataFrame:
    asked = c.documents.select("doc_id", (F.col("doc_id") % 10).cast("int").alias("preset_no"))
    fields = ["register", "intervention_level", "audience_type", "audience_expertise", "tone", "preserve_author_voice", "max_rewrite_ratio", "style_priorities", "protected_terms"]
    table = presets.presets(c.spark).select("preset_no", F.struct(*fields).alias("profile"))
    return asked.join(F.broadcast(table), "preset_no").drop("preset_no")


@query("request_table")
def request_table(c: Corpus) -> DataFrame:
    """Correction requests for every routed paragraph, ready to be sent out in batches."""
    rows = structure.neighbours(triage.typed(structure.with_sections(triage.with_profile(c.paragraphs).drop("n_paragraphs"))))
    rows = triage.routed(triage.first_pass(rows)).filter("route <> 'skip'")
    titles = structure.section_table(c.sectioned).select("doc_id", "section_index", "section_title")
    rows = rows.join(titles, ["doc_id", "section_index"], "left").join(_profile(c), "doc_id")
    n = F.col("n_paragraphs")
    block = requests.structure_block(
        F.col("paragraph_type"), F.col("section_title"), F.array().cast("array<string>"),
        structure.page_estimate(F.col("paragraph_index"), n, match.page_count(n)), match.page_count(n),
        F.col("has_page_break"), None, F.col("next_type"),
    )
    context = requests.context_block(F.col("prev_text"), F.col("prev_type"), F.col("prev_abrupt"), F.col("prev_kind"))
    regions = protect.regions_text(protect.detect_regions(F.col("pass0_text"), F.col("protected_terms")))
    return rows.select(
        *KEY, "route", routing.token_budget(F.col("route")).alias("max_tokens"),
        requests.request_text(requests.profile_block(F.col("profile")), block, context, F.col("pass0_text"), regions).alias("request"),
    )


def _profile_sql() -> str:
    return ("'PERFIL: ' || register || ' | Intervención: ' || intervention_level || ' | Audiencia: ' || audience_type || ' (' || audience_expertise || ') | Tono: ' || tone "
            "|| CASE WHEN preserve_author_voice THEN chr(10) || 'PRESERVAR VOZ DEL AUTOR: sí' ELSE '' END "
            "|| chr(10) || 'MAX REESCRITURA: ' || floor(max_rewrite_ratio * 100)::BIGINT || '%' "
            "|| CASE WHEN len(style_priorities) > 0 THEN chr(10) || 'PRIORIDADES: ' || array_to_string(style_priorities, ', ') ELSE '' END "
            "|| CASE WHEN len(protected_terms) > 0 THEN chr(10) || 'PROTEGER TÉRMINOS: ' || array_to_string(protected_terms, ', ') ELSE '' END")


@query("profile_blocks", f"SELECT d.doc_id, {_profile_sql()} AS block FROM documents d JOIN t_presets p ON p.preset_no = d.doc_id % 10")
def profile_blocks(c: Corpus) -> DataFrame:
    return _profile(c).select("doc_id", requests.profile_block(F.col("profile")).alias("block"))


@query("audit_requests")
def audit_requests(c: Corpus) -> DataFrame:
    """Second-pass requests: original, first-pass text, the three texts before and the document's context."""
    rows = structure.neighbours(c.typed).select(*KEY, "previous_texts", "paragraph_type", "location")
    found = terms.term_arrays(c.terms).select("doc_id", F.struct(
        F.lit(None).cast("string").alias("global_summary"), F.lit("narrativa").alias("dominant_voice"), F.lit("neutro").alias("dominant_register"),
        F.transform("terms", lambda t: F.struct(t.alias("term"))).alias("protected_globals"),
        F.lit(None).cast("double").alias("avg_sentence_length"), F.lit(None).cast("double").alias("passive_voice_ratio"),
    ).alias("g"))
    calls = c.usage.filter("pass_number = 2").select(*KEY, "original_text", "final_text")
    return calls.join(rows, KEY).join(found, "doc_id", "left").select(*KEY, requests.audit_request_text(
        requests.global_block(F.col("g")), F.col("previous_texts"), F.col("paragraph_type"), F.col("location"), F.col("original_text"), F.col("final_text"),
    ).alias("request"))


# --- routing, profiles ---------------------------------------------------------------------------------


@query("route_decisions", "SELECT doc_id, paragraph_index, paragraph_type, section_position, is_transition, rule_hits, route, route_reason FROM t_routed")
def route_decisions(c: Corpus) -> DataFrame:
    return c.prepared.select(*KEY, "paragraph_type", "section_position", "is_transition", F.size("ops").alias("rule_hits"), "route", "route_reason")


@query("route_counts", """SELECT lang, route, grouping_id(lang, route)::BIGINT AS level, count(*) AS paragraphs, count(*) FILTER (gated) AS gated,
    count(*) FILTER (review_status = 'gate_rejected') AS rejected, count(*) FILTER (review_status = 'manual_review') AS flagged
    FROM t_proposals GROUP BY CUBE (lang, route)""")
def route_counts(c: Corpus) -> DataFrame:
    return analytics.route_counts(c.proposals)


@query("engine_decision", f"""SELECT doc_id, paragraph_index, paragraph_type <> 'cita' AS apply_rules,
    paragraph_type NOT IN ('titulo', 'subtitulo', 'cita', 'encabezado', 'footer') AS apply_model, CASE WHEN paragraph_type = 'cita' THEN 'cita_textual' END AS skip_reason,
    array_to_string(list_sort(list_distinct(list_concat(disabled_rules, {O.str_list(V.STYLE_RULES_OFF)},
        CASE WHEN paragraph_type IN ('titulo', 'subtitulo') THEN {O.str_list(V.TITLE_RULES_OFF)} ELSE []::VARCHAR[] END))), '|') AS disabled_rules FROM t_typed""")
def engine_decision(c: Corpus) -> DataFrame:
    rows = triage.typed(triage.with_profile(c.paragraphs))
    e = rows.select(*KEY, F.inline(F.array(routing.engines(F.col("paragraph_type"), F.col("disabled_rules")))))
    return e.select(*KEY, "apply_rules", "apply_model", "skip_reason", F.array_join(F.array_sort("disabled_rules"), "|").alias("disabled_rules"))


@query("pass2_candidates", "SELECT doc_id, paragraph_index, route FROM t_usage WHERE pass_number = 2")
def pass2_candidates(c: Corpus) -> DataFrame:
    p = c.proposals.filter("route <> 'skip'")
    return p.filter(routing.second_pass(F.col("route"), F.col("rewrite_ratio"), F.col("intervention_level"), F.col("changed"))).select(*KEY, "route")


@query("model_budget", """SELECT route, count(*) AS paragraphs, coalesce(max(CASE route WHEN 'editorial' THEN 4000 WHEN 'cheap' THEN 2000 END), 0)::BIGINT AS max_tokens FROM t_routed GROUP BY route""")
def model_budget(c: Corpus) -> DataFrame:
    return c.prepared.groupBy("route").agg(F.count("*").alias("paragraphs"), F.coalesce(F.max(routing.token_budget(F.col("route"))), F.lit(0)).alias("max_tokens"))


def _profile_requests(c: Corpus) -> DataFrame:
    names = F.array(*[F.lit(p[1]) for p in V.PRESETS], F.lit(None), F.lit("unknown"))
    return c.documents.select(
        "doc_id", F.get(names, (F.col("doc_id") % 12).cast("int")).alias("preset_name"),
        F.when(F.col("source") == "src0", "agresiva").alias("intervention_level"),
        F.when(F.col("doc_id") % 5 == 0, 0.45).alias("max_rewrite_ratio"),
    )


_RESOLVED = f"""SELECT d.doc_id, d.preset_name, coalesce(d.o_level, p.intervention_level, 'moderada') AS intervention_level,
    coalesce(d.o_rewrite, p.max_rewrite_ratio, 0.30::DOUBLE) AS max_rewrite_ratio, coalesce(p.max_expansion_ratio, 1.10::DOUBLE) AS max_expansion_ratio,
    p.genre, p.audience_type, coalesce(p.register, 'neutro') AS register, coalesce(p.tone, 'neutro') AS tone, p.readability_min::DOUBLE AS readability_min,
    array_to_string(coalesce(p.style_priorities, {O.str_list(presets.DEFAULT_PRIORITIES)}), '|') AS style_priorities,
    CASE WHEN d.o_level IS NOT NULL OR d.o_rewrite IS NOT NULL THEN 'custom' WHEN p.name IS NOT NULL THEN 'preset' ELSE 'default' END AS source
    FROM (SELECT doc_id, ({O.str_list([p[1] for p in V.PRESETS])} || [NULL, 'unknown'])[(doc_id % 12 + 1)::BIGINT] AS preset_name,
        CASE WHEN source = 'src0' THEN 'agresiva' END AS o_level, CASE WHEN doc_id % 5 = 0 THEN 0.45::DOUBLE END AS o_rewrite FROM documents) d
    LEFT JOIN t_presets p ON p.name = d.preset_name"""


@query("profile_resolution", _RESOLVED)
def profile_resolution(c: Corpus) -> DataFrame:
    rows = presets.resolve(_profile_requests(c))
    return rows.select("doc_id", "preset_name", "intervention_level", "max_rewrite_ratio", "max_expansion_ratio", "genre", "audience_type", "register", "tone",
                       F.col("readability_min").cast("double").alias("readability_min"), joined("style_priorities").alias("style_priorities"), "source")


@query("inferred_fields", f"""SELECT r.doc_id, coalesce(r.genre, 'inferred_' || d.lang) AS genre, coalesce(r.audience_type, 'audience_' || d.lang) AS audience_type, r.register, r.tone
    FROM ({_RESOLVED}) r JOIN documents d USING (doc_id)""")
def inferred_fields(c: Corpus) -> DataFrame:
    guess = c.documents.select(
        "doc_id", F.concat(F.lit("inferred_"), "lang").alias("genre"), F.concat(F.lit("audience_"), "lang").alias("audience_type"),
        F.lit("formal").alias("register"), F.lit("neutro").alias("tone"),
    )
    return presets.fill_inferred(presets.resolve(_profile_requests(c)), guess).select("doc_id", "genre", "audience_type", "register", "tone")


# --- gates ---------------------------------------------------------------------------------------------


@query("gate_results", """SELECT doc_id, paragraph_index, g.n AS gate_name, g.p AS passed, g.v AS value, g.c AS critical FROM (SELECT doc_id, paragraph_index, unnest([
    {'n': 'not_empty', 'p': g_not_empty, 'v': g_not_empty::BIGINT::DOUBLE, 'c': true},
    {'n': 'expansion_ratio', 'p': g_expansion, 'v': expansion, 'c': true},
    {'n': 'rewrite_ratio', 'p': g_rewrite, 'v': rewrite_ratio, 'c': false},
    {'n': 'protected_terms', 'p': g_terms, 'v': CASE WHEN len(checked) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(checked, lambda t: contains(lower(candidate), lower(t))))::DOUBLE / len(checked)::DOUBLE END, 'c': true},
    {'n': 'language_preserved', 'p': g_language, 'v': CASE WHEN es_before > 0.005::DOUBLE THEN es_after / es_before ELSE 1.0::DOUBLE END, 'c': false},
    {'n': 'readability_fh', 'p': g_readability, 'v': score, 'c': false}]) AS g FROM t_proposals WHERE gated)""")
def gate_results(c: Corpus) -> DataFrame:
    return c.proposals.filter("gated").select(*KEY, F.inline("gates")).select(*KEY, "gate_name", "passed", "value", "critical")


@query("gate_outcomes", """SELECT gate_name, count(*) FILTER (p) AS ok, count(*) FILTER (NOT p) AS failed FROM (
    UNPIVOT (SELECT g_not_empty AS not_empty, g_expansion AS expansion_ratio, g_rewrite AS rewrite_ratio, g_terms AS protected_terms,
        g_language AS language_preserved, g_readability AS readability_fh FROM t_proposals WHERE gated)
    ON not_empty, expansion_ratio, rewrite_ratio, protected_terms, language_preserved, readability_fh INTO NAME gate_name VALUE p) GROUP BY gate_name""")
def gate_outcomes(c: Corpus) -> DataFrame:
    return analytics.gate_outcomes(c.proposals)


@query("disposition", "SELECT doc_id, paragraph_index, gated, review_status, origin, final_text, changed FROM t_proposals")
def disposition(c: Corpus) -> DataFrame:
    return c.proposals.select(*KEY, "gated", "review_status", "origin", "final_text", "changed")


@query("gate_log", "SELECT doc_id, paragraph_index, candidate, pass0_text FROM t_proposals WHERE review_status = 'gate_rejected'")
def gate_log(c: Corpus) -> DataFrame:
    """Rejected candidates, kept even when nothing is left to patch."""
    return c.proposals.filter("review_status = 'gate_rejected'").select(*KEY, "candidate", "pass0_text")


@query("disposition_exact")
def disposition_exact(c: Corpus) -> DataFrame:
    """Decisions with the exact similarity of the standard library and rounded values."""
    rows = triage.proposed(c.prepared, "difflib", True, stress=True)
    return rows.groupBy("route", "review_status").agg(F.count("*").alias("paragraphs"), F.count_if("changed").alias("changed"))


# --- structure -----------------------------------------------------------------------------------------


@query("sections", "SELECT doc_id, section_index, section_title, start_paragraph, end_paragraph FROM t_sections")
def sections(c: Corpus) -> DataFrame:
    return structure.section_table(c.sectioned)


@query("section_chunks", """SELECT doc_id, CASE WHEN n_paragraphs > 40 THEN paragraph_index // 30 ELSE 0 END AS section_index, min(paragraph_index) AS start_paragraph,
    max(paragraph_index) AS end_paragraph FROM t_lines GROUP BY ALL""")
def section_chunks(c: Corpus) -> DataFrame:
    bare = scan.plain(c.paragraphs.select(*KEY, "text", "location", "style_name"))
    return structure.section_table(structure.with_sections(bare)).drop("section_title")


@query("section_position", "SELECT doc_id, paragraph_index, section_index, section_position, is_transition FROM t_sectioned")
def section_position(c: Corpus) -> DataFrame:
    return c.sectioned.select(*KEY, "section_index", "section_position", "is_transition")


@query("turn_positions", """SELECT conv_id AS doc_id, turn AS paragraph_index, CASE WHEN turn = 0 THEN 'first' WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'last' ELSE 'middle' END AS section_position,
    count(*) OVER (PARTITION BY conv_id) AS n_paragraphs FROM conversations""")
def turn_positions(c: Corpus) -> DataFrame:
    return structure.with_sections(c.turns).select(*KEY, "section_position", "n_paragraphs")


@query("prev_next_context", f"""SELECT k.doc_id, k.paragraph_index, k.next_type, lag(k.stripped) OVER w AS prev_text, lag(k.paragraph_type) OVER w AS prev_type,
    coalesce(NOT contains({O.q(V.SENTENCE_CLOSERS)}, right(lag(k.stripped) OVER w, 1)), false) AS prev_abrupt
    FROM (SELECT * FROM (SELECT *, lead(paragraph_type) OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS next_type FROM t_typed) WHERE length(stripped) >= 3) k
    WINDOW w AS (PARTITION BY k.doc_id ORDER BY k.paragraph_index)""")
def prev_next_context(c: Corpus) -> DataFrame:
    return structure.neighbours(c.typed).select(
        *KEY, "next_type", "prev_text", "prev_type", F.coalesce("prev_abrupt", F.lit(False)).alias("prev_abrupt"))


@query("rolling_context", """SELECT doc_id, paragraph_index, coalesce(array_to_string(list(stripped) OVER (PARTITION BY doc_id ORDER BY paragraph_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '|'), '') AS context
    FROM t_typed WHERE length(stripped) >= 3""")
def rolling_context(c: Corpus) -> DataFrame:
    return structure.neighbours(c.typed).select(*KEY, joined("previous_texts").alias("context"))


@query("batch_boundaries", "SELECT * FROM t_batches")
def batch_boundaries(c: Corpus) -> DataFrame:
    return c.batches


@query("batch_seeds", """SELECT b.doc_id, b.batch_index, b.start_paragraph,
    (SELECT nullif(arg_max(left(p.pass0_text, 200), p.paragraph_index), '') FROM t_pass0 p WHERE p.doc_id = b.doc_id AND p.paragraph_index BETWEEN b.start_paragraph - 5 AND b.start_paragraph - 1) AS seed
    FROM t_batches b WHERE b.batch_index > 0""")
def batch_seeds(c: Corpus) -> DataFrame:
    return structure.batch_seeds(_pass0_all(c), c.batches)


def _pass0(c: Corpus) -> DataFrame:
    """First pass over all paragraphs, unusable ones included, so that positions have no gaps."""
    rows = triage.typed(triage.positioned(triage.with_profile(c.paragraphs)))
    return triage.fence(triage.first_pass(rows), ["pass0_text"]).select(*KEY, "stripped", "pass0_text")


def _pass0_all(c: Corpus) -> DataFrame:
    """The same, stored for plans that read it in several branches."""
    return store(_pass0(c), "pass0")


@query("batch_progress", """SELECT doc_id, count(*) AS batches, count(*) FILTER (done) AS completed, count(*) FILTER (done)::DOUBLE / count(*)::DOUBLE AS share
    FROM (SELECT *, (doc_id + batch_index) % 3 <> 0 AS done FROM t_batches) GROUP BY doc_id""")
def batch_progress(c: Corpus) -> DataFrame:
    done = F.when((F.col("doc_id") + F.col("batch_index")) % 3 != 0, "completed").otherwise("pending")
    return analytics.batch_progress(c.batches.withColumn("status", done))


@query("boundary_check", """SELECT h.doc_id, h.batch_index, h.head AS paragraph_index, coalesce(h.real_seed, '') AS real_seed, coalesce(left(a.pass0_text, 200), '') AS approx_seed,
    coalesce(h.real_seed, '') <> coalesce(left(a.pass0_text, 200), '') AS rerun
    FROM (SELECT *, lag(last_text) OVER (PARTITION BY doc_id ORDER BY batch_index) AS real_seed
        FROM (SELECT b.doc_id, b.batch_index, min(u.paragraph_index) AS head, arg_max(left(u.final_text, 200), u.paragraph_index) AS last_text
            FROM t_batches b JOIN t_proposals u ON u.doc_id = b.doc_id AND u.paragraph_index BETWEEN b.start_paragraph AND b.end_paragraph GROUP BY ALL)) h
    LEFT JOIN t_pass0 a ON a.doc_id = h.doc_id AND a.paragraph_index = h.head - 1 WHERE h.batch_index > 0""")
def boundary_check(c: Corpus) -> DataFrame:
    usable_before = _pass0_all(c)
    return corrector.boundary_check(c.batches, usable_before, c.proposals.select(*KEY, "final_text"))


@query("stratified_sample", f"""SELECT doc_id, paragraph_index, text, sample_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS sample_no FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY paragraph_index) AS copy FROM (
        SELECT doc_id, paragraph_index, text, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM t_lines WHERE length({O.strip('text')}) > 30
            WINDOW w AS (PARTITION BY doc_id ORDER BY paragraph_index))
        WHERE r < 3 OR (n > 6 AND r BETWEEN greatest(0, n // 2 - 1) AND n // 2 + 1) OR (n > 3 AND r >= n - 3)) WHERE copy = 1)) WHERE sample_no <= 9""")
def stratified_sample(c: Corpus) -> DataFrame:
    return structure.stratified_sample(c.paragraphs.select(*KEY, "text", "location"))


@query("section_sample", f"""SELECT s.doc_id, s.section_index, '[' || coalesce(s.section_title, 'Sección ' || (s.section_index + 1)) || ']: ' || coalesce(x.lines, '(vacía)') AS description
    FROM t_sections s LEFT JOIN (SELECT doc_id, section_index, string_agg(left(st, 200), ' | ' ORDER BY paragraph_index) AS lines FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, section_index ORDER BY paragraph_index) AS rn FROM (SELECT *, {O.strip('text')} AS st FROM t_sectioned) WHERE length(st) > 10)
        WHERE rn <= 4 GROUP BY ALL) x USING (doc_id, section_index) WHERE s.section_index < 15""")
def section_sample(c: Corpus) -> DataFrame:
    return structure.section_sample(c.sectioned)


@query("profile_sample", f"""SELECT doc_id, rn AS sample_no, left(st, 300) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS rn
    FROM (SELECT *, {O.strip('text')} AS st FROM t_lines) WHERE length(st) > 20) WHERE rn <= 8""")
def profile_sample(c: Corpus) -> DataFrame:
    return structure.profile_sample(c.paragraphs)


@query("page_estimate", f"SELECT doc_id, paragraph_index, {O.page_of('paragraph_index', 'n_paragraphs', 'greatest(1, ceil(n_paragraphs / 10.0))::BIGINT')} AS page_no FROM t_lines")
def page_estimate(c: Corpus) -> DataFrame:
    n = F.col("n_paragraphs")
    return c.paragraphs.select(*KEY, structure.page_estimate(F.col("paragraph_index"), n, match.page_count(n)).alias("page_no"))


@query("table_context", """SELECT doc_id, location, text, r AS row_no, c AS col_index, 3::BIGINT AS num_cols, (['name', 'segment', 'key'])[c + 1] AS col_header FROM t_cells""")
def table_context(c: Corpus) -> DataFrame:
    return structure.table_context(c.cells).select("doc_id", "location", "text", "row_no", "col_index", "num_cols", "col_header")


# --- terms ---------------------------------------------------------------------------------------------


@query("terms", "SELECT * FROM t_terms")
def term_table(c: Corpus) -> DataFrame:
    return c.terms


@query("term_density", """SELECT y.doc_id, y.paragraph_index, len(list_filter(l.terms, lambda t: contains(lower(y.stripped), lower(t)))) AS hits FROM t_typed y JOIN t_term_lists l USING (doc_id)""")
def term_density(c: Corpus) -> DataFrame:
    rows = terms.attach_terms(c.typed.select(*KEY, "stripped"), c.terms).filter(F.size("terms") > 0)
    return rows.select(*KEY, F.size(F.filter("terms", lambda t: F.contains(F.lower("stripped"), F.lower(t)))).alias("hits"))


@query("protected_union", """SELECT p.doc_id, array_to_string(list_sort(list_distinct(list_concat(p.protected_terms, coalesce(l.terms, []::VARCHAR[])))), '|') AS terms,
    len(list_filter(coalesce(l.terms, []::VARCHAR[]), lambda t: NOT list_contains(p.protected_terms, t))) AS new_terms
    FROM t_protected p LEFT JOIN t_term_lists l USING (doc_id)""")
def protected_union(c: Corpus) -> DataFrame:
    found = c.protected.join(terms.term_arrays(c.terms), "doc_id", "left")
    own = F.coalesce("terms", F.array().cast("array<string>"))
    return found.select("doc_id", F.array_join(terms.union_terms(F.col("protected_terms"), F.col("terms")), "|").alias("terms"),
                        F.size(F.array_except(own, F.col("protected_terms"))).alias("new_terms"))


@query("analysis_stats", """SELECT doc_id, total_paragraphs, non_empty_paragraphs, sections_detected, coalesce(tn, 0) AS terms_extracted, coalesce(tp, 0) AS terms_protected, needing_model, narrative
    FROM (SELECT doc_id, count(*) AS total_paragraphs, count(*) FILTER (stripped <> '') AS non_empty_paragraphs,
        count(*) FILTER (paragraph_type NOT IN ('vacio', 'encabezado', 'footer', 'titulo', 'subtitulo', 'cita')) AS needing_model,
        count(*) FILTER (paragraph_type = 'narrativo') AS narrative FROM t_typed GROUP BY doc_id)
    JOIN (SELECT doc_id, count(*) AS sections_detected FROM t_sections GROUP BY doc_id) USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS tn, count(*) FILTER (is_protected) AS tp FROM t_terms GROUP BY doc_id) USING (doc_id)""")
def analysis_stats(c: Corpus) -> DataFrame:
    stats = analytics.analysis_stats(c.typed, structure.section_table(c.sectioned), c.terms)
    return stats.withColumn("narrative", F.coalesce(F.try_element_at("paragraph_types", F.lit("narrativo")), F.lit(0))).drop("paragraph_types")


# --- patches and review --------------------------------------------------------------------------------

_PATCH_COLUMNS = ["patch_id", "doc_id", "paragraph_index", "position", "page_no", "source", "route", "review_status", "category", "severity", "original_text", "corrected_text"]


@query("corrections_list", f"SELECT {', '.join(_PATCH_COLUMNS)} FROM t_patches WHERE review_status = 'manual_review' AND page_no = 1")
def corrections_list(c: Corpus) -> DataFrame:
    return analytics.corrections_list(c.patches, "manual_review", 1).select(*_PATCH_COLUMNS)


@query("patch_layout", """SELECT p.patch_id, b.block_no, g.page_no, g.status FROM t_patches p JOIN t_blocks b ON b.doc_id = p.doc_id AND b.block_no = p.paragraph_index AND b.page_no = p.page_no
    JOIN t_pages g ON g.doc_id = b.doc_id AND g.page_no = b.page_no""")
def patch_layout(c: Corpus) -> DataFrame:
    rows = c.patches.withColumn("block_no", F.col("paragraph_index"))
    return analytics.join_layout(rows, c.blocks.select("doc_id", "page_no", "block_no"), c.layout_pages).select("patch_id", "block_no", "page_no", "status")


@query("patch_fanout", """SELECT patch_id, doc_id, paragraph_index, position, category, severity, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index, position) AS version FROM t_patches""")
def patch_fanout(c: Corpus) -> DataFrame:
    c.keep_proposals()
    return analytics.fan_out_versions(c.patches).select("patch_id", *KEY, "position", "category", "severity", "version")


@query("patch_costs", """SELECT p.patch_id, u.cost_e8::DOUBLE AS cost_e8, u.total_tokens::DOUBLE AS total_tokens, coalesce(u.calls, 0) AS calls FROM t_patches p LEFT JOIN (SELECT doc_id, paragraph_index, sum(cost_e8)::BIGINT AS cost_e8,
    sum(total_tokens)::BIGINT AS total_tokens, count(*) AS calls FROM t_usage GROUP BY ALL) u ON u.doc_id = p.doc_id AND u.paragraph_index = p.paragraph_index AND p.position = 0""")
def patch_costs(c: Corpus) -> DataFrame:
    c.keep_proposals()
    rows = analytics.with_cost(c.patches, c.usage)
    return rows.select("patch_id", *[F.col(n).cast("double").alias(n) for n in ("cost_e8", "total_tokens")], F.coalesce("calls", F.lit(0)).alias("calls"))


@query("facet_filter", f"SELECT {', '.join(_PATCH_COLUMNS)} FROM t_patches WHERE (contains(source, 'chatgpt') OR source = 'llm') AND severity = 'importante' AND (contains(lower(original_text), 'the') OR contains(lower(corrected_text), 'the'))")
def facet_filter(c: Corpus) -> DataFrame:
    return analytics.facet_filter(c.patches, source="llm", severity="importante", search="The").select(*_PATCH_COLUMNS)


@query("facet_values", "SELECT DISTINCT category FROM t_patches WHERE category <> ''")
def facet_values(c: Corpus) -> DataFrame:
    return analytics.categories(c.patches)


@query("facet_counts", """SELECT doc_id, count(*) AS total, count(*) FILTER (source = 'languagetool') AS rule_engine, count(*) FILTER (contains(source, 'chatgpt')) AS model,
    count(*) FILTER (route = 'skip') AS route_skip, count(*) FILTER (route = 'cheap') AS route_cheap, count(*) FILTER (route = 'editorial') AS route_editorial,
    count(*) FILTER (review_status = 'auto_accepted') AS validated, count(*) FILTER (review_status = 'manual_review') AS flagged, count(*) FILTER (review_status = 'gate_rejected') AS rejected
    FROM t_patches GROUP BY doc_id""")
def facet_counts(c: Corpus) -> DataFrame:
    return analytics.facet_counts(c.patches)


@query("top_categories", "SELECT category, count(*) AS corrections FROM t_patches WHERE category IS NOT NULL GROUP BY category ORDER BY corrections DESC, category LIMIT 4")
def top_categories(c: Corpus) -> DataFrame:
    return analytics.top_categories(c.patches)


@query("review_summary", f"""SELECT doc_id, count(*) AS total_patches, {', '.join(f"count(*) FILTER (review_status = '{s}') AS {s}" for s in V.REVIEW_STATUSES)},
    {', '.join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in V.SEVERITIES)},
    count(*) FILTER (review_status IN ('pending', 'manual_review')) = 0 AS can_finalize_strict, count(*) > 0 AS can_finalize_quick FROM t_decided GROUP BY doc_id""")
def review_summary(c: Corpus) -> DataFrame:
    c.keep_proposals()
    return analytics.review_summary(review.apply_decisions(c.patches, c.decisions, c.doc_status))


@query("review_by_page", "SELECT doc_id, page_no, review_status, count(*) AS patches FROM t_patches GROUP BY ALL")
def review_by_page(c: Corpus) -> DataFrame:
    return analytics.review_by_page(c.patches)


@query("pages_with_patch_counts", """SELECT g.doc_id, g.page_no, g.status, count(p.patch_id) AS patches FROM t_pages g LEFT JOIN t_patches p ON p.doc_id = g.doc_id AND p.page_no = g.page_no GROUP BY ALL""")
def pages_with_patch_counts(c: Corpus) -> DataFrame:
    return analytics.pages_with_patch_counts(c.layout_pages, c.patches)


@query("pages_by_status", "SELECT doc_id, status, count(*) AS pages FROM t_pages GROUP BY ALL")
def pages_by_status(c: Corpus) -> DataFrame:
    return analytics.pages_by_status(c.layout_pages)


@query("decision_verdicts", "SELECT verdict, action, count(*) AS decisions FROM t_checked GROUP BY ALL")
def decision_verdicts(c: Corpus) -> DataFrame:
    return review.check_decisions(c.decisions, c.patches, c.doc_status).groupBy("verdict", "action").agg(F.count("*").alias("decisions"))


@query("apply_decisions", "SELECT patch_id, review_status, decision_source FROM t_decided")
def apply_decisions(c: Corpus) -> DataFrame:
    c.keep_proposals()
    return review.apply_decisions(c.patches, c.decisions, c.doc_status).select("patch_id", "review_status", "decision_source")


@query("bulk_lookup", """SELECT d.patch_id, p.patch_id IS NOT NULL AS found FROM (SELECT DISTINCT patch_id FROM t_decisions) d LEFT JOIN t_patches p USING (patch_id)""")
def bulk_lookup(c: Corpus) -> DataFrame:
    c.keep_proposals()
    found, missing = review.bulk_lookup(c.decisions, c.patches)
    return found.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))


@query("finalize_quick", """SELECT p.patch_id, CASE WHEN s.status IN ('pending_review', 'candidate_ready') AND p.review_status IN ('pending', 'manual_review') THEN 'bulk_finalized' ELSE p.review_status END AS review_status
    FROM t_patches p JOIN t_status s USING (doc_id)""")
def finalize_quick(c: Corpus) -> DataFrame:
    return review.finalize_quick(c.patches, c.doc_status).select("patch_id", "review_status")


@query("finalize_strict", """SELECT s.doc_id, s.status, count(p.patch_id) AS patches, count(p.patch_id) FILTER (p.review_status IN ('pending', 'manual_review')) AS unresolved,
    s.status IN ('pending_review', 'candidate_ready') AND count(p.patch_id) FILTER (p.review_status IN ('pending', 'manual_review')) = 0 AS can_finalize
    FROM t_status s LEFT JOIN t_patches p USING (doc_id) GROUP BY s.doc_id, s.status""")
def finalize_strict(c: Corpus) -> DataFrame:
    return review.finalize_strict(c.patches, c.doc_status)


@query("transitions", f"""SELECT doc_id, status, status IN {O.in_list(V.PROCESSABLE_STATES)} AS can_process, status IN {O.in_list(V.REVIEWABLE_STATES)} AS can_review,
    status IN {O.in_list(V.FINALIZABLE_STATES)} AS can_finalize, status = 'completed' AS can_reopen, CASE WHEN status = 'completed' THEN 'candidate_ready' ELSE status END AS status_if_reopened FROM t_status""")
def transitions(c: Corpus) -> DataFrame:
    return review.transitions(c.doc_status)


@query("manual_edits", "SELECT event_id, patch_id, edited_text, verdict FROM t_edits")
def manual_edits(c: Corpus) -> DataFrame:
    c.keep_proposals()
    return review.manual_edits(c.patches, c.edits.drop("doc_id").join(c.patches.select("patch_id", "doc_id"), "patch_id"), c.doc_status).select("event_id", "patch_id", "edited_text", "verdict")


def _edited(c: Corpus) -> DataFrame:
    decided = review.apply_decisions(c.patches, c.decisions, c.doc_status)
    return review.apply_edits(decided, review.manual_edits(c.patches, c.edits, c.doc_status))


@query("effective_text", "SELECT patch_id, coalesce(nullif(edited_text, ''), corrected_text) AS text, review_status, decision_source FROM t_edited")
def effective_text(c: Corpus) -> DataFrame:
    c.keep_proposals()
    return _edited(c).select("patch_id", review.effective_text(F.col("edited_text"), F.col("corrected_text")).alias("text"), "review_status", "decision_source")


@query("recorrection_limits", """SELECT event_id, doc_id, patch_id, request_no, in_hour, CASE WHEN request_no > 3 THEN 'patch_limit' WHEN in_hour > 20 THEN 'hour_limit' ELSE 'allowed' END AS verdict
    FROM (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY ts, event_id) AS request_no,
        count(*) OVER (PARTITION BY doc_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour FROM t_decisions WHERE action = 'recorrect')""")
def recorrection_limits(c: Corpus) -> DataFrame:
    asked = c.decisions.filter("action = 'recorrect'")
    return review.recorrection_limits(asked).drop("ts")


@query("recorrections", """SELECT p.patch_id, CASE WHEN ok THEN new_text ELSE corrected_text END AS corrected_text, CASE WHEN ok THEN 'pending' ELSE review_status END AS review_status
    FROM (SELECT p.*, r.new_text, coalesce(r.new_text <> '' AND length(r.new_text) <= length(p.original_text) * 2.2::DOUBLE, false) AS ok FROM t_patches p
        LEFT JOIN (SELECT DISTINCT d.patch_id, q.original_text || repeat('.', (q.doc_id % 50)::BIGINT) AS new_text FROM t_decisions d JOIN t_patches q USING (patch_id) WHERE d.action = 'recorrect') r USING (patch_id)) p""")
def recorrections(c: Corpus) -> DataFrame:
    c.keep_proposals()
    asked = c.decisions.filter("action = 'recorrect'").select("patch_id").distinct()
    new = F.concat("original_text", F.expr("repeat('.', cast(doc_id % 50 as int))"))
    results = c.patches.join(asked, "patch_id", "left_semi").select("patch_id", new.alias("new_text"))
    return review.apply_recorrections(c.patches, results).select("patch_id", "corrected_text", "review_status")


@query("one_per_paragraph", """SELECT doc_id, paragraph_index, arg_min(corrected_text, position) AS corrected_text, array_to_string(list(patch_id ORDER BY patch_id), '|') AS patch_ids FROM t_patches GROUP BY ALL""")
def one_per_paragraph(c: Corpus) -> DataFrame:
    return review.one_per_paragraph(c.patches).select(*KEY, "corrected_text", joined("patch_ids").alias("patch_ids"))


def _render_sql(where: str, source: str) -> str:
    return f"""SELECT doc_id, string_agg(CASE WHEN fits THEN new ELSE text END, chr(10) ORDER BY paragraph_index) AS text,
    count(*) FILTER (fits) AS applied, count(*) FILTER (old IS NOT NULL AND NOT fits) AS stale
    FROM (SELECT p.doc_id, p.paragraph_index, p.text, x.old, x.new, coalesce({O.strip('p.text')} = x.old, false) AS fits FROM t_paras p
        LEFT JOIN (SELECT doc_id, location, arg_min(original_text, position) AS old, arg_min(coalesce(nullif(edited_text, ''), corrected_text), position) AS new
            FROM ({source}) WHERE {where} GROUP BY ALL) x ON x.doc_id = p.doc_id AND x.location = p.location) GROUP BY ALL"""


@query("final_render", _render_sql(f"review_status IN {O.in_list(V.APPLY_MODES['accepted_and_auto'])}", "SELECT * FROM t_edited"))
def final_render(c: Corpus) -> DataFrame:
    c.keep_changes()
    return review.render(review.apply_to_text(c.paragraphs, review.approved(_edited(c)), review.paragraph_texts(c.patches)))


@query("candidate_render", _render_sql("review_status NOT IN ('rejected', 'gate_rejected')", "SELECT *, NULL::VARCHAR AS edited_text FROM t_patches"))
def candidate_render(c: Corpus) -> DataFrame:
    c.keep_changes()
    return review.render(review.apply_to_text(c.paragraphs, review.not_rejected(c.patches), review.paragraph_texts(c.patches)))


@query("apply_modes", f"""SELECT m.mode, review_status, count(*) AS patches FROM t_decided, (VALUES ('accepted_only'), ('accepted_and_auto'), ('all')) m(mode)
    WHERE mode = 'all' OR (mode = 'accepted_only' AND review_status = 'accepted') OR (mode = 'accepted_and_auto' AND review_status IN {O.in_list(V.APPLY_MODES['accepted_and_auto'])}) GROUP BY ALL""")
def apply_modes(c: Corpus) -> DataFrame:
    c.keep_patches(["patch_id", "review_status"])
    decided = review.apply_decisions(c.patches, c.decisions, c.doc_status)
    modes = F.array(*[F.when(F.col("review_status").isin(s), F.lit(m)) for m, s in V.APPLY_MODES.items()])
    return decided.select("review_status", F.explode(F.array_compact(modes)).alias("mode")).groupBy("mode", "review_status").agg(F.count("*").alias("patches"))


@query("cascade_delete", """SELECT 'paragraphs' AS table_name, count(*) AS kept FROM t_paras WHERE doc_id % 4 <> 1 UNION ALL SELECT 'patches', count(*) FROM t_patches WHERE doc_id % 4 <> 1
    UNION ALL SELECT 'usage', count(*) FROM t_usage WHERE doc_id % 4 <> 1""")
def cascade_delete(c: Corpus) -> DataFrame:
    c.keep_proposals()
    gone = c.documents.filter("doc_id % 4 = 1")
    counts = [
        review.delete_documents(t.select("doc_id"), gone).agg(F.lit(n).alias("table_name"), F.count("*").alias("kept"))
        for n, t in (("paragraphs", c.paragraphs), ("patches", c.patches), ("usage", c.usage))
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("merge_patches", """SELECT coalesce(p.doc_id, n.doc_id) AS doc_id, coalesce(p.paragraph_index, n.paragraph_index) AS paragraph_index, CASE WHEN n.doc_id IS NULL THEN p.corrected_text ELSE n.new END AS corrected_text,
    CASE WHEN n.doc_id IS NULL THEN 'keep' WHEN n.new IS NULL THEN 'drop' WHEN p.doc_id IS NULL THEN 'add' WHEN n.new <> p.corrected_text THEN 'replace' ELSE 'keep' END AS action
    FROM t_changes p FULL JOIN (SELECT doc_id, paragraph_index, CASE WHEN doc_id % 2 = 0 THEN stripped || '!' END AS new FROM t_proposals JOIN (SELECT doc_id, start_paragraph AS paragraph_index FROM t_batches) USING (doc_id, paragraph_index)) n
      ON n.doc_id = p.doc_id AND n.paragraph_index = p.paragraph_index WHERE NOT (p.doc_id IS NULL AND n.new IS NULL)""")
def merge_patches(c: Corpus) -> DataFrame:
    c.keep_proposals()
    heads = c.batches.select("doc_id", F.col("start_paragraph").alias("paragraph_index"))
    again = c.proposals.join(heads, KEY).select(*KEY, F.when(F.col("doc_id") % 2 == 0, F.concat("stripped", F.lit("!"))).alias("corrected_text"))
    return match.merge_patches(c.patches.filter("position = 0"), again)


@query("second_pass_merge", """SELECT doc_id, paragraph_index, pass1_text, final AS corrected_text, CASE WHEN src IS NULL AND final <> pass1_text THEN 'chatgpt+audit' WHEN final <> pass1_text THEN src || '+audit' ELSE src END AS source,
    final <> stripped AS is_patch FROM (SELECT p.doc_id, p.paragraph_index, p.stripped, p.final_text AS pass1_text, CASE WHEN p.changed THEN p.origin END AS src, coalesce(nullif(u.t, ''), p.final_text) AS final
    FROM t_proposals p LEFT JOIN (SELECT doc_id, paragraph_index, CASE WHEN doc_id % 3 = 0 THEN final_text ELSE rtrim(final_text, '.') END AS t FROM t_usage WHERE pass_number = 2) u USING (doc_id, paragraph_index))""")
def second_pass_merge(c: Corpus) -> DataFrame:
    c.keep_proposals()
    first = c.proposals.select(*KEY, F.col("stripped").alias("original_text"), F.col("final_text").alias("corrected_text"), F.when(F.col("changed"), F.col("origin")).alias("source"))
    second = c.usage.filter("pass_number = 2").select(*KEY, F.when(F.col("doc_id") % 3 == 0, F.col("final_text")).otherwise(F.rtrim("final_text", F.lit("."))).alias("final_text"))
    return corrector.second_pass_merge(first, second).drop("original_text")


@query("corrector_batches", f"""SELECT doc_id, batch_index, paragraph_index, stripped AS original_text, corrected AS corrected_text,
    CASE WHEN rn = 1 THEN seed ELSE lag(corrected) OVER (PARTITION BY doc_id, batch_index ORDER BY paragraph_index) END AS context
    FROM (SELECT *, CASE WHEN coalesce(prev, '') <> '' AND pass0_text <> '' AND NOT contains({O.q(V.SENTENCE_CLOSERS)}, right(prev, 1)) THEN lower(left(pass0_text, 1)) || substr(pass0_text, 2) ELSE pass0_text END AS corrected
        FROM (SELECT *, CASE WHEN rn = 1 THEN seed ELSE lag(pass0_text) OVER (PARTITION BY doc_id, batch_index ORDER BY paragraph_index) END AS prev
            FROM (SELECT p.doc_id, p.paragraph_index, p.stripped, p.pass0_text, b.batch_index, b.start_paragraph, row_number() OVER (PARTITION BY b.doc_id, b.batch_index ORDER BY p.paragraph_index) AS rn,
                CASE WHEN b.batch_index > 0 THEN (SELECT nullif(arg_max(left(z.pass0_text, 200), z.paragraph_index), '') FROM t_pass0 z WHERE z.doc_id = b.doc_id AND z.paragraph_index BETWEEN b.start_paragraph - 5 AND b.start_paragraph - 1) END AS seed
                FROM t_pass0 p JOIN t_batches b ON b.doc_id = p.doc_id AND p.paragraph_index BETWEEN b.start_paragraph AND b.end_paragraph)))""")
def corrector_batches(c: Corpus) -> DataFrame:
    return corrector.correct_batches(_pass0(c), c.batches, corrector.stock_corrector).drop("head_text", "is_tail")


_lowered = "CASE WHEN coalesce({0}, '') <> '' AND pass0_text <> '' AND NOT contains(" + O.q(V.SENTENCE_CLOSERS) + ", right({0}, 1)) THEN lower(left(pass0_text, 1)) || substr(pass0_text, 2) ELSE pass0_text END"


@query("assembled_patches", f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index) - 1 AS patch_no, paragraph_index, new AS corrected_text,
    CASE WHEN old = new THEN 'keep' WHEN old = stripped THEN 'add' ELSE 'replace' END AS action
    FROM (SELECT *, {_lowered.format('CASE WHEN rn = 1 THEN approx ELSE before END')} AS old, {_lowered.format('CASE WHEN rn = 1 THEN real ELSE before END')} AS new
        FROM (SELECT p.doc_id, p.paragraph_index, p.stripped, p.pass0_text, row_number() OVER batch AS rn, lag(p.pass0_text) OVER batch AS before,
            left(lag(p.pass0_text) OVER (PARTITION BY p.doc_id ORDER BY p.paragraph_index), 200) AS real,
            CASE WHEN b.batch_index > 0 THEN (SELECT nullif(arg_max(left(z.pass0_text, 200), z.paragraph_index), '') FROM t_pass0 z WHERE z.doc_id = b.doc_id AND z.paragraph_index BETWEEN f.first_usable - 5 AND f.first_usable - 1) END AS approx
            FROM t_pass0 p JOIN t_batches b ON b.doc_id = p.doc_id AND p.paragraph_index BETWEEN b.start_paragraph AND b.end_paragraph
            JOIN (SELECT b.doc_id, b.batch_index, b.start_paragraph AS first_usable FROM t_batches b) f ON f.doc_id = b.doc_id AND f.batch_index = b.batch_index
            WINDOW batch AS (PARTITION BY b.doc_id, b.batch_index ORDER BY p.paragraph_index)))
    WHERE new <> stripped""")
def assembled_patches(c: Corpus) -> DataFrame:
    """Batches corrected side by side, their first texts corrected again after the real text before, and all patches in order."""
    corrected = store(corrector.to_assemble(corrector.correct_batches(_pass0(c), c.batches, corrector.stock_corrector)), "corrected")
    heads = corrected.filter("head_text is not null").select(*KEY, F.col("head_text").alias("pass0_text"))
    return corrector.assembled_patches(corrected, corrector.repaired_heads(corrected, heads, corrector.stock_corrector))


# --- matching ------------------------------------------------------------------------------------------


@query("block_match", f"""SELECT doc_id, paragraph_index, est_page,
    CASE WHEN pre IS NOT NULL THEN pre.page_no WHEN sim.score >= 0.3::DOUBLE THEN sim.page_no ELSE coalesce(pf.page_no, df.page_no) END AS page_no,
    CASE WHEN pre IS NOT NULL THEN pre.block_no WHEN sim.score >= 0.3::DOUBLE THEN sim.block_no ELSE coalesce(pf.block_no, df.block_no) END AS block_no,
    CASE WHEN pre IS NOT NULL THEN 'prefix' WHEN sim.score >= 0.3::DOUBLE THEN 'similar' ELSE 'fallback' END AS how, sim.score AS score
    FROM (SELECT c.doc_id, c.paragraph_index, c.est_page, (SELECT min({{'page_no': b.page_no, 'block_no': b.block_no}}) FROM x_blocks b WHERE b.doc_id = c.doc_id AND b.norm <> '' AND left(b.norm, 50) = left(c.norm, 50)) AS pre,
        s.sim, (SELECT min({{'page_no': b.page_no, 'block_no': b.block_no}}) FROM x_blocks b WHERE b.doc_id = c.doc_id AND b.page_no = c.est_page) AS pf,
        (SELECT min({{'page_no': b.page_no, 'block_no': b.block_no}}) FROM x_blocks b WHERE b.doc_id = c.doc_id) AS df
        FROM x_changes c LEFT JOIN (SELECT c.doc_id, c.paragraph_index, first({{'page_no': b.page_no, 'block_no': b.block_no, 'score': b.score}} ORDER BY b.score > 0.8::DOUBLE DESC, CASE WHEN b.score > 0.8::DOUBLE THEN 0 ELSE -b.score END, b.page_no, b.block_no) AS sim
            FROM x_changes c JOIN LATERAL (SELECT b.page_no, b.block_no, {O.jaccard('left(c.norm, 200)', 'left(b.norm, 200)')} AS score FROM x_blocks b
                WHERE b.doc_id = c.doc_id AND b.norm <> '' AND c.norm <> '' AND b.page_no BETWEEN c.est_page - 3 AND c.est_page + 3) b ON true
            WHERE NOT EXISTS (SELECT 1 FROM x_blocks z WHERE z.doc_id = c.doc_id AND z.norm <> '' AND left(z.norm, 50) = left(c.norm, 50)) GROUP BY ALL) s USING (doc_id, paragraph_index))""")
def block_match(c: Corpus) -> DataFrame:
    return match.match_blocks(c.patches.filter("position = 0"), c.blocks, "jaccard")


@query("block_match_exact")
def block_match_exact(c: Corpus) -> DataFrame:
    return match.match_blocks(c.patches.filter("position = 0"), c.blocks, "difflib")


@query("locate_on_page", """SELECT doc_id, paragraph_index, est_page, hit.page_no::DOUBLE AS page_no, hit.length::DOUBLE AS matched_length, hit.at::DOUBLE AS at, coalesce(hit.far = 0, false) AS is_near FROM (
    SELECT c.doc_id, c.paragraph_index, c.est_page, (SELECT min({'rank': k.rank, 'far': CASE WHEN abs(g.page_no - c.est_page) <= 2 THEN 0 ELSE 1 END, 'page_no': g.page_no,
        'length': length(left(c.corrected_text, k.size)), 'at': instr(g.page_text, left(c.corrected_text, k.size))})
        FROM x_page_texts g, (VALUES (0, 150), (1, 70), (2, 35)) k(rank, size) WHERE g.doc_id = c.doc_id AND contains(g.page_text, left(c.corrected_text, k.size))) AS hit
    FROM (SELECT doc_id, paragraph_index, est_page, x_text AS corrected_text FROM x_changes) c WHERE length(c.corrected_text) >= 4)""")
def locate_on_page(c: Corpus) -> DataFrame:
    c.keep_changes()
    corrected = review.apply_to_text(c.paragraphs, review.not_rejected(c.patches), review.paragraph_texts(c.patches))
    rows = match.locate_on_pages(c.patches.filter("position = 0"), match.page_texts(match.blocks(corrected)))
    place = [F.col(n).cast("double").alias(n) for n in ("page_no", "matched_length", "at")]
    return rows.select(*KEY, "est_page", *place, F.coalesce("is_near", F.lit(False)).alias("is_near"))


@query("location_backfill", """SELECT p.patch_id, l.location FROM t_patches p LEFT JOIN (SELECT doc_id, paragraph_index, left(text, 50) AS head, max(location) AS location FROM t_paras GROUP BY ALL) l
    ON l.doc_id = p.doc_id AND l.paragraph_index = p.paragraph_index AND l.head = left(p.original_text, 50)""")
def location_backfill(c: Corpus) -> DataFrame:
    return match.backfill_location(c.patches, c.paragraphs).select("patch_id", "location")


@query("annotation_match", """SELECT annotation_id, patch_id, how FROM (
    SELECT p.patch_id AS annotation_id, x.patch_id, 'id' AS how FROM t_changes p JOIN t_patches x ON x.doc_id = p.doc_id AND x.paragraph_index = p.paragraph_index WHERE p.paragraph_index % 2 = 0
    UNION ALL SELECT p.patch_id, x.patch_id, 'text' FROM t_changes p JOIN t_patches x ON x.doc_id = p.doc_id AND starts_with(x.original_text, left(p.original_text, 50)) AND starts_with(x.corrected_text, left(p.corrected_text, 50)) WHERE p.paragraph_index % 2 = 1)""")
def annotation_match(c: Corpus) -> DataFrame:
    """Annotations of even paragraphs carry the ids of their patches, the others only snippets."""
    c.keep_proposals()
    even = F.col("paragraph_index") % 2 == 0
    notes = review.one_per_paragraph(c.patches).select(
        F.concat_ws("-", "doc_id", "paragraph_index", F.lit("0")).alias("annotation_id"), "doc_id",
        F.when(even, F.col("patch_ids")).otherwise(F.array().cast("array<string>")).alias("patch_ids"),
        F.left("original_text", F.lit(100)).alias("original_snippet"), F.left("corrected_text", F.lit(100)).alias("corrected_snippet"),
    )
    return match.match_annotations(notes, c.patches).drop("doc_id")


# --- flow, cost, audit, documents --------------------------------------------------------------------------


@query("correction_flow", """SELECT doc_id, paragraph_index, block_no, type, context_blocks, cost_e8::DOUBLE AS cost_e8, row_number() OVER (PARTITION BY doc_id ORDER BY block_no, k) AS step FROM (
    SELECT p.doc_id, p.paragraph_index, p.block_no, s.k, s.type, CASE WHEN s.k = 0 THEN 0 ELSE p.block_no END AS context_blocks, CASE WHEN s.k = 1 THEN u.cost_e8 END AS cost_e8
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index, position) - 1 AS block_no FROM t_patches) p
    JOIN (VALUES (0, 'languagetool'), (1, 'chatgpt_style')) s(k, type) ON (s.k = 0 AND p.rule_hits > 0) OR (s.k = 1 AND contains(p.source, 'chatgpt'))
    LEFT JOIN (SELECT doc_id, paragraph_index, sum(cost_e8)::BIGINT AS cost_e8 FROM t_usage GROUP BY ALL) u ON u.doc_id = p.doc_id AND u.paragraph_index = p.paragraph_index)""")
def correction_flow(c: Corpus) -> DataFrame:
    c.keep_proposals()
    rows = analytics.correction_flow(c.patches, c.usage).drop("context_preview")
    return rows.withColumn("cost_e8", F.col("cost_e8").cast("double"))


@query("flow_summary", """SELECT p.*, coalesce(u.cost, 0)::DOUBLE AS total_cost_usd FROM (SELECT doc_id, count(*) AS total_blocks, count(*) FILTER (rule_hits > 0) + count(*) FILTER (contains(source, 'chatgpt')) AS total_requests,
    count(*) FILTER (source = 'languagetool') AS rule_requests, count(*) FILTER (contains(source, 'chatgpt')) AS model_requests FROM t_patches GROUP BY doc_id) p
    LEFT JOIN (SELECT doc_id, (sum(cost_e8)::DECIMAL(28,0) / 100000000)::DECIMAL(18,8) AS cost FROM t_usage GROUP BY doc_id) u USING (doc_id)""")
def flow_summary(c: Corpus) -> DataFrame:
    c.keep_proposals()
    rows = analytics.flow_summary(c.patches, c.usage)
    return rows.withColumn("total_cost_usd", F.col("total_cost_usd").cast("double"))


@query("cost_summary", """SELECT count(*) AS total_calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(total_tokens)::BIGINT AS total_tokens,
    count(DISTINCT doc_id) AS total_documents, (sum(cost_e8)::DECIMAL(28,0) / 100000000)::DECIMAL(18,8)::DOUBLE AS total_cost_usd,
    sum(cost_e8)::DOUBLE / greatest(count(DISTINCT doc_id), 1)::DOUBLE AS avg_e8_per_document, sum(cost_e8)::DOUBLE / greatest(count(*), 1)::DOUBLE AS avg_e8_per_call FROM t_usage""")
def cost_summary(c: Corpus) -> DataFrame:
    return analytics.cost_summary(c.usage).withColumn("total_cost_usd", F.col("total_cost_usd").cast("double"))


@query("cost_by_model", """SELECT model_used, count(*) AS calls, sum(total_tokens)::BIGINT AS tokens, (sum(cost_e8)::DECIMAL(28,0) / 100000000)::DECIMAL(18,8)::DOUBLE AS cost_usd
    FROM t_usage GROUP BY GROUPING SETS ((), (model_used))""")
def cost_by_model(c: Corpus) -> DataFrame:
    return analytics.cost_by_model(c.usage).withColumn("cost_usd", F.col("cost_usd").cast("double"))


_COST_DOC = """SELECT s.doc_id, s.status, s.total_pages, s.created_at, count(*) AS total_calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
    sum(total_tokens)::BIGINT AS total_tokens, (sum(cost_e8)::DECIMAL(28,0) / 100000000)::DECIMAL(18,8)::DOUBLE AS total_cost_usd FROM t_status s JOIN t_usage u USING (doc_id) GROUP BY ALL"""


@query("cost_by_document", _COST_DOC)
def cost_by_document(c: Corpus) -> DataFrame:
    rows = c.doc_status.select("doc_id", "status", "total_pages", "created_at")
    return analytics.cost_by_document(c.usage, rows).withColumn("total_cost_usd", F.col("total_cost_usd").cast("double"))


@query("cost_page", f"SELECT doc_id, total_tokens FROM ({_COST_DOC}) ORDER BY created_at DESC, doc_id LIMIT 50 OFFSET 50")
def cost_page(c: Corpus) -> DataFrame:
    """One page of the document list: paging itself is the feature."""
    rows = cost_by_document(c)
    return analytics.paged(rows, [F.col("created_at").desc(), F.col("doc_id")], 50, 50).select("doc_id", "total_tokens")


@query("document_totals", """SELECT s.doc_id, CASE WHEN u.t IS NULL AND s.doc_id % 7 > 0 THEN s.doc_id % 7 * 100 ELSE coalesce(u.t, 0) END AS total_tokens,
    CASE WHEN u.t IS NULL AND s.doc_id % 7 > 0 THEN s.doc_id % 7 * 5000 ELSE coalesce(u.c, 0) END AS cost_e8, u.t IS NULL AND s.doc_id % 7 > 0 AS is_legacy
    FROM t_status s LEFT JOIN (SELECT doc_id, sum(total_tokens)::BIGINT AS t, sum(cost_e8)::BIGINT AS c FROM t_usage GROUP BY doc_id) u USING (doc_id)""")
def document_totals(c: Corpus) -> DataFrame:
    legacy = F.col("doc_id") % 7
    rows = c.doc_status.select("doc_id", (legacy * 100).alias("legacy_tokens"), (legacy * 5000).alias("legacy_cost_e8"))
    return analytics.document_totals(rows, c.usage)


@query("cost_by_paragraph", "SELECT doc_id, paragraph_index, sum(cost_e8)::BIGINT AS cost_e8, count(*) AS calls FROM t_usage GROUP BY ALL")
def cost_by_paragraph(c: Corpus) -> DataFrame:
    return c.usage.groupBy(*KEY).agg(F.sum("cost_e8").alias("cost_e8"), F.count("*").alias("calls"))


@query("cost_share", """SELECT doc_id, cost_e8, cost_e8::DOUBLE / max(cost_e8) OVER ()::DOUBLE AS share FROM (SELECT doc_id, sum(cost_e8)::BIGINT AS cost_e8 FROM t_usage GROUP BY doc_id)""")
def cost_share(c: Corpus) -> DataFrame:
    return analytics.cost_share(c.usage)


@query("audit_list", "SELECT doc_id, paragraph_index, pass_number, call_purpose, model_used, total_tokens, error_text FROM t_audit WHERE pass_number = 2 AND error_text IS NOT NULL")
def audit_list(c: Corpus) -> DataFrame:
    return analytics.audit_list(c.audit, 2, "contextual_audit", True).select(*KEY, "pass_number", "call_purpose", "model_used", "total_tokens", "error_text")


@query("audit_detail", """SELECT doc_id, paragraph_index, count(*) AS calls, array_to_string(list(call_purpose ORDER BY pass_number), '|') AS purposes, array_to_string(list(model_used ORDER BY pass_number), '|') AS models FROM t_audit GROUP BY ALL""")
def audit_detail(c: Corpus) -> DataFrame:
    rows = analytics.audit_detail(c.audit)
    return rows.select(*KEY, F.size("calls").cast("long").alias("calls"), joined("calls.call_purpose").alias("purposes"), joined("calls.model_used").alias("models"))


@query("audit_stats", """SELECT doc_id, count(*) AS total_calls, count(*) FILTER (pass_number = 1) AS pass1_calls, count(*) FILTER (pass_number = 2) AS pass2_calls,
    count(DISTINCT paragraph_index) AS paragraphs_with_audit, sum(reversions)::BIGINT AS reversions, count(error_text) AS errors FROM t_audit GROUP BY doc_id""")
def audit_stats(c: Corpus) -> DataFrame:
    return analytics.audit_stats(c.audit)


@query("audit_by_paragraph", """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN -1 ELSE paragraph_index END AS paragraph_index, count(*) AS calls, sum(total_tokens)::BIGINT AS tokens, true AS has_pass2
    FROM t_audit GROUP BY ALL HAVING bool_or(pass_number = 2)""")
def audit_by_paragraph(c: Corpus) -> DataFrame:
    rows = c.audit.withColumn("paragraph_index", F.when(F.col("doc_id") % 9 != 0, F.col("paragraph_index")))
    return analytics.audit_by_paragraph(rows, True).drop("passes")


@query("audit_diff", """SELECT coalesce(p.doc_id, a.doc_id) AS doc_id, coalesce(p.paragraph_index, a.paragraph_index) AS paragraph_index, p.original_text, a.pass1_text, p.final_text, a.t1::DOUBLE AS pass1_tokens, a.t2::DOUBLE AS pass2_tokens, a.t2 IS NOT NULL AS has_pass2
    FROM (SELECT doc_id, paragraph_index, arg_max(original_text, position) AS original_text, arg_max(corrected_text, position) AS final_text FROM t_patches GROUP BY ALL) p
    FULL JOIN (SELECT doc_id, paragraph_index, max(pass0_text) FILTER (pass_number = 1) AS pass1_text, max(total_tokens) FILTER (pass_number = 1) AS t1, max(total_tokens) FILTER (pass_number = 2) AS t2 FROM t_audit GROUP BY ALL) a
      ON a.doc_id = p.doc_id AND a.paragraph_index = p.paragraph_index""")
def audit_diff(c: Corpus) -> DataFrame:
    c.keep_proposals()
    rows = analytics.audit_diff(c.patches, c.audit).drop("review_status", "pass1_model", "pass2_model")
    return rows.withColumns({n: F.col(n).cast("double") for n in ("pass1_tokens", "pass2_tokens")})


@query("progress_eta", """SELECT s.doc_id, s.status, CASE WHEN s.status = 'completed' THEN 1.0::DOUBLE WHEN s.status IN ('pending_review', 'candidate_ready') THEN 0.85::DOUBLE
        WHEN s.status IN ('uploaded', 'failed') THEN 0.0::DOUBLE ELSE g.stage_start + (g.stage_end - g.stage_start) * least(s.stage_current::DOUBLE / s.stage_total::DOUBLE, 1.0::DOUBLE) END AS progress,
    CASE WHEN NOT idle THEN g.stage_label END AS stage_label, coalesce(CASE WHEN NOT idle THEN stalled END, false) AS is_stalled,
    CASE WHEN NOT idle AND s.stage_current > 0 AND NOT stalled THEN (s.stage_total - s.stage_current)::DOUBLE / (s.stage_current::DOUBLE / elapsed::DOUBLE) END AS eta_seconds
    FROM (SELECT *, status IN ('uploaded', 'completed', 'pending_review', 'candidate_ready') AS idle, doc_id % 300 > 120 AS stalled, doc_id % 3600 + 60 AS elapsed FROM t_status) s LEFT JOIN t_stages g USING (status)""")
def progress_eta(c: Corpus) -> DataFrame:
    return analytics.progress(c.doc_status).withColumn("is_stalled", F.coalesce("is_stalled", F.lit(False)))


@query("dashboard", """SELECT count(*) AS documents, count(*) FILTER (status NOT IN ('uploaded', 'completed', 'failed', 'pending_review', 'candidate_ready')) AS processing,
    count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, sum(total_pages)::BIGINT AS total_pages FROM t_status""")
def dashboard(c: Corpus) -> DataFrame:
    return analytics.dashboard(c.doc_status)


@query("point_lookup", """SELECT p.patch_id, p.corrected_text, u.cost_e8::DOUBLE AS cost_e8 FROM t_patches p LEFT JOIN (SELECT doc_id, paragraph_index, sum(cost_e8)::BIGINT AS cost_e8 FROM t_usage GROUP BY ALL) u
    ON u.doc_id = p.doc_id AND u.paragraph_index = p.paragraph_index AND p.position = 0 WHERE p.patch_id IN (SELECT patch_id FROM t_decisions)""")
def point_lookup(c: Corpus) -> DataFrame:
    """Single corrections with their cost, for all requested ids at once."""
    c.keep_proposals(triage.PATCH_AND_USAGE)
    wanted = c.decisions.select("patch_id").distinct()
    return analytics.with_cost(c.patches.join(wanted, "patch_id", "left_semi"), c.usage).select("patch_id", "corrected_text", F.col("cost_e8").cast("double").alias("cost_e8"))


@query("error_catalogue", """SELECT category, count(*) FILTER (run = 'A' AND ok) AS "A_fixed", count(*) FILTER (run = 'A') AS "A_errors", count(*) FILTER (run = 'B' AND ok) AS "B_fixed", count(*) FILTER (run = 'B') AS "B_errors" FROM (
    SELECT CASE WHEN contains(stripped, '!!') THEN 'punctuation' ELSE 'noise' END AS category, run, CASE WHEN contains(stripped, '!!') THEN contains(t, '!') AND NOT contains(t, '!!') ELSE NOT contains(t, CASE WHEN contains(stripped, '###') THEN '###' ELSE '$$$' END) END AS ok
    FROM (SELECT *, unnest(['A', 'B']) AS run, unnest([stripped, final_text]) AS t FROM t_proposals WHERE contains(stripped, '!!') OR contains(stripped, '###') OR contains(stripped, '$$$'))) GROUP BY category""")
def error_catalogue(c: Corpus) -> DataFrame:
    """Known defects of the corpus against the text before (run A) and after (run B) correction."""
    c.keep_proposals()
    s = F.col("stripped")
    wrong = F.when(F.contains(s, F.lit("!!")), "!!").when(F.contains(s, F.lit("###")), "###").when(F.contains(s, F.lit("$$$")), "$$$")
    rows = c.proposals.withColumn("wrong", wrong).filter("wrong is not null")
    catalogue = rows.select(*KEY, F.when(F.col("wrong") == "!!", "punctuation").otherwise("noise").alias("category"), "wrong",
                            F.when(F.col("wrong") == "!!", "!").otherwise("").alias("expected"))
    runs = rows.select(*KEY, F.explode(F.create_map(F.lit("A"), s, F.lit("B"), F.col("final_text"))).alias("run", "text"))
    return analytics.error_catalogue(catalogue, runs)


@query("sql_functions", f"""SELECT doc_id, paragraph_index, {O.readability('stripped')} AS score, paragraph_type FROM t_typed""")
def sql_functions(c: Corpus) -> DataFrame:
    from redline.functions import sql

    sql.register(c.spark)
    c.paragraphs.createOrReplaceTempView("redline_paragraphs")
    return c.spark.sql(
        "SELECT doc_id, paragraph_index, readability(strip_text(text)) AS score, "
        "paragraph_type(strip_text(text), location, style_name, is_in_table) AS paragraph_type FROM redline_paragraphs"
    )


@query("sql_route", "SELECT doc_id, paragraph_index, route, route_reason FROM t_routed")
def sql_route(c: Corpus) -> DataFrame:
    from redline.functions import sql

    sql.register(c.spark)
    c.prepared.createOrReplaceTempView("redline_prepared")
    return c.spark.sql(
        "SELECT doc_id, paragraph_index, r.route AS route, r.reason AS route_reason FROM (SELECT doc_id, paragraph_index, "
        "route_of(pass0_text, paragraph_type, size(ops), intervention_level, is_transition, section_position) AS r FROM redline_prepared)"
    )


# --- streams -------------------------------------------------------------------------------------------


def _events(c: Corpus) -> DataFrame:
    return jobs.event_stream(c.spark, f"{c.path}/events.parquet")


def _sink(c: Corpus, name: str) -> str:
    return jobs.new_folder(c.spark, name)


@query("stream_stalls", """SELECT user_id, min(ts) AS started_at, max(ts) AS last_seen, max(ts) + INTERVAL 120 SECONDS AS stalled_at, count(*) AS events FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 120 SECONDS THEN 0 ELSE 1 END AS fresh FROM events))
    GROUP BY user_id, s HAVING max(ts) + INTERVAL 120 SECONDS <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)""")
def stream_stalls(c: Corpus) -> DataFrame:
    return jobs.run_available(jobs.stalls(_events(c)), _sink(c, "stalls"))


@query("stream_throttle", """WITH RECURSIVE e AS (SELECT user_id AS doc_id, event_type AS stage, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
    walk AS (SELECT doc_id, stage, event_id, us, rn, us AS passed_at, true AS passes FROM e WHERE rn = 1 UNION ALL
        SELECT e.doc_id, e.stage, e.event_id, e.us, e.rn, CASE WHEN e.us - w.passed_at >= 86400000000 THEN e.us ELSE w.passed_at END, e.us - w.passed_at >= 86400000000 FROM walk w JOIN e ON e.doc_id = w.doc_id AND e.stage = w.stage AND e.rn = w.rn + 1)
    SELECT doc_id, stage, event_id, us AS "at" FROM walk WHERE passes""")
def stream_throttle(c: Corpus) -> DataFrame:
    c.spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    updates = _events(c).select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("stage"), "event_id", "ts", F.lit(False).alias("is_start"))
    return jobs.run_available(jobs.throttled(updates, 86400.0), _sink(c, "throttle"))


@query("stream_stall_alerts", """SELECT user_id, make_timestamp((ms + 120000) * 1000) AS stalled_at FROM (
    SELECT user_id, epoch_us(ts) // 1000 AS ms, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ms FROM events)
    WHERE next_ms - ms >= 120000 OR (next_ms IS NULL AND ms + 120000 <= (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM events))""")
def stream_stall_alerts(c: Corpus) -> DataFrame:
    c.spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    return jobs.run_available(jobs.stall_alerts(_events(c)), _sink(c, "alerts"))


@query("stream_rate", """SELECT doc_id, w AS from_ts, w + INTERVAL 1 HOUR AS to_ts, count(*) AS requests FROM (
    SELECT user_id AS doc_id, time_bucket(INTERVAL 5 MINUTES, ts) - to_minutes(unnest(range(0, 12)) * 5) AS w, ts FROM events) WHERE ts < w + INTERVAL 1 HOUR
    GROUP BY ALL HAVING count(*) > 1 AND w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)""")
def stream_rate(c: Corpus) -> DataFrame:
    requests_ = _events(c).withColumnRenamed("user_id", "doc_id")
    return jobs.request_rate(requests_, _sink(c, "rate"), 1)


@query("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(c: Corpus) -> DataFrame:
    """Every event delivered twice, kept once."""
    twice = _events(c).unionByName(_events(c))
    return jobs.run_available(jobs.deduplicated(twice).select("event_id", "user_id", "event_type"), _sink(c, "dedup"))


@query("stream_cost", """SELECT model_used, day, count(*) AS calls, sum(p + c)::BIGINT AS tokens, sum(75 * p + 450 * c)::BIGINT AS cost_e8
    FROM (SELECT event_type AS model_used, date_trunc('day', ts) AS day, floor(value * 10)::BIGINT AS p, user_id AS c FROM events)
    WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY model_used, day""")
def stream_cost(c: Corpus) -> DataFrame:
    calls = _events(c).select("ts", F.col("event_type").alias("model_used"), F.floor(F.col("value") * 10).cast("long").alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"))
    return jobs.run_available(jobs.cost_rollup(calls), _sink(c, "cost"))


@query("stream_decisions", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_decisions(c: Corpus) -> DataFrame:
    rows = _events(c).select("user_id", "event_type", "event_id", "ts")
    return jobs.merge_latest(rows, _sink(c, "decisions"), "user_id", ["ts", "event_id"]).drop("ts")


@query("stream_enrich", "SELECT doc_id, paragraph_index, paragraph_type, route, route_reason, pass0_text FROM t_routed")
def stream_enrich(c: Corpus) -> DataFrame:
    """New documents through the stateless part of the chain: the batch functions, on a stream."""
    arriving = jobs.event_stream(c.spark, f"{c.path}/documents.parquet", jobs.DOCUMENTS)
    rows = triage.prepared(arriving).select(*KEY, "paragraph_type", "route", "route_reason", "pass0_text")
    return jobs.run_available(rows, _sink(c, "enrich"))


# --- entry points ----------------------------------------------------------------------------------------

_MATCH_TABLES = {
    "x_blocks": f"SELECT *, {O.normalise('block_text')} AS norm FROM t_blocks",
    "x_changes": f"""SELECT *, {O.normalise('original_text')} AS norm, page_no AS est_page, {O.strip('corrected_text')} AS x_text FROM t_changes""",
    "x_page_texts": f"""SELECT doc_id, page_no, string_agg(CASE WHEN (doc_id + paragraph_index) % 5 = 0 THEN '• ' || t ELSE t END, chr(10) ORDER BY paragraph_index) AS page_text
        FROM (SELECT p.doc_id, p.paragraph_index, {O.page_of('p.paragraph_index', 'p.n_paragraphs', 'greatest(1, ceil(p.n_paragraphs / 10.0))::BIGINT')} AS page_no,
            CASE WHEN {O.strip('p.text')} = x.old THEN x.new ELSE p.text END AS t FROM t_paras p
            LEFT JOIN (SELECT doc_id, location, arg_min(original_text, position) AS old, arg_min(corrected_text, position) AS new
                FROM t_patches WHERE review_status NOT IN ('rejected', 'gate_rejected') GROUP BY ALL) x ON x.doc_id = p.doc_id AND x.location = p.location) GROUP BY ALL""",
}


def sql_text(sql: str) -> str:
    for name, body in _MATCH_TABLES.items():
        if name in sql:
            sql = sql.replace(name, name.replace("x_", "t_x_"))
            O.TABLES.setdefault(name.replace("x_", "t_x_"), body)
    return O.with_tables(sql)
