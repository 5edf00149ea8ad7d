"""Text functions, over made texts where the corpus itself has none of what they look for."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.functions import text as x
from corpusloom.operators import lifecycle as life
from corpusloom.sources.files import with_embeddings
from corpusloom.steps import written


@query("F1 F2", "SELECT doc_id, sha256(text) AS source_hash, sha256(regexp_replace(lower(regexp_replace(text, '\\s+', ' ', 'g')), '^\\s+|\\s+$', '', 'g')) AS normalized_hash FROM documents")
def norm_hash(t):
    return t("documents").select("doc_id", x.sha256(F.col("text")).alias("source_hash"), x.sha256(x.squeeze(F.col("text"))).alias("normalized_hash"))


@query("F3 F4 F8 F9", """WITH g AS (SELECT p_partkey, concat('load 0:', p_size % 9, 'S þ ð', p_name, 'Þ coeﬃcient ', p_size % 7, ':', p_size % 5) AS raw FROM part)
 SELECT p_partkey, regexp_matches(raw, '[þðÞÐﬁﬂﬀﬃﬄ]|\\b[0-9]+:[0-9]') AS suspect, regexp_replace(replace(replace(replace(replace(raw, 'þ', '+'), 'ð', '('), 'Þ', ')'), 'ﬃ', 'ffi'), '([0-9]):([0-9])', '\\1.\\2', 'g') AS fixed FROM g""")
def glyph_fix(t):
    raw = F.concat(F.lit("load 0:"), F.col("p_size") % 9, F.lit("S þ ð"), "p_name", F.lit("Þ coeﬃcient "), F.col("p_size") % 7, F.lit(":"), F.col("p_size") % 5)
    return t("part").select("p_partkey", x.has_glyph_artifacts(raw).alias("suspect"), x.fix_colons(x.fix_glyphs(raw)).alias("fixed"))


@query("F5 F7", """SELECT p_partkey, regexp_replace(concat('1.', p_size, '  SCOPE of ', upper(p_brand), '  the body'), '(?i)^\\s*1\\.' || p_size || '\\s+scope\\s+of\\s+' || p_brand || '\\s*', '') AS body,
 CASE WHEN p_size % 2 = 0 THEN concat(p_size, '. 1.2D + 1.6 L_r + S_DS + K_zt W_T') ELSE concat('Prose of Lr + SDS ', p_size) END AS formula FROM part""")
def heading_and_subscripts(t):
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("1."), size, F.lit("  SCOPE of "), F.upper("p_brand"), F.lit("  the body"))
    formula = F.when(F.col("p_size") % 2 == 0, F.concat(size, F.lit(". 1.2D + 1.6 Lr + SDS + Kzt WT"))).otherwise(F.concat(F.lit("Prose of Lr + SDS "), size))
    return t("part").select("p_partkey", x.strip_heading(text, F.concat(F.lit("1."), size), F.concat(F.lit("Scope of "), "p_brand", F.lit(" :"))).alias("body"), x.restore_subscripts(formula).alias("formula"))


def _sql_glyphs(c: str) -> str:
    for wrong, right in x.GLYPHS.items():
        c = f"replace({c}, '{wrong}', '{right}')"
    for _ in range(2):  # a digit may end one match and begin the next
        c = f"regexp_replace({c}, '([0-9]):([0-9]|[A-Z][a-z]?\\b)', '\\1.\\2', 'g')"
    return c


def _sql_subscripts(c: str) -> str:
    out = c
    for lost, shown in x.SUBSCRIPTS.items():
        out = f"regexp_replace({out}, '\\b{lost}\\b', '{shown}', 'g')"
    return f"CASE WHEN regexp_matches({c}, '{x.FORMULA_START}') AND regexp_matches({c}, '{x.FORMULA_OPERATOR}') THEN {out} ELSE {c} END"


@query("F6 F10 T10", f"""WITH r AS (SELECT doc_id, concat('1.1 SCOPE', chr(10), 'The design wind loads for build-', chr(10), 'ing', chr(10, 10), '1a. D þ 0:7S ð Lr Þ', chr(10), '(a) ', text) AS raw FROM documents),
b AS (SELECT doc_id, raw, string_split_regex(regexp_replace({_sql_glyphs("raw")}, '^1\\.1 SCOPE\\s*', ''), '\\n\\s*\\n+') AS blocks FROM r),
l AS (SELECT doc_id, raw, list_transform(blocks, lambda k: list_filter(list_transform(string_split_regex(k, '\\r\\n|[\\n\\r\\x0B\\f]'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')) AS lines FROM b),
p AS (SELECT doc_id, raw, flatten(list_transform(lines, lambda ls: list_transform(ls, lambda s, i: CASE WHEN i = 1 OR regexp_matches(s, '{x.OWN_PARAGRAPH}') THEN chr(10) ELSE chr(13) END || s))) AS marked FROM l),
f AS (SELECT doc_id, raw, list_filter(list_transform(string_split(replace(replace(list_aggregate(marked, 'string_agg', ''), '-' || chr(13), ''), chr(13), ' '), chr(10)), lambda s: trim(regexp_replace(s, '\\s{{2,}}', ' ', 'g'))), lambda s: s <> '') AS flowing FROM p),
n AS (SELECT doc_id, raw, list_aggregate(list_transform(flowing, lambda s: {_sql_subscripts("s")}), 'string_agg', chr(10) || chr(10)) AS full_text FROM f)
 SELECT doc_id, raw AS full_text_raw, full_text, sha256(raw) AS source_hash, sha256(regexp_replace(lower(regexp_replace(full_text, '\\s+', ' ', 'g')), '^\\s+|\\s+$', '', 'g')) AS normalized_hash FROM n""".replace("chr(10, 10)", "chr(10), chr(10)"))
def normalize_texts(t):
    """Raw text, the normalized one and its hash, as a backfill writes them."""
    raw = F.concat(F.lit("1.1 SCOPE\nThe design wind loads for build-\ning\n\n1a. D þ 0:7S ð Lr Þ\n(a) "), "text")
    d = t("documents").select("doc_id", raw.alias("full_text_raw"), x.normalize(raw, F.lit("1.1"), F.lit("Scope")).alias("full_text"))
    return d.withColumn("source_hash", x.sha256(F.col("full_text_raw"))).withColumn("normalized_hash", x.sha256(x.squeeze(F.col("full_text"))))


@query("F11 F12 F19 F25", """WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Chapter ' || p_size WHEN 1 THEN '26.' || p_size || '.2' WHEN 2 THEN 'A.' || p_size ELSE CAST(p_size AS VARCHAR) END AS num, p_name FROM part)
 SELECT p_partkey, num AS number, p_name AS title, CAST(CASE WHEN num LIKE 'Chapter%' THEN 0 ELSE length(num) - length(replace(num, '.', '')) END AS INTEGER) AS depth, CASE WHEN num LIKE 'Chapter %' THEN num ELSE split_part(num, '.', 1) END AS chapter,
 regexp_replace(regexp_replace(num, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, '7.' || num AS path FROM n""")
def number_parts(t):
    """Number and title of a heading, and what follows from the number."""
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 4
    num = F.when(k == 0, F.concat(F.lit("Chapter "), size)).when(k == 1, F.concat(F.lit("26."), size, F.lit(".2"))).when(k == 2, F.concat(F.lit("A."), size)).otherwise(size)
    heading = F.concat(F.lit(" "), num, F.lit(" "), "p_name")
    pattern = r"^\s*((?:Chapter|CHAPTER|Part|PART|Appendix|APPENDIX)\s+[A-Z0-9IVX]+|[A-Z]\.\d+(?:\.\d+)*|\d+(?:\.\d+)+|\d+)\s+(.*)$"
    d = t("part").select("p_partkey", F.regexp_extract(heading, pattern, 1).alias("number"), F.regexp_extract(heading, pattern, 2).alias("title"))
    n = F.col("number")
    return d.select("*", x.depth_of(n).alias("depth"), x.chapter_of(n).alias("chapter"), x.slug(n).alias("slug"), F.concat_ws(".", F.lit("7"), n).alias("path"))


@query("F17 F21", """WITH s AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Preface' WHEN 1 THEN 'Table ' || p_size WHEN 2 THEN 'Definitions' WHEN 3 THEN 'appendix b' ELSE p_name END AS title, p_size % 3 AS depth, p_name || CASE p_partkey % 5 WHEN 0 THEN ' [SFM] [HCD]' WHEN 1 THEN ' a figure' WHEN 2 THEN ' defined as' ELSE '' END AS body FROM part)
 SELECT p_partkey, CASE WHEN title = 'Preface' THEN 'front_matter' WHEN lower(title) LIKE 'table %' THEN 'table' WHEN lower(title) LIKE 'appendix %' THEN 'appendix' WHEN contains(lower(title), 'definitions') THEN 'definition' WHEN depth = 0 THEN 'chapter' ELSE 'section' END AS by_title,
 CASE WHEN contains(lower(body), 'table') THEN 'table' WHEN contains(lower(body), 'figure') THEN 'figure' WHEN contains(lower(body), 'defined as') THEN 'definition' ELSE 'section' END AS by_content, CASE WHEN contains(body, '[HCD]') THEN 'HCD' END AS agency FROM s""")
def section_types(t):
    k, j = F.col("p_partkey") % 6, F.col("p_partkey") % 5
    title = F.when(k == 0, "Preface").when(k == 1, F.concat(F.lit("Table "), F.col("p_size").cast("string"))).when(k == 2, "Definitions").when(k == 3, "appendix b").otherwise(F.col("p_name"))
    body = F.concat("p_name", F.when(j == 0, " [SFM] [HCD]").when(j == 1, " a figure").when(j == 2, " defined as").otherwise(""))
    return t("part").select("p_partkey", x.section_type(title, F.col("p_size") % 3).alias("by_title"), x.content_type(body).alias("by_content"), x.amendment(body).alias("agency"))


@query("F28 F31", """SELECT o_orderkey, CASE WHEN n = 0 THEN '—' WHEN n < 1024 THEN CASE WHEN n >= 10 THEN format('{:.0f}', n::DOUBLE) ELSE format('{:.1f}', n::DOUBLE) END || ' B' WHEN n < 1048576 THEN CASE WHEN n / 1024 >= 10 THEN format('{:.0f}', n / 1024) ELSE format('{:.1f}', n / 1024) END || ' KB' ELSE CASE WHEN n / 1048576 >= 10 THEN format('{:.0f}', n / 1048576) ELSE format('{:.1f}', n / 1048576) END || ' MB' END AS size,
 CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN floor(s / 60 + 0.5)::INT || 'm ago' WHEN s < 86400 THEN floor(s / 3600 + 0.5)::INT || 'h ago' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS age, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso
 FROM (SELECT *, o_orderkey * o_orderkey * 3 % 90000000 AS n, o_orderkey * 37 % 100000 AS s FROM orders)""")
def labels_for_people(t):
    n, s = F.col("o_orderkey") * F.col("o_orderkey") * 3 % 90000000, F.col("o_orderkey") * 37 % 100000
    return t("orders").select("o_orderkey", x.size_label(n).alias("size"), x.age_label(s, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("age"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("F29 F30", "SELECT vec_id, '[' || array_to_string(list_transform(embedding[1:2], lambda x: printf('%d', round(x * 1000)::INT)), ',') || ']' AS literal, 'wind | load' AS terms FROM embeddings")
def vector_text(t):
    v = F.transform(F.slice("embedding", 1, 2), lambda e: F.round(e.cast("double") * 1000).cast("int"))
    return t("embeddings").select("vec_id", x.vector_literal(v).alias("literal"), F.array_join(x.query_terms(F.lit("wind  Load wind")), " | ").alias("terms"))


@query("J9", """WITH h AS (SELECT doc_id, source, sha256(regexp_replace(lower(regexp_replace(text, '\\s+', ' ', 'g')), '^\\s+|\\s+$', '', 'g')) AS h FROM documents)
 SELECT a.doc_id, min(b.doc_id) AS canonical FROM h a LEFT JOIN h b ON a.h = b.h AND a.source <> b.source AND b.doc_id < a.doc_id GROUP BY a.doc_id""")
def canonical_link(t):
    """The earliest document of another source with the same normalized text. For each text only its earliest document and the earliest one of any other source can be the answer: two numbers, not all pairs."""
    # hashed once; all that follows reads these three columns
    h = written(t("documents").select("doc_id", "source", x.sha256(x.squeeze(F.col("text"))).alias("h")))
    by_source = h.groupBy("h", "source").agg(F.min("doc_id").alias("first"))
    top = by_source.groupBy("h").agg(F.min(F.struct("first", "source")).alias("a"))
    second = by_source.join(top, "h").filter("source <> a.source").groupBy("h").agg(F.min("first").alias("b"))
    found = h.join(top, "h").join(second, "h", "left")
    other = F.when(F.col("source") != F.col("a.source"), F.col("a.first")).otherwise(F.col("b"))
    return found.select("doc_id", F.when(other < F.col("doc_id"), other).alias("canonical"))


@query("W3", "SELECT h, min(doc_id) AS doc_id FROM (SELECT doc_id, sha256(text) AS h FROM documents) GROUP BY h")
def first_of_text(t):
    return t("documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"))


@query("F18 F20", """WITH s AS (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CAST(p_size % 9 AS VARCHAR) END AS chapter, p_name || CASE p_partkey % 5 WHEN 0 THEN ' of a definition' WHEN 1 THEN ' a figure' WHEN 2 THEN ' in appendix B' WHEN 3 THEN repeat(' long', 500) || ' table' ELSE '' END AS body FROM part)
 SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'definition' WHEN 1 THEN 'figure' WHEN 2 THEN 'appendix' WHEN 3 THEN 'table' ELSE 'section' END AS of_web, CASE p_partkey % 5 WHEN 1 THEN 'figure' WHEN 2 THEN 'appendix' ELSE 'section' END AS of_file, CASE WHEN coalesce(chapter, '') = '' THEN '0' ELSE chapter END || '.' || p_size || '.1' AS path FROM s""")
def section_kinds(t):
    """A section's kind by its content, as web pages and as files tell it, and its path."""
    k, j = F.col("p_partkey") % 4, F.col("p_partkey") % 5
    chapter = F.when(k == 1, "").when(k > 1, (F.col("p_size") % 9).cast("string"))
    body = F.concat("p_name", F.when(j == 0, " of a definition").when(j == 1, " a figure").when(j == 2, " in appendix B").when(j == 3, F.concat(F.repeat(F.lit(" long"), F.lit(500)), F.lit(" table"))).otherwise(""))
    return t("part").select("p_partkey", x.web_content_type(body).alias("of_web"), x.content_type(body).alias("of_file"), x.section_path(chapter, F.concat(F.col("p_size").cast("string"), F.lit(".1"))).alias("path"))


@query("F26", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'callout' WHEN 1 THEN 'formula' WHEN 2 THEN 'list' WHEN 3 THEN 'list' WHEN 4 THEN 'callout' ELSE 'plain' END AS kind FROM part""")
def line_classes(t):
    """Callouts, formula lines, list items and plain paragraphs."""
    size = F.col("p_size").cast("string")
    made = [F.concat(F.lit("EXCEPTIONS: "), "p_name"), F.concat(size, F.lit("a. 1.2D + 1.6L")), F.concat(size, F.lit(". the "), "p_name"), F.concat(F.lit("( iv ) "), "p_name"), F.concat(F.lit("User Note: "), "p_name"), F.concat(F.lit("Loads = "), size)]
    k = F.col("p_partkey") % 6
    text = F.coalesce(*[F.when(k == i, m) for i, m in enumerate(made)])
    return t("part").select("p_partkey", x.line_class(text).alias("kind"))


_SECTIONS = "SELECT p_partkey AS id, p_size AS book, '  ' || p_name || '   of' || chr(10) || p_brand AS full_text, CASE WHEN p_partkey % 3 = 0 THEN 'raw  ' || p_name END AS full_text_raw, CASE WHEN p_partkey % 7 = 0 THEN DATE '2020-01-01' END AS superseded_date FROM part"
_CLEAN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _sections(t):
    return t("part").selectExpr("p_partkey AS id", "p_size AS book", "concat('  ', p_name, '   of', char(10), p_brand) AS full_text", "CASE WHEN p_partkey % 3 = 0 THEN concat('raw  ', p_name) END AS full_text_raw", "CASE WHEN p_partkey % 7 = 0 THEN DATE '2020-01-01' END AS superseded_date")


@query("D12 P19", f"WITH s AS ({_SECTIONS}) SELECT id, full_text_raw AS raw, {_CLEAN.format('full_text_raw')} AS clean, sha256(lower({_CLEAN.format('full_text_raw')})) AS hash, true AS every FROM s WHERE superseded_date IS NULL AND full_text_raw IS NOT NULL UNION ALL SELECT id, full_text, {_CLEAN.format('full_text')}, sha256(lower({_CLEAN.format('full_text')})), every FROM s, (VALUES (true), (false)) AS v(every) WHERE superseded_date IS NULL AND full_text_raw IS NULL")
def backfill_rows(t):
    """Live rows normalized again: all of them, and only those that have no raw text yet."""
    clean, hash_ = x.normalize(F.col("_raw"), F.lit(None), F.lit(None)), lambda c: x.sha256(x.squeeze(c))
    of = lambda every: life.backfill(_sections(t), clean, hash_, every).selectExpr("id", "full_text_raw AS raw", "full_text AS clean", "normalized_hash AS hash", f"{str(every).lower()} AS every")
    return of(True).union(of(False))


_WAS = "sha256(lower({}))".format(_CLEAN.format("full_text"))


@query("D12 S17", f"WITH s AS ({_SECTIONS}) SELECT id, hash, [length(clean)::DOUBLE, (length(clean) - length(replace(clean, ' ', '')))::DOUBLE] AS embedding FROM (SELECT id, {_CLEAN.format('coalesce(full_text_raw, full_text)')} AS clean, sha256(lower({_CLEAN.format('coalesce(full_text_raw, full_text)')})) AS hash, {_WAS} AS was FROM s WHERE superseded_date IS NULL) WHERE hash <> was")
def backfill_embeddings(t):
    """Live rows normalized again; those whose text is another than before are embedded again, in Arrow batches, by an embedder of the caller's."""
    hash_ = lambda c: x.sha256(x.squeeze(c))
    fresh = life.backfill(_sections(t), x.normalize(F.col("_raw"), F.lit(None), F.lit(None)), hash_, True)
    before = _sections(t).select("id", hash_(F.col("full_text")).alias("normalized_hash"))
    made = with_embeddings(life.changed_texts(before, fresh).select("id", "normalized_hash", "full_text"), "full_text", lambda ts: [[float(len(v)), float(v.count(" "))] for v in ts])
    return made.select("id", F.col("normalized_hash").alias("hash"), F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))


@query("D10 U5", f"WITH s AS ({_SECTIONS}) SELECT id, book, CAST(CASE WHEN superseded_date IS NULL AND book IN (7, 9) THEN DATE '2024-06-01' ELSE superseded_date END AS VARCHAR) AS until, full_text FROM s UNION ALL SELECT id + 1000000, book, NULL, 'read again ' || p_name FROM (SELECT p_partkey AS id, p_size AS book, p_name FROM part WHERE p_size IN (7, 9))")
def reindex_books(t):
    """Two books read again: their live sections stamped, the new ones after them, for all chapters together."""
    parts = [t("part").filter(f"p_size = {b}").selectExpr("p_partkey + 1000000 AS id", "p_size AS book", "concat('read again ', p_name) AS full_text", "cast(NULL AS string) AS full_text_raw") for b in (7, 9)]
    out = life.reindex(_sections(t), parts[0].unionByName(parts[1]), "book", F.lit("2024-06-01").cast("date"))
    return out.select("id", "book", F.col("superseded_date").cast("string").alias("until"), "full_text")
