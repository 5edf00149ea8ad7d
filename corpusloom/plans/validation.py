"""Validation of texts. The corpus has few faults of its own, so the queries add rows with some, the same in Spark and in SQL, by doc_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.operators import validation as v
from corpusloom.operators.duplicate_index import DuplicateIndex
from corpusloom.steps import shared_dir

_FAULTY = """CASE doc_id % 12 WHEN 1 THEN substring(text, 1, 10) WHEN 2 THEN concat(text, ' page not found') WHEN 3 THEN concat('captcha ', text) WHEN 4 THEN concat('premium ', text)
 WHEN 5 THEN concat(text, ' cartridge') WHEN 6 THEN repeat('<b>x</b> ', 40) WHEN 7 THEN repeat(concat(substring(text, 1, 30), chr(10)), 6) WHEN 8 THEN concat(text, ' ...') WHEN 9 THEN concat(text, ' 1234.5678.')
 WHEN 10 THEN concat(text, ' Section 706.1 shall comply with ASTM E119, see Table 5.') ELSE text END"""
#: The documents as they are, and made faults beside them under ids of their own.
_SHIFT = 1_000_000_000_000
_SQL = f"""WITH faulty AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + {_SHIFT}, {_FAULTY} FROM documents WHERE doc_id % 12 BETWEEN 1 AND 10),
parts AS (SELECT *, string_split(text, chr(10)) AS lines FROM faulty),
rep AS (SELECT doc_id, max(c) AS best FROM (SELECT doc_id, l, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(lines, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))) AS l FROM parts) WHERE l <> '' GROUP BY ALL) GROUP BY 1),
m AS (SELECT *, lower(text) AS low, CASE WHEN len(lines) < 5 THEN 0.0 ELSE coalesce(best, 0) / len(lines) END AS repetition,
 len(regexp_extract_all(text, '<[^>]+>')) / greatest(len(regexp_extract_all(text, '\\S+')), 1) AS tags, regexp_replace(lines[-1], '^\\s+|\\s+$', '', 'g') AS last_line FROM parts LEFT JOIN rep USING (doc_id)),
early AS (SELECT *, CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 20 THEN 'Content too short'
 WHEN (length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'))) / greatest(length(text), 1) > 0.05 THEN 'Content appears to be binary'
 WHEN (length(text) - length(regexp_replace(text, '[^\\x{{0}}-\\x{{206F}}]', '', 'g'))) / greatest(length(text), 1) > 0.1 THEN 'Content contains mojibake' END AS e1,
 CASE WHEN regexp_matches(low, '{"|".join(v.ERROR_PAGE)}') THEN 'Error page pattern detected' WHEN regexp_matches(low, '{"|".join(v.CAPTCHA)}') THEN 'CAPTCHA detected' WHEN regexp_matches(low, '{"|".join(v.PAYWALL)}') THEN 'Paywall detected'
 WHEN regexp_matches(low, '{"|".join(v.SHOP)}') THEN 'Shop page detected' WHEN tags > 0.3 THEN 'Excessive HTML tags' WHEN repetition > 0.2 THEN 'Excessively repetitive content' END AS e2 FROM m),
late AS (SELECT *, CASE WHEN coalesce(e1, e2) IS NULL THEN CASE WHEN row_number() OVER (PARTITION BY coalesce(e1, e2) IS NULL, sha256(text) ORDER BY doc_id) > 1 THEN 'Duplicate content'
 WHEN suffix(regexp_replace(text, '\\s+$', ''), '...') OR length(last_line) > 100 AND right(last_line, 1) NOT IN ('.', '!', '?', ')', ':') THEN 'Content appears truncated'
 WHEN len(list_filter(regexp_extract_all(text, '\\d{{3,4}}\\.\\d+(?:\\.\\d+)*'), lambda n: regexp_matches(n, '\\.\\d{{4,}}'))) > 0 THEN 'Invalid section number format' END END AS e4 FROM early),
valid AS (SELECT doc_id, text, CASE WHEN e1 IS NOT NULL THEN 1 WHEN e2 IS NOT NULL THEN 2 WHEN e4 IS NOT NULL THEN 4 END AS layer, coalesce(e1, e2, e4) AS error,
 CAST({" + ".join(f"regexp_matches(text, '(?i){p}')::INT" for p in v.INDICATORS.values())} AS INTEGER) AS indicators FROM late)
"""


def _faulty(t):
    made = t("documents").filter("doc_id % 12 BETWEEN 1 AND 10").selectExpr(f"doc_id + {_SHIFT} AS doc_id", f"{_FAULTY.replace('chr(10)', 'char(10)')} AS text")
    return t("documents").select("doc_id", "text").union(made)


@query("V1 V2 V3 V4 V5 V6 V7 V8 V9 V10 V12 V13 V14 W7 A9 A13 V11 J10", _SQL + " SELECT doc_id, layer, error, indicators FROM valid")
def validate_documents(t):
    return v.validate(_faulty(t)).select("doc_id", "layer", "error", "indicators")


@query("D8", _SQL + """ SELECT doc_id AS source_id, layer AS validation_layer, error AS error_message, substring(text, 1, 5000) AS raw_content, '{"indicators":' || indicators || '}' AS metadata FROM valid WHERE layer IS NOT NULL""")
def quarantine_split(t):
    return v.quarantine(v.rejected(_faulty(t)))


@query("A15", _SQL + " SELECT coalesce(layer, 0) AS layer, count(*) AS n FROM valid GROUP BY 1")
def outcome_counts(t):
    return v.validate(_faulty(t)).groupBy(F.coalesce("layer", F.lit(0)).alias("layer")).agg(F.count("*").alias("n"))


@query("V12 W7 J10 A14", "SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS duplicate FROM documents")
def duplicate_reject(t):
    return v.flag_duplicates(t("documents").select("doc_id", F.sha2("text", 256).alias("hash")), "hash", "doc_id").select("doc_id", "duplicate")


@query("V9", "SELECT page_id, len(regexp_extract_all(html, '<[^>]+>')) / greatest(len(regexp_extract_all(html, '\\S+')), 1) AS ratio, CAST(len(regexp_extract_all(html, '[0-9]{3}')) AS INTEGER) AS numbers FROM pages")
def tag_ratio(t):
    return t("pages").select("page_id", v.tag_ratio(F.col("html")).alias("ratio"), F.regexp_count("html", F.lit("[0-9]{3}")).alias("numbers"))


@query("V10 A9", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), c AS (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(lines, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))) AS l FROM l) WHERE l <> '' GROUP BY ALL)
 SELECT doc_id, CASE WHEN len(lines) < 5 THEN 0.0 ELSE (SELECT coalesce(max(n), 0) FROM c WHERE c.doc_id = l.doc_id) / len(lines) END AS share FROM l""")
def repetition(t):
    return t("documents").select("doc_id", v.repetition(F.col("text")).alias("share"))


@query("J10 V12 W7 D3", "SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY coalesce(try_cast(substring(source, 4) AS INTEGER), 0) % 3, doc_id) > 1 AND text IS NOT NULL AS duplicate FROM documents")
def duplicates_by_batches(t):
    """Documents in three batches by their source, each told from those before it by an index on disk."""
    docs = t("documents").withColumn("batch", F.coalesce(F.expr("try_cast(substring(source, 4) AS INT)"), F.lit(0)) % 3)
    index = DuplicateIndex(docs.sparkSession, shared_dir(docs.sparkSession), buckets=8)
    told = [index.add(docs.filter(F.col("batch") == b), b) for b in range(3)]
    return told[0].union(told[1]).union(told[2]).select("doc_id", "duplicate")
