"""Structure of paged documents. A document's text, cut at its line breaks, stands for a file; page k has four lines, a running line above and its number below."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.operators import structure as s


def pages(t):
    cut = t("documents").select(F.col("source").alias("doc"), F.row_number().over(s.Window.partitionBy("source").orderBy("doc_id")).alias("page"), F.col("text").alias("b"))
    return cut.selectExpr("doc", "page", "concat('Running head of ', doc, char(10), translate(b, char(10), ' '), char(10), '  second ', page % 3, char(10), page) AS text")


_PAGES = """WITH pages AS (SELECT source AS doc, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, concat('Running head of ', source, chr(10), replace(text, chr(10), ' '), chr(10), '  second ', row_number() OVER (PARTITION BY source ORDER BY doc_id) % 3, chr(10), row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS text FROM documents),
lines AS (SELECT doc, page, unnest(range(1, 5)) AS "at", unnest(string_split(text, chr(10))) AS line FROM pages),
n AS (SELECT doc, count(*) AS n FROM pages GROUP BY 1),
run AS (SELECT l.doc, trim(line) AS line FROM lines l JOIN n USING (doc) GROUP BY l.doc, trim(line), n.n HAVING greatest(count(*) FILTER (l."at" <= 3), count(*) FILTER (l."at" > 1)) >= greatest(5, floor(n.n * 0.25)))"""


@query("A8 U3", _PAGES + " SELECT * FROM run")
def header_footer(t):
    return s.running_lines(pages(t))


@query("F22 S8 S21", _PAGES + """ SELECT doc, CAST(page AS INTEGER) AS page, CAST("at" AS INTEGER) AS "at", line FROM lines WHERE trim(line) <> '' AND NOT regexp_full_match(trim(line), '[0-9]{1,4}') AND (doc, trim(line)) NOT IN (SELECT doc, line FROM run)""")
def body_text(t):
    return s.body_lines(pages(t)).select("doc", "page", "at", "line")


@query("S9 S10", "SELECT doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 50 AS ocr FROM documents")
def ocr_route(t):
    return t("documents").select("doc_id", s.needs_ocr(F.col("text")).alias("ocr"))


@query("S8 F13", """SELECT n_regionkey AS doc, 1 AS page, CAST(3 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS "at", n_regionkey || '.' || n_nationkey AS number, n_name AS title, CAST(n_nationkey * 3 + 1 AS INTEGER) AS printed FROM nation""")
def toc_scan(t):
    row = F.expr("concat(n_regionkey, '.', n_nationkey, ' ', n_name, ' ', repeat('. ', 9), n_nationkey * 3 + 1)")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda x: x.row), "\n")
    made = t("nation").groupBy(F.col("n_regionkey").alias("doc")).agg(body.alias("b")).select("doc", F.lit(1).alias("page"), F.concat(F.lit("Title page\n0.1 Before the heading .... 3\n  CONTENTS \n"), "b", F.lit("\nno row at all")).alias("text"))
    return s.toc_rows(made)


@query("W1 F14 F16", """WITH toc AS (SELECT n_regionkey AS doc, n_nationkey AS seq, least(greatest(1, n_nationkey * 2 - 15 + 20), 60) AS page FROM nation), b AS (SELECT *, lead(page) OVER (PARTITION BY doc ORDER BY seq) AS nxt FROM toc)
 SELECT doc, seq, CAST(page AS INTEGER) AS page, CAST(least(page, 60) AS INTEGER) AS first, CAST(greatest(page, least(coalesce(nxt - 1, 60), 60)) AS INTEGER) AS last FROM b""")
def toc_bounds(t):
    toc = t("nation").select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").alias("seq"), s.file_page(F.col("n_nationkey") * 2 - 15, F.lit(60)).alias("page"))
    return s.section_bounds(toc, t("region").select(F.col("r_regionkey").alias("doc"), F.lit(60).alias("n"))).select("doc", "seq", "page", "first", "last")


@query("W2 S7 A18")
def page_repair(t):
    """Pages of an outline's entries, mended in order. Held against a plain reading of the rule in tests/test_operators.py."""
    p = t("customer").selectExpr("c_custkey % 4 AS doc", "CAST(c_custkey DIV 4 + 1 AS INT) AS page", "concat('text', char(10), ' ', c_custkey DIV 4, '.', c_nationkey % 3, ' Heading') AS text")
    toc = t("customer").selectExpr("c_custkey % 4 AS doc", "c_custkey AS seq", "concat(c_custkey DIV 4, '.', c_nationkey % 3) AS number", "CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE c_custkey DIV 4 + 1 END AS INT) AS page")
    return s.repair_pages(toc, p)


@query("W4 W5", """WITH l AS (SELECT o_custkey % 20 AS doc, o_orderkey AS "at", CASE WHEN o_orderkey % 37 = 1 THEN 'CHAPTER ' || o_orderkey % 9 WHEN o_orderkey % 5 = 0 THEN ' ' || (100 + o_orderkey % 800) || '.' || o_orderkey % 7 || ' ' || o_orderpriority ELSE 'line ' || o_orderkey END AS line FROM orders),
 m AS (SELECT *, CASE WHEN regexp_matches(trim(line), '^\\d{3,4}\\.\\d+') THEN regexp_extract(trim(line), '^(\\d{3,4}\\.\\d+)', 1) END AS num, nullif(regexp_extract(line, '^CHAPTER (\\d+)', 1), '') AS ch FROM l),
 g AS (SELECT *, sum((num IS NOT NULL OR ch IS NOT NULL)::INT) OVER w AS section, last_value(ch IGNORE NULLS) OVER w AS chapter FROM m WINDOW w AS (PARTITION BY doc ORDER BY "at" ROWS UNBOUNDED PRECEDING))
 SELECT doc, CAST(section AS BIGINT) AS section, max(chapter) AS chapter, max(num) AS number, trim(regexp_replace(max(CASE WHEN num IS NOT NULL THEN trim(line) END), '^[\\d.]+', '')) AS title, string_agg(line, chr(10) ORDER BY "at") AS body FROM g GROUP BY doc, section HAVING max(num) IS NOT NULL""")
def sections_of_lines(t):
    line = F.expr("CASE WHEN o_orderkey % 37 = 1 THEN concat('CHAPTER ', o_orderkey % 9) WHEN o_orderkey % 5 = 0 THEN concat(' ', 100 + o_orderkey % 800, '.', o_orderkey % 7, ' ', o_orderpriority) ELSE concat('line ', o_orderkey) END")
    return s.sectionize(t("orders").select((F.col("o_custkey") % 20).alias("doc"), F.col("o_orderkey").alias("at"), line.alias("line")))


@query("J15 W6", _PAGES + """, st AS (SELECT doc, page, (page - 1) * 4 AS start FROM pages) SELECT doc, "at", (SELECT CAST(max(page) AS INTEGER) FROM st WHERE st.doc = l.doc AND st.start <= l."at") AS page FROM (SELECT DISTINCT doc, page * 3 AS "at" FROM pages) l""")
def line_to_page(t):
    p = pages(t)
    lines = p.select("doc", (F.col("page") * 3).alias("at")).distinct()
    return s.page_of_line(lines.withColumn("at", F.col("at").cast("long")), s.page_starts(p).withColumn("start", F.col("start").cast("long")))


@query("F15 F16", """SELECT p_partkey, 'Sec 1.' || p_size || ' ' || p_name || chr(10) || chr(10) || 'body' AS body FROM part""")
def sliced_bodies(t):
    text = F.expr("concat('tail of the page before', char(10), 'Sec 1.', p_size, ' ', p_name, char(10), char(10), char(10), 'body', char(10), 'Sec 2.', p_size, ' next', char(10), 'more')")
    one, two = F.expr("concat('Sec 1.', p_size)"), F.expr("concat('Sec 2.', p_size)")
    return t("part").select("p_partkey", s.slice_body(text, one, F.col("p_name"), two, F.lit("next")).alias("body"))
