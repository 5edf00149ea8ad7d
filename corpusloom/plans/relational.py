"""Catalog, dashboard, filters, joins, aggregates, orders and set operations.

The tables stand in: region for an adopting authority, nation for a cycle, customer for a book, orders for sections and import sources (status F, O, P), part for catalog entries, supplier for standards, lineitem for references.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.operators.lifecycle import PHASES, route, scannable
from corpusloom.operators.tables import first_of, optional_equal, percent, scan_status, small
from corpusloom.sources import rules
from corpusloom.sources.web import number_count

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'crawling' ELSE 'pending' END"


def catalog_rows(t):
    """One row for each book: its cycle and authority, current sections, latest source and the scan status that follows."""
    orders = t("orders")
    counts = orders.filter("o_orderpriority <> '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("sections"))
    latest = first_of(orders.selectExpr("o_custkey", "o_orderkey AS source_id", f"{_STATUS} AS import_status", "o_orderdate"), ["o_custkey"], F.desc_nulls_last("o_orderdate"), F.desc("source_id"))
    return (
        t("customer")
        .join(small(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(small(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(counts.withColumnRenamed("o_custkey", "k1"), F.col("c_custkey") == F.col("k1"), "left")
        .join(latest.withColumnRenamed("o_custkey", "k2"), F.col("c_custkey") == F.col("k2"), "left")
        .select("r_name", "n_nationkey", "n_name", "c_custkey", "c_name", F.coalesce("sections", F.lit(0)).alias("sections"), "source_id", "import_status", F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_crawled"), scan_status(F.col("import_status"), F.coalesce("sections", F.lit(0))).alias("scan_status"))
    )


_CATALOG_SQL = f"""
WITH counts AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1),
latest AS (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey AS source_id, {_STATUS} AS import_status, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC NULLS LAST, o_orderkey DESC),
flat AS (SELECT r_name, n_nationkey, n_name, c_custkey, c_name, coalesce(n, 0) AS sections, source_id, import_status, strftime(o_orderdate, '%Y-%m-%d') AS last_crawled,
 CASE WHEN (import_status IS NULL OR import_status = 'pending') AND coalesce(n, 0) = 0 THEN 'not_scanned' WHEN import_status IN ('crawling', 'error') THEN import_status WHEN coalesce(n, 0) > 0 THEN 'indexed' ELSE coalesce(import_status, 'not_scanned') END AS scan_status
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN counts ON counts.o_custkey = c_custkey LEFT JOIN latest ON latest.o_custkey = c_custkey)"""


@query("G11 J6 A2 A3 P23 T6 S16", _CATALOG_SQL + " SELECT * FROM flat")
def catalog_flat(t):
    return catalog_rows(t).orderBy("r_name", F.desc("n_nationkey"), F.asc_nulls_last("c_name"), "c_custkey")


@query("A7 G11", _CATALOG_SQL + """ SELECT r_name, string_agg(cycle, '; ' ORDER BY n_nationkey) AS cycles, CAST(sum(n) AS BIGINT) AS n_books FROM (
 SELECT r_name, n_nationkey, n_name || ':' || string_agg(c_name || '=' || scan_status, ',' ORDER BY c_name, c_custkey) AS cycle, count(*) AS n FROM flat GROUP BY r_name, n_nationkey, n_name) GROUP BY r_name""")
def catalog_nested(t):
    """Books within cycles within authorities. The nested form is ``nested_catalog``; here it is written out as text."""
    nested = nested_catalog(catalog_rows(t))
    book = lambda b: F.concat(b.c_name, F.lit("="), b.scan_status)
    cycle = lambda c: F.concat(c.n_name, F.lit(":"), F.array_join(F.transform(c.books, book), ","))
    return nested.select("r_name", F.array_join(F.transform("cycles", cycle), "; ").alias("cycles"), F.aggregate("cycles", F.lit(0).cast("long"), lambda n, c: n + F.size(c.books)).alias("n_books"))


def nested_catalog(rows):
    """authority → array of cycles → array of books, from flat catalog rows. A group holds a cycle's or an authority's catalog entries, which are few by nature."""
    books = rows.groupBy("r_name", "n_nationkey", "n_name").agg(F.sort_array(F.collect_list(F.struct("c_name", "c_custkey", "sections", "scan_status"))).alias("books"))
    return books.groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name", "books"))).alias("cycles"))


@query("A10", _CATALOG_SQL + " SELECT count(*) AS books, count(*) FILTER (scan_status = 'indexed') AS indexed, count(*) FILTER (scan_status = 'not_scanned') AS not_scanned, count(*) FILTER (scan_status = 'crawling') AS active, CAST(sum(sections) AS BIGINT) AS sections FROM flat")
def catalog_summary(t):
    s = F.col("scan_status")
    return catalog_rows(t).agg(F.count("*").alias("books"), F.count_if(s == "indexed").alias("indexed"), F.count_if(s == "not_scanned").alias("not_scanned"), F.count_if(s == "crawling").alias("active"), F.sum("sections").alias("sections"))


@query("P15 A11 P17", _CATALOG_SQL + " SELECT r_name, n_name, count(*) AS books FROM flat WHERE scan_status = 'indexed' AND contains(lower(concat_ws(' ', c_name, n_name, r_name)), 'er') AND sections > 0 GROUP BY ALL")
def facet_filter(t):
    hay = F.lower(F.concat_ws(" ", "c_name", "n_name", "r_name"))
    return catalog_rows(t).filter((F.col("scan_status") == "indexed") & hay.contains("er") & (F.col("sections") > 0)).groupBy("r_name", "n_name").agg(F.count("*").alias("books"))


@query("G13 A1 P14", """SELECT (SELECT count(*) FROM customer) AS books, (SELECT count(*) FROM orders) AS sections, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS current_sections,
 (SELECT count(*) FROM lineitem) AS refs, (SELECT count(*) FROM supplier) AS standards, (SELECT count(*) FROM events WHERE value IS NULL OR value < 1) AS unreviewed""")
def stats_counts(t):
    """Counts of several tables in one row: each is one number by itself, so the rows are put side by side as one union and pivoted."""
    parts = [("books", t("customer")), ("sections", t("orders")), ("current_sections", t("orders").filter("o_orderstatus <> 'F'")), ("refs", t("lineitem")), ("standards", t("supplier")), ("unreviewed", t("events").filter("value IS NULL OR value < 1"))]
    rows = None
    for name, df in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("k"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*[F.sum(F.when(F.col("k") == name, F.col("n"))).alias(name) for name, _ in parts])


@query("A3 A4 W8", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_custkey, o_orderdate DESC NULLS LAST, o_orderkey DESC")
def latest_per_group(t):
    return first_of(t("orders"), ["o_custkey"], F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("A5 P1 P6", "SELECT count(*) AS n FROM orders WHERE o_custkey = 7 AND o_orderstatus <> 'F' AND o_totalprice IS NOT NULL")
def current_sections(t):
    return t("orders").filter("o_custkey = 7 AND o_orderstatus <> 'F' AND o_totalprice IS NOT NULL").agg(F.count("*").alias("n"))


@query("G12 J4 J5 P24 T4 P13", """SELECT o_orderkey AS id, c_name AS book, n_name AS cycle, r_name AS authority, CAST(l AS BIGINT) AS processed, CASE WHEN p_size > 0 THEN CAST(floor(l * 100 / p_size) AS INTEGER) END AS percent, coalesce(o_orderpriority, 'queued') AS phase
 FROM (SELECT *, o_orderkey % 10 AS l, o_orderkey % 4 * 5 AS p_size FROM orders) LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
 ORDER BY coalesce(o_orderdate, TIMESTAMP '1970-01-01') DESC, o_orderkey LIMIT 100""")
def import_dashboard(t):
    """The hundred latest imports with percent done."""
    latest = t("orders").orderBy(F.coalesce("o_orderdate", F.lit("1970-01-01").cast("timestamp")).desc(), "o_orderkey").limit(100)
    done, total = F.col("o_orderkey") % 10, F.col("o_orderkey") % 4 * 5
    return (
        latest.join(small(t("customer")), F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(small(t("nation")), F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .join(small(t("region")), F.col("r_regionkey") == F.col("n_regionkey"), "left")
        .select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("book"), F.col("n_name").alias("cycle"), F.col("r_name").alias("authority"), done.alias("processed"), percent(done, total).alias("percent"), F.coalesce("o_orderpriority", F.lit("queued")).alias("phase"))
    )


@query("P3 P4", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand = coalesce('Brand#12', p_brand) AND p_size = coalesce(NULL, p_size)")
def optional_filter(t):
    """Filters that are given or not; those that aren't leave the rows."""
    return optional_equal(t("part"), p_brand="Brand#12", p_size=None).filter("p_size IS NOT NULL").select("p_partkey", "p_brand", "p_size")


@query("P8 P9", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 2, 3, 32, 33, 34, 1000) ORDER BY o_orderkey LIMIT 5")
def point_lookup(t):
    return t("orders").filter(F.col("o_orderkey").isin(1, 2, 3, 32, 33, 34, 1000)).orderBy("o_orderkey").limit(5).select("o_orderkey", "o_custkey")


@query("P11 P12 T5", "SELECT o_orderkey, substring(o_orderpriority, 1, 5) AS title, NULL::VARCHAR AS full_text FROM orders ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END NULLS LAST, o_orderkey LIMIT 50")
def outline_projection(t):
    """The first fifty sections in display order, without their texts."""
    shown = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey"))
    return t("orders").orderBy(shown.asc_nulls_last(), "o_orderkey").limit(50).select("o_orderkey", F.substring("o_orderpriority", 1, 5).alias("title"), F.lit(None).cast("string").alias("full_text"))


@query("J11 D14", """WITH asked AS (SELECT CAST(unnest([1, 5, 9, 9, 10, 149, 999999999]) AS BIGINT) AS id)
 SELECT id, CASE WHEN c_custkey IS NULL THEN 'error: no such book' WHEN c_acctbal < 0 THEN 'skipped: no address' WHEN c_nationkey % 2 = 0 THEN 'triggered: site' ELSE 'triggered: file' END AS outcome FROM (SELECT DISTINCT id FROM asked) LEFT JOIN customer ON c_custkey = id""")
def scan_dispatch(t):
    """What becomes of each asked book; a book that isn't there is an error."""
    customer = t("customer")
    asked = customer.sparkSession.createDataFrame([(i,) for i in (1, 5, 9, 9, 10, 149, 999999999)], "id long").distinct()
    outcome = F.when(F.col("c_custkey").isNull(), "error: no such book").when(F.col("c_acctbal") < 0, "skipped: no address").when(F.col("c_nationkey") % 2 == 0, "triggered: site").otherwise("triggered: file")
    return asked.join(customer, F.col("id") == F.col("c_custkey"), "left").select("id", outcome.alias("outcome"))


@query("J11", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def missing_ids(t):
    return t("lineitem").select("l_orderkey").join(t("orders").filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").distinct()


@query("J1", "SELECT l_orderkey, s_suppkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def standard_refs(t):
    return t("lineitem").join(small(t("supplier")), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_suppkey", "s_name")


@query("J7 J8", """SELECT l_orderkey, l_linenumber, min(o_orderkey) AS target, min(s_name) AS standard FROM lineitem LEFT JOIN orders ON o_custkey = l_suppkey AND o_orderstatus <> 'F' LEFT JOIN supplier ON s_suppkey = l_partkey GROUP BY ALL""")
def resolve_targets(t):
    """The live section of the wanted number with the smallest id, and the standard of the wanted name; null where there is none."""
    live = t("orders").filter("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("target"))
    return (
        t("lineitem").join(live, F.col("o_custkey") == F.col("l_suppkey"), "left")
        .join(small(t("supplier").select("s_suppkey", "s_name")), F.col("s_suppkey") == F.col("l_partkey"), "left")
        .groupBy("l_orderkey", "l_linenumber").agg(F.min("target").alias("target"), F.min("s_name").alias("standard"))
    )


@query("J16", "SELECT n_nationkey, n_name, CASE n_regionkey WHEN 0 THEN 2018 WHEN 1 THEN 2021 WHEN 2 THEN 2024 END AS base_year FROM nation")
def base_years(t):
    years = F.create_map(*[F.lit(x) for x in (0, 2018, 1, 2021, 2, 2024)])
    return t("nation").select("n_nationkey", "n_name", F.try_element_at(years, "n_regionkey").alias("base_year"))


@query("A6 U1", "SELECT DISTINCT l_returnflag, l_linestatus FROM (SELECT l_returnflag, l_linestatus FROM lineitem UNION ALL SELECT 'X', o_orderstatus FROM orders)")
def distinct_pairs(t):
    return t("lineitem").select("l_returnflag", "l_linestatus").union(t("orders").select(F.lit("X"), "o_orderstatus")).distinct()


@query("A14 A15", "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS imported, count(*) FILTER (o_totalprice <= 100000) AS quarantined FROM orders GROUP BY 1")
def ingest_counters(t):
    big = F.col("o_totalprice") > 100000
    return t("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(big).alias("imported"), F.count_if(~big).alias("quarantined"))


@query("A18 A19", "SELECT lang, arg_max(doc_id, (length(text), -doc_id)) AS longest FROM documents GROUP BY lang")
def longest_of_group(t):
    return t("documents").groupBy("lang").agg(F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("longest"))


@query("T1 T2 T3 T7 T8", """(SELECT 'unordered' AS k, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50) UNION ALL
 (SELECT 'price', o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) UNION ALL (SELECT 'newest', o_orderkey FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50)""")
def top_lists(t):
    """Lists cut to a length. Where none orders them, the id does."""
    orders = t("orders")
    lists = {"unordered": orders.filter("o_orderstatus = 'F'").orderBy("o_orderkey").limit(50), "price": orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5), "newest": orders.orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(50)}
    out = None
    for k, df in lists.items():
        one = df.select(F.lit(k).alias("k"), F.col("o_orderkey").alias("id"))
        out = one if out is None else out.union(one)
    return out


@query("T9", "SELECT DISTINCT l_partkey AS id, l_linenumber AS depth FROM lineitem ORDER BY depth, id LIMIT 10")
def distinct_limit(t):
    return t("lineitem").select(F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("depth")).distinct().orderBy("depth", "id").limit(10)


@query("W3", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def first_wins(t):
    return first_of(t("documents").select("source", "doc_id"), ["source"], F.asc("doc_id"))


_VALUES = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
_CYCLES_SQL = f"""WITH f(authority, a, b, s, d, m, p) AS (VALUES {_VALUES(rules.FAMILIES)}), y AS (SELECT *, CAST(unnest(range(a, b + 1, s)) AS INTEGER) AS year FROM f),
cycles AS (SELECT authority, year, replace(replace(p, '{{yy}}', right(CAST(year AS VARCHAR), 2)), '{{y}}', CAST(year AS VARCHAR)) AS name, CAST(make_date(year + d, m, 1) AS VARCHAR) AS effective, CASE WHEN year < b THEN CAST(make_date(year + s + d, m, 1) AS VARCHAR) END AS expires, CASE WHEN year < b THEN 'superseded' ELSE 'active' END AS status FROM y)"""


@query("S18", f"SELECT 'organisation' AS kind, a AS name, b AS detail FROM (VALUES {_VALUES(rules.ORGANISATIONS)}) AS v(a, b) UNION ALL SELECT 'standard', a, CAST(b AS VARCHAR) FROM (VALUES {_VALUES(rules.STANDARDS)}) AS v(a, b)")
def seed_rows(t):
    spark = t("region").sparkSession
    of = lambda kind, rows: spark.createDataFrame([(kind, a, str(b)) for a, b in rows], "kind string, name string, detail string")
    return of("organisation", rules.ORGANISATIONS).union(of("standard", rules.STANDARDS))


@query("S19", _CYCLES_SQL + " SELECT * FROM cycles")
def catalog_cycles(t):
    """67 cycles, by rule."""
    c = rules.cycles(t("region").sparkSession)
    return c.withColumns({"effective": F.col("effective").cast("string"), "expires": F.col("expires").cast("string")})


@query("S19 F32", _CYCLES_SQL + f""", k(authority, part, abbreviation, title, model, since) AS (VALUES {_VALUES(rules.BOOKS)})
 SELECT c.authority, year, part, coalesce(abbreviation, c.authority) AS abbreviation, CASE WHEN title IS NULL THEN c.name WHEN part IS NULL THEN year || ' ' || title ELSE year || ' ' || title || ' — ' || part END AS name, model,
 CASE WHEN c.authority = 'California' AND model = 'NEC' THEN year - 2 WHEN c.authority = 'California' AND model IS NOT NULL THEN year - 1 END AS base_year,
 CASE WHEN c.authority = 'California' AND year IN (2022, 2025) THEN '{rules.CONTENT}/' || abbreviation || year || replace(replace(part, 'Part ', 'P'), '.', '_') || CASE WHEN abbreviation = 'CBC' THEN 'V1' ELSE '' END WHEN c.authority = 'ICC' AND year IN (2021, 2024) THEN '{rules.CONTENT}/' || abbreviation || year END AS url, status
 FROM cycles c LEFT JOIN k ON c.authority = k.authority WHERE since IS NULL OR year >= since""")
def catalog_rules(t):
    """178 books: each cycle has the parts that its year knows, a model's base year and an address where there is one."""
    return rules.books(t("region").sparkSession)


@query("S15", "SELECT CAST(n AS INTEGER) AS number, 'Chapter ' || n || ' - ' || title AS title, 'https://codes.iccsafe.org/content/X/chapter-' || n || '-' || CASE n WHEN 4 THEN 'special-detailed-requirements-based-on-use-and-occupancy' ELSE lower(replace(replace(title, ',', ''), ' ', '-')) END AS url FROM (SELECT unnest(string_split('" + "|".join(rules.CHAPTERS) + "', '|')) AS title, unnest(range(1, 36)) AS n)")
def fallback_chapters(t):
    return rules.fallback_chapters(t("region").sparkSession, f"{rules.CONTENT}/X/")


_SOURCE = "CASE p_partkey % 3 WHEN 0 THEN 'pdf_parse' WHEN 1 THEN 'web_scrape' ELSE 'feed' END AS kind, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'https://codes.iccsafe.org/x' WHEN 3 THEN 'http://x.example/javascript:' ELSE 'ftp://x' END AS url"


@query("D15 P21 P22", f"SELECT p_partkey, CASE WHEN kind = 'pdf_parse' THEN 'error: upload the file' WHEN kind = 'web_scrape' AND p_size % 5 = 2 THEN 'triggered' ELSE 'error: unsupported' END AS outcome, p_size % 5 = 2 AS scannable FROM (SELECT p_partkey, p_size, {_SOURCE} FROM part)")
def route_imports(t):
    """What becomes of a trigger by the source's kind and address, and whether the address can be fetched."""
    kind, url = _SOURCE.split(", CASE")
    return t("part").selectExpr("p_partkey", kind, f"CASE{url}").select("p_partkey", route(F.col("kind"), F.col("url")).alias("outcome"), scannable(F.col("url")).alias("scannable"))


@query("P20 A16", "SELECT o_orderkey, phase FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'parsing' WHEN 2 THEN 'indexing' WHEN 3 THEN 'completed' WHEN 4 THEN 'failed' END AS phase FROM orders) WHERE phase IN ('queued', 'parsing', 'indexing')")
def active_imports(t):
    """Imports in a phase that isn't final."""
    phase = F.element_at(F.array(*map(F.lit, (*PHASES, None))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return t("orders").select("o_orderkey", phase.alias("phase")).filter(F.col("phase").isin(*PHASES[:3]))


@query("P10 T5", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey LIMIT 20 OFFSET 5")
def section_page(t):
    """A page of a book's sections, in their order."""
    return t("orders").filter("o_custkey = 7").orderBy("o_orderkey").offset(5).limit(20).select("o_orderkey")


@query("P10", "SELECT o_orderkey, CAST(o_orderkey % 13 AS BIGINT) AS page FROM orders WHERE o_custkey % 30 = 7 AND o_orderkey % 13 = 5 AND o_orderstatus <> 'F' ORDER BY o_orderpriority, o_orderkey LIMIT 50")
def sections_on_page(t):
    """The live sections of a book on one page, in their order."""
    own = t("orders").withColumn("page", F.col("o_orderkey") % 13).filter("o_custkey % 30 = 7 AND page = 5 AND o_orderstatus <> 'F'")
    return own.orderBy(F.col("o_orderpriority").asc_nulls_last(), "o_orderkey").limit(50).select("o_orderkey", "page")


@query("P16 A11", _CATALOG_SQL + " SELECT c_custkey FROM flat WHERE r_name = 'ASIA' AND scan_status <> 'not_scanned' AND contains(lower(c_name), '1')")
def picker_filter(t):
    """Books of one authority that were scanned and whose name fits."""
    return catalog_rows(t).filter((F.col("r_name") == "ASIA") & (F.col("scan_status") != "not_scanned") & F.lower("c_name").contains("1")).select("c_custkey")


@query("A12", "SELECT source, count(*) AS n, CAST(row_number() OVER (ORDER BY min(doc_id)) AS INTEGER) AS place FROM documents GROUP BY source")
def first_seen_groups(t):
    """Groups in the order in which each is first seen; there are as many rows to order as groups."""
    groups = t("documents").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("_first"))
    return groups.withColumn("place", F.row_number().over(Window.orderBy("_first"))).drop("_first")


@query("G14", """(SELECT 'imports' AS list, event_id AS id FROM events ORDER BY ts DESC, event_id LIMIT 20) UNION ALL (SELECT 'books', c_custkey FROM customer ORDER BY c_nationkey, c_custkey LIMIT 50) UNION ALL (SELECT 'quarantine', event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50)""")
def status_lists(t):
    """Imports by time, books by part, what waits for review by time."""
    events = t("events")
    lists = {"imports": events.orderBy(F.desc("ts"), "event_id").limit(20).select("event_id"), "books": t("customer").orderBy("c_nationkey", "c_custkey").limit(50).select("c_custkey"), "quarantine": events.filter("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id")}
    return reduce(DataFrame.union, [df.select(F.lit(k).alias("list"), F.col(df.columns[0]).alias("id")) for k, df in lists.items()])


@query("A17", "SELECT p_partkey, CAST(p_size % 4 AS INTEGER) AS n FROM part")
def numbers_in_pages(t):
    """How many section numbers a page names."""
    html = F.concat(F.lit("<p>Year 2024, 12.5 and 1234</p>"), F.repeat(F.concat(F.lit("<b>"), (F.col("p_size") + 100).cast("string"), F.lit(".2.1</b> x706.1y ")), (F.col("p_size") % 4).cast("int")))
    return t("part").select("p_partkey", number_count(html).alias("n"))
