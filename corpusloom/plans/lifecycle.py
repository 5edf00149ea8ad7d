"""Versions, merges, reviews, progress and sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.operators import lifecycle as life
from corpusloom.operators import snapshots
from corpusloom.operators.scan import running
from corpusloom.operators.structure import embedded_outline, needs_ocr, over_chapters
from corpusloom.sources import files, web
from corpusloom.steps import shared_dir
from corpusloom.streaming import ingest, jobs


@query("D4 P1", "SELECT o_orderkey, CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus <> 'F' THEN '2024-06-01' WHEN o_orderstatus = 'F' THEN '2020-01-01' END AS superseded_date FROM orders")
def supersede_rows(t):
    d = t("orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "2020-01-01").alias("superseded_date"))
    return life.supersede(d, F.col("o_orderpriority") == "2-HIGH", F.lit("2024-06-01")).select("o_orderkey", "superseded_date")


@query("D2", """WITH new AS (SELECT o_custkey, o_orderdate, min(o_orderkey) AS id FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL), cur AS (SELECT o_custkey, o_orderdate, min(o_orderkey) AS id FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY ALL)
 SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, id FROM (SELECT * FROM new UNION ALL SELECT * FROM cur WHERE (o_custkey, o_orderdate) NOT IN (SELECT o_custkey, o_orderdate FROM new))""")
def upsert_latest(t):
    one = lambda f: t("orders").filter(f).groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderkey").alias("id"))
    merged = life.upsert(one("o_orderpriority <> '1-URGENT'"), one("o_orderpriority = '1-URGENT'"), ["o_custkey", "o_orderdate"])
    return merged.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "id")


@query("D3", "SELECT doc_id, sha256(text) AS hash, sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source < 'src15') AS accepted FROM documents WHERE source >= 'src15'")
def upload_split(t):
    h = t("documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    return life.split_new(h.filter("source >= 'src15'"), h.filter("source < 'src15'"), "hash").drop("source")


@query("D5", "SELECT c_custkey, coalesce(max(o_orderkey), (SELECT max(o_orderkey) FROM orders) + 1 + c_custkey) AS source_id, max(o_orderkey) IS NULL AS created FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def find_or_create(t):
    """Each book's latest source, or a new one, whose id is beyond all there are."""
    latest = t("orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("id"))
    known = t("customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "id")
    return life.with_new_ids(known, "id", "c_custkey", t("orders"), "o_orderkey").select("c_custkey", "source_id", "created")


@query("D6", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS phase FROM events GROUP BY user_id")
def progress_latest(t):
    return life.latest_progress(t("events"), "user_id", "ts", "event_id", "event_type").select("user_id", "event_id", F.col("event_type").alias("phase"))


@query("D1 D7", "SELECT o_custkey, o_orderkey, CAST(coalesce((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey), 0) + 1 AS BIGINT) AS version FROM orders")
def version_append(t):
    history = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("version"))
    return life.next_versions(t("orders").select("o_custkey", "o_orderkey"), history, "o_orderkey")


@query("D9 P14", "SELECT event_id AS id, CASE WHEN event_id IN (3, 4, 5) THEN '2024-06-01' END AS reviewed_at FROM events WHERE event_type = 'error' AND event_id NOT IN (0, 6, 7)")
def review_quarantine(t):
    q = t("events").filter("event_type = 'error'").select(F.col("event_id").alias("id"), F.lit(None).cast("string").alias("reviewed_at"))
    return life.review(q, [3, 4, 5], [0, 6, 7], F.lit("2024-06-01"))


@query("D11", "SELECT conv_id, min(substring(text, 1, 100)) FILTER (turn = 0) AS title, count(*) AS messages, count(*) FILTER (role = 'user') AS asked FROM conversations GROUP BY conv_id")
def chat_persist(t):
    """Sessions with their titles, the first hundred characters of the first message."""
    return t("conversations").groupBy("conv_id").agg(F.min(F.when(F.col("turn") == 0, F.substring("text", 1, 100))).alias("title"), F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("asked"))


@query("D13", "SELECT (SELECT count(*) FROM orders) > 0 AS refused, (SELECT count(*) FROM region) AS seeds")
def reseed_guard(t):
    there = t("orders").limit(1).agg((F.count("*") > 0).alias("refused"), F.lit(0).cast("long").alias("seeds"))
    return there.unionByName(t("region").agg(F.lit(False).alias("refused"), F.count("*").alias("seeds"))).agg(F.max("refused").alias("refused"), F.sum("seeds").alias("seeds"))


@query("P19", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') AND (n_chars IS NULL OR n_chars > 500 OR lang <> 'en') ORDER BY doc_id LIMIT 40")
def stale_rows(t):
    return t("documents").filter("source IN ('src1', 'src2') AND (n_chars IS NULL OR n_chars > 500 OR lang <> 'en')").orderBy("doc_id").limit(40).select("doc_id")


@query("S20 X4", "SELECT user_id, string_agg('[' || coalesce(json_extract_string('{\"response\": ' || json_extract_string(props, '$.k') || '}', '$.response'), '') || ']', '' ORDER BY ts, event_id) AS answer FROM events GROUP BY user_id")
def token_stream(t):
    """Pieces of a line-wise JSON answer, put together in order."""
    line = F.concat(F.lit('{"response": "'), F.get_json_object("props", "$.k"), F.lit('"}'))
    pieces = t("events").select("user_id", "ts", "event_id", F.concat(F.lit("["), files.tokens(line), F.lit("]")).alias("piece"))
    return pieces.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "piece"))).alias("x")).select("user_id", F.array_join(F.transform("x", lambda p: p.piece), "").alias("answer"))


@query("S20 X4", """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, json_extract_string(props, '$.k') AS k, count(*) OVER (PARTITION BY user_id) AS of FROM events)
 SELECT user_id AS answer, CAST(floor(seq / 20) AS BIGINT) AS part, string_agg(coalesce('[' || k || ']', ''), '' ORDER BY seq) AS text, max(seq) + 1 = max(of) AS done FROM e GROUP BY ALL""")
def token_parts(t):
    """Answers from files of JSON lines, read as a stream and put together in parts of 20 pieces. The lines are the events of a user, in order; those of the first batch come twice, and some are broken."""
    e = t("events").select("user_id", "ts", "event_id", F.get_json_object("props", "$.k").alias("k"))
    spark, folder = e.sparkSession, shared_dir(e.sparkSession)
    numbered = running(e, "user_id", ["ts", "event_id"], sums={"seq": F.lit(1).cast("long")}).withColumn("seq", F.col("seq") - 1)
    last = e.groupBy("user_id").agg((F.count("*") - 1).alias("last"))
    line = F.to_json(F.struct(F.col("user_id").alias("answer"), "seq", F.concat(F.lit("["), "k", F.lit("]")).alias("response"), (F.col("seq") == F.col("last")).alias("done")))
    lines = numbered.join(last, "user_id").select(line.alias("value"), "seq")
    lines.select("value").repartition(4).write.text(f"{folder}/in")
    lines.filter("seq < 5").select(F.explode(F.array("value", F.substring("value", 1, 9)))).write.mode("append").text(f"{folder}/in")
    ingest.run_once(ingest.answer_pieces(ingest.read_lines(spark, f"{folder}/in", files=2)), f"{folder}/out", f"{folder}/checkpoint")
    return ingest.answer_parts(spark.read.parquet(f"{folder}/out"), 20)


@query("U5 W6", """WITH d AS (SELECT source, doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL), c AS (SELECT *, CAST(sum(len(lines)) OVER (PARTITION BY source ORDER BY doc_id) - len(lines) AS BIGINT) AS first FROM d)
 SELECT source AS book, doc_id AS chapter, first + i AS place, sha256(lines[i + 1]) AS hash FROM (SELECT *, unnest(range(0, len(lines))) AS i FROM c)""")
def sections_over_chapters(t):
    """The sections of a book's chapters one after another: documents are chapters of their source, lines their sections."""
    chapters = t("documents").filter("text IS NOT NULL").select(F.col("source").alias("book"), F.col("doc_id").alias("chapter"), F.split("text", "\n").alias("sections"))
    return over_chapters(chapters).select("book", "chapter", "place", F.sha2("section", 256).alias("hash"))


@query("X5", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_progress(t):
    """The batch form of the streaming extension's windows; tests/test_operators.py holds the stream against it."""
    return t("events").groupBy(F.window("ts", "1 hour").start.alias("h"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("h", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


_LINKS = """concat(CASE page_id % 4 WHEN 0 THEN concat('<p><a class=x href=/content/chapter-', page_id % 9, '><b>Chapter</b> ', page_id % 9, ' Loads</a><a href="/content/chapter-', page_id % 9, '">again chapter ', page_id % 9, '</a><a href="/chapter">no number</a></p>')
 WHEN 1 THEN concat('<div class="toc-item"><ul><li><a href="https://other.example/', page_id, '">Part <i>', page_id, '</i></a></li></ul></div><a class="nav-link" href="/b">B</a><a class="nav-link" href="">none</a>')
 WHEN 2 THEN concat('<nav><a href="/one">1. One</a><a href="/two">two</a><span><a href="/three">The last chapter</a></span></nav>') ELSE '' END, '')"""


@query("S12 U4", """SELECT page_id, 'https://codes.iccsafe.org/content/chapter-' || page_id % 9 AS url, 'Chapter ' || page_id % 9 || ' Loads' AS title FROM pages WHERE page_id % 4 = 0
 UNION ALL SELECT page_id, 'https://other.example/' || page_id, 'Part ' || page_id FROM pages WHERE page_id % 4 = 1 UNION ALL SELECT page_id, 'https://codes.iccsafe.org/b', 'B' FROM pages WHERE page_id % 4 = 1
 UNION ALL SELECT page_id, 'https://codes.iccsafe.org/one', '1. One' FROM pages WHERE page_id % 4 = 2 UNION ALL SELECT page_id, 'https://codes.iccsafe.org/three', 'The last chapter' FROM pages WHERE page_id % 4 = 2""")
def chapter_links(t):
    """Links to chapters by three ways. The corpus's pages name no chapters, so that each gets links for one of the ways, or for none."""
    return web.chapter_links(t("pages").select("page_id", F.concat(F.expr(_LINKS), F.regexp_replace("html", "(?is)<nav.*?</nav>", "")).alias("html")))


@query("S13 F23 A19")
def page_texts(t):
    """The content of web pages; tests/test_operators.py holds the parser against made pages."""
    return t("pages").select("page_id", web.web_text("html").alias("text")).select("page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


@query("S14 F24 F18")
def page_sections(t):
    """Sections of web pages, of which the corpus has none of its own: each page gets two."""
    extra = F.concat("html", F.lit('<div id="sec_1"><h2>'), (F.col("page_id") % 800 + 100).cast("string"), F.lit('.1 Scope</h2><p>This part shall hold for all walls.</p><table><tr><th>a</th><td>b</td></tr></table></div><div id="sec_2"><h3>707.2.1 Loads</h3>Loads are those of chapter 16 of this code.</div>'))
    return t("pages").select("page_id", F.posexplode(web.web_sections(extra)).alias("at", "s")).select("page_id", "at", "s.number", "s.title", "s.body")


@query("T6 A7", "SELECT source, doc_id, CAST(n AS INTEGER) AS n FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS n FROM documents) WHERE n <= 3")
def first_three(t):
    return life.numbered(t("documents").select("source", "n_chars", "doc_id"), "source", "n_chars", "doc_id").filter("n <= 3").select("source", "doc_id", "n")


@query("S1 S2")
def stored_files(t):
    """Stored files of two tables: name, size and hash of the bytes, read by Spark's binary reader."""
    paths = t("region").inputFiles() + t("nation").inputFiles()
    return files.stored_files(t("region").sparkSession, paths).select("filename", "size_bytes", "sha256")


@query("S2")
def files_listed(t):
    """The files of two tables with their sizes, newest first; no content is read."""
    return files.list_files(t("region").sparkSession, t("region").inputFiles() + t("nation").inputFiles()).select("filename", "size_bytes")


@query("S3")
def stored_bytes(t):
    """One stored file by its hash, with its bytes as text."""
    spark, paths = t("region").sparkSession, t("region").inputFiles() + t("nation").inputFiles()
    first = files.stored_files(spark, paths).select("sha256").orderBy("sha256").limit(1)
    return files.stored_bytes(spark, paths, first).select("filename", F.base64("content").alias("content"))


@query("S3")
def file_fetched(t):
    """The first by name of two tables' files, found in the list and read alone."""
    spark = t("region").sparkSession
    listed = files.list_files(spark, t("region").inputFiles() + t("nation").inputFiles())
    return files.fetch_file(spark, listed.orderBy("filename", "path").first().path).select("filename", "size_bytes", F.base64("content").alias("content"))


@query("S6 S10", "SELECT page_id AS path, CAST(k AS INTEGER) AS page, 'page ' || k || ' of ' || page_id AS text, k % 2 = 0 AS ocr FROM pages, range(1, 4) AS r(k)")
def pages_of_files(t):
    """Pages of stored files by a reader of the caller's, each with whether it must be read from its picture. The files are made: three pages, apart at form feeds, the second with hardly any text."""
    made = t("pages").select(F.col("page_id").alias("path"), F.concat_ws("\f", *[F.concat(F.lit(f"page {k} of "), F.col("page_id").cast("string"), F.lit("" if k == 2 else " " * 3 + "x" * 60)) for k in (1, 2, 3)]).cast("binary").alias("content"))
    out = files.file_pages(made, lambda b: b.decode().split("\f"))
    return out.select("path", "page", F.regexp_replace("text", " +x+$", "").alias("text"), needs_ocr(F.col("text")).alias("ocr"))


@query("S4", "SELECT page_id AS path, 3 AS pages FROM pages")
def page_counts(t):
    """Number of pages of each stored file, by the same reader."""
    made = t("pages").select(F.col("page_id").alias("path"), F.lit("a\fb\fc").cast("binary").alias("content"))
    return files.file_pages(made, lambda b: b.decode().split("\f")).groupBy("path").agg(F.max("page").alias("pages"))


@query("S7", "SELECT n_regionkey AS doc, CAST(n_nationkey AS INTEGER) AS seq, n_regionkey || '.' || n_nationkey AS number, n_name AS title, CAST(greatest(1, n_nationkey - 2) AS INTEGER) AS page, CAST(n_nationkey % 3 AS INTEGER) AS depth FROM nation WHERE n_nationkey % 5 <> 4 UNION ALL SELECT n_regionkey, n_nationkey, substring(n_name, 1, 32), n_name, greatest(1, n_nationkey - 2), n_nationkey % 3 FROM nation WHERE n_nationkey % 5 = 4 AND n_nationkey <> 9")
def outline_entries(t):
    """Outlines that files carry: numbers parted from titles, pages from 1, depths from 0; entries without a title go."""
    n = t("nation")
    title = F.when(F.col("n_nationkey") == 9, "  ").when(F.col("n_nationkey") % 5 == 4, F.concat(F.lit(" "), "n_name")).otherwise(F.concat("n_regionkey", F.lit("."), "n_nationkey", F.lit("  "), "n_name"))
    raw = n.select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").cast("int").alias("seq"), (F.col("n_nationkey") % 3 + 1).cast("int").alias("level"), title.alias("title"), (F.col("n_nationkey") - 2).cast("int").alias("page"))
    return embedded_outline(raw)


@query("X7 S1", "SELECT DISTINCT user_id, event_type FROM events")
def streamed_ingest(t):
    """Events taken in as a stream, each kind of a user once: files as they come, state kept behind the watermark, exactly once into Parquet."""
    events = t("events")
    spark, folder = events.sparkSession, shared_dir(events.sparkSession)
    events.select("ts", "user_id", "event_type").repartition(4).write.parquet(f"{folder}/in")
    stream = ingest.read_events(spark, f"{folder}/in", "ts timestamp, user_id long, event_type string", files=2)
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    ingest.run_once(ingest.first_seen(stream.withColumn("hash", key), "hash", late="3650 days"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("user_id", "event_type")


@query("X1 X3", "SELECT user_id AS job, CAST(floor((n - 1) / greatest(ceil(of / 50), 1)) AS BIGINT) AS tick, max(n) AS processed, max(of) AS total FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS of FROM events) GROUP BY ALL")
def progress_ticks(t):
    """At most about fifty ticks for each job, however many steps it has: the last step of each of its parts."""
    steps = t("events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    total = t("events").groupBy("user_id").agg(F.count("*").alias("of"))
    tick = F.floor((F.col("n") - 1) / F.greatest(F.ceil(F.col("of") / 50), F.lit(1)))
    return steps.join(total, "user_id").groupBy(F.col("user_id").alias("job"), tick.alias("tick")).agg(F.max("n").cast("long").alias("processed"), F.max("of").alias("total"))


@query("X1 X3 D6", "SELECT user_id AS job, CAST(floor((n - 1) / greatest(ceil(of / 50), 1)) AS BIGINT) AS tick, max(n) AS processed, max(of) AS total FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS of FROM events) GROUP BY ALL")
def streamed_ticks(t):
    """The same ticks from a stream of steps that arrive in files, with the jobs' state in a state store."""
    spark, folder = t("events").sparkSession, shared_dir(t("events").sparkSession)
    steps = t("events").selectExpr("user_id AS job", "ts AS at", "CAST(NULL AS STRING) AS phase", "CAST(NULL AS LONG) AS total")
    begun = t("events").groupBy(F.col("user_id").alias("job")).agg(F.min("ts").alias("at"), F.lit("queued").alias("phase"), F.count("*").alias("total"))
    steps.unionByName(begun).selectExpr("job", "CAST(at AS TIMESTAMP) AS at", "phase", "total").repartition(4).write.parquet(f"{folder}/in")
    stream = ingest.read_events(spark, f"{folder}/in", "job long, at timestamp, phase string, total long", files=2)
    ingest.run_once(jobs.follow(stream).filter("kind = 'tick'"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("job", "tick", "processed", "total")


@query("D1 D4 D7 D10", """SELECT source AS book, doc_id AS number, sha256(text) AS hash, 1 AS version, 1 AS batch, CASE WHEN EXISTS (SELECT 1 FROM documents s WHERE s.lang <> 'en' AND s.source IS NOT DISTINCT FROM d.source) THEN '2024-02-01' END AS superseded_date FROM documents d
 UNION ALL SELECT source, doc_id, sha256(text), 2, 2, NULL FROM documents WHERE lang <> 'en'""")
def books_replaced(t):
    """Two batches of sections into a folder by book: all documents, then new versions of those in other languages, whose books' earlier rows are stamped."""
    d = t("documents").select(F.col("source").alias("book"), F.col("doc_id").alias("number"), F.sha2("text", 256).alias("hash"), "lang")
    spark, path, columns = d.sparkSession, shared_dir(d.sparkSession), "book string, number long, hash string"
    for batch, rows in enumerate((d, d.filter("lang <> 'en'")), 1):
        snapshots.replace_books(path, rows.drop("lang"), batch, f"2024-0{batch}-01", parts=16)
    return snapshots.current(spark, path, columns).drop("part")
