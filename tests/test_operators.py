"""Micro-fixtures and edges of the library's own operators."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import citations, lexical, text
from corpusloom.operators import lifecycle, outline, retrieval, structure, tables, validation
from corpusloom.sources import files, web
from corpusloom.streaming import ingest


def one(spark, column, **row):
    names = list(row) or ["x"]
    return spark.createDataFrame([tuple(row.values()) or (1,)], ", ".join(f"{n} string" for n in names)).select(column.alias("r")).first().r


def test_normalize(spark):
    raw = "1.1 SCOPE\nThe design wind loads for\nbuild-\ning structures.\n\n1a. D þ 0:7S ð Lr Þ"
    want = "The design wind loads for building structures.\n\n1a. D + 0.7S ( L_r )"
    assert one(spark, text.normalize(F.col("t"), F.lit("1.1"), F.lit("Scope")), t=raw) == want
    assert one(spark, text.normalize(F.col("t"), F.lit(None), F.lit(None)), t=None) == ""
    assert one(spark, text.fix_colons(F.lit("at 12:30"))) == "at 12.30"
    assert one(spark, text.normalize(F.lit("1. Kzt + SDS and Lrx\nmore\n(a) next\nNote: end"), F.lit(""), F.lit(""))) == "1. K_zt + S_DS and Lrx more\n\n(a) next\n\nNote: end"


@pytest.mark.parametrize(("s", "kind", "target", "standard"), [
    ("shall comply with Section 706.1", "mandatory", "706.1", None), ("and NFPA 13.", "external_standard", None, "NFPA 13."), ("See Table 1607.1.", "table", None, None), ("Part 2, Section 706", "cross_part", "706", None),
    ("in accordance with Section 26.5.2", None, None, None), ("Exception 1 (a): none at all", "exception", None, None)])
def test_references(spark, s, kind, target, standard):
    found = one(spark, citations.extract(F.col("t")), t=s)
    assert [(r.kind, r.target, r.standard) for r in found] == ([(kind, target, standard)] if kind else [])


@pytest.mark.parametrize(("s", "want"), [("706.1 through 706.3", ["706.1", "706.2", "706.3"]), ("706 through 706.5", ["706 through 706.5"]), ("706.1", ["706.1"]), ("706.a through 706.b", ["706.a through 706.b"])])
def test_ranges(spark, s, want):
    assert one(spark, citations.expand_range(F.col("t")), t=s) == want


def test_numbers(spark):
    assert [one(spark, text.depth_of(F.col("t")), t=n) for n in ("26", "26.5", "26.5.2", "Appendix B")] == [0, 1, 2, 0]
    assert one(spark, text.slug(F.lit("26.1.2.1"))) == "26-1-2-1"
    assert one(spark, structure.file_page(F.lit(42), F.lit(50))) == 50 and one(spark, structure.file_page(F.lit(None).cast("int"), F.lit(500))) == 21
    assert [one(spark, text.size_label(F.lit(n))) for n in (0, 5, 1024, 15_000_000)] == ["—", "5.0 B", "1.0 KB", "14 MB"]


def test_validation(spark):
    ok = "A text of enough words that nothing is wrong with."
    rows = [(1, "x" * 19), (2, "x" * 20), (3, ok + "\0"), (4, ok + " border"), (5, "a\nb\nc\nd\ne" * 5), (6, "a line of text\n" * 2 + "b\nc\nd"), (7, ok + "..."), (8, "w" * 101), (9, ok + " 1234.5678 "), (10, ok), (11, ok), (12, None), (13, "漢字" * 20)]
    got = {r.doc_id: (r.layer, r.error) for r in validation.validate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (1, "Content too short") and got[2] == (None, None) and got[3][1] == "Content appears to be binary" and got[4] == (2, "Shop page detected")
    assert got[6] == (2, "Excessively repetitive content") and got[7][1] == got[8][1] == "Content appears truncated" and got[9][1] == "Invalid section number format"
    assert got[10] == (None, None) and got[11] == (4, "Duplicate content") and got[12][0] == 1 and got[13][1] == "Content contains mojibake"
    files_only = validation.validate(spark.createDataFrame([(4, ok + " border")], "doc_id long, text string"), web=F.lit(False)).first()
    assert files_only.layer is None
    assert [one(spark, validation.repetition(F.col("t")), t=t) for t in ("a\nb\nc\nd\ne", "a\na\nc\nd\ne", "a\na")] == [0.2, 0.4, 0.0]


def test_running_lines(spark):
    pages = spark.createDataFrame([("d", k, ("head\n" if k < 5 else "") + ("foot\n" if k < 4 else "") + f"own {k}\n{k}") for k in range(10)], "doc string, page int, text string")
    assert {r.line for r in structure.running_lines(pages).collect()} == {"head"}
    assert {r.line for r in structure.body_lines(pages).collect()} == {"foot", *[f"own {k}" for k in range(10)]}


def test_parents(spark):
    numbers = ["Chapter 26", "26.1", "26.1.2", "27.1.1", "Appendix B", "B.1", "C", "C.2", "chapter 260", "x"]
    got = {r.number: r.parent for r in outline.with_parents(spark.createDataFrame([(n,) for n in numbers], "number string")).collect()}
    assert got == {"Chapter 26": None, "26.1": "Chapter 26", "26.1.2": "26.1", "27.1.1": None, "Appendix B": None, "B.1": "Appendix B", "C": None, "C.2": "C", "chapter 260": None, "x": None}


def test_page_repair(spark):
    pages = spark.createDataFrame([("d", p, f"intro\n {p}.1 Title\nbody") for p in range(1, 31)], "doc string, page int, text string")
    toc = spark.createDataFrame([("d", 1, "2.1", 2), ("d", 2, "4.1", 1), ("d", 3, "9.9", 3), ("d", 4, "5.1", 5), ("d", 5, "29.1", 2), ("d", 6, "6.1", 99)], "doc string, seq int, number string, page int")
    got = [(r.page, r.state) for r in structure.repair_pages(toc, pages).orderBy("seq").collect()]
    assert got == [(2, ""), (4, "verified"), (4, "unverified"), (5, ""), (5, "unverified"), (6, "verified")]


def test_page_repair_looks_numbers_up(spark):
    """Lines meet the outline's numbers by a join on the number: no row lists all numbers of an outline that begin alike."""
    pages = spark.createDataFrame([("d", p, f"{p}.1 Title") for p in range(1, 301)], "doc string, page int, text string")
    toc = spark.createDataFrame([("d", p, f"{p}.1", 1) for p in range(1, 301)], "doc string, seq int, number string, page int")
    out = structure.repair_pages(toc, pages)
    assert "collect_set(number" not in out._jdf.queryExecution().optimizedPlan().toString().replace("_number", "number")
    assert [r.page for r in out.orderBy("seq").collect()] == list(range(1, 301))


def test_page_repair_of_odd_numbers(spark):
    """A number that is null or blank stands nowhere; one with a hyphen, a bracket or letters beyond ASCII is matched whole, at a word's edge."""
    texts = {1: "intro\nC-10 no", 2: " 3.1.1 more", 3: "x\n\n   C-1 Heading\nB(2) y", 4: "3.1 Title\nÄ1é z", 5: "Ä1 w"}
    pages = spark.createDataFrame([("d", p, t) for p, t in texts.items()] + [("e", 1, None)], "doc string, page int, text string")
    entries = [(1, "", 3), (2, None, 2), (3, "C-1", 1), (4, "B(2)", 3), (5, " 3.1 ", 4), (6, "Ä1", 4), (7, "zz", 9)]
    toc = spark.createDataFrame([("d", s, n, p) for s, n, p in entries] + [("e", 1, "1", 5), ("f", 1, "1", 5)], "doc string, seq int, number string, page int")

    def brute(doc, n):
        good, out = 1, []
        for seq, number, page in [x for x in entries if doc == "d"] or [(1, "1", 5)]:
            needle = (number or "").strip()
            on = lambda p: bool(needle and doc == "d" and re.search(rf"(?m)^\s*{re.escape(needle)}\b", texts.get(p, "")))  # noqa: B023, E731
            at = max(1, min(page, n))
            near = next((p for p in range(good, min(good + 10, n) + 1) if on(p)), None)
            if at >= good and on(at):
                out.append((seq, page, ""))
                good = at
            elif near:
                out.append((seq, near, "verified"))
                good = near
            else:
                out.append((seq, min(good, n), "unverified"))
        return out

    got = structure.repair_pages(toc, pages).orderBy("doc", "seq").collect()
    for doc, n in (("d", 5), ("e", 1), ("f", 0)):
        assert [(r.seq, r.page, r.state) for r in got if r.doc == doc] == brute(doc, n)


def test_deep_outline(spark):
    edges = spark.createDataFrame([(str(k), str(k - 1) if k else None) for k in range(25)] + [("z", "9"), ("lost", "no such")], "node string, parent string")
    got = {(r.node, r.ancestor, r.distance) for r in outline.ancestors(edges).collect()}
    want = {(str(k), str(j), k - j) for k in range(25) for j in range(k + 1)} | {("z", "z", 0), ("lost", "lost", 0), ("lost", "no such", 1)} | {("z", str(j), 10 - j) for j in range(10)}
    assert got == want


def test_long_lists_stay_whole(spark):
    v = spark.createDataFrame([(i, 1.0 - i / 1000) for i in range(200)], "id long, score double")
    k = spark.createDataFrame([(i, 0.5) for i in range(100, 300)], "id long, score double")
    got = retrieval.hybrid(v, k, 1000).orderBy("place").collect()
    assert [r.id for r in got] == list(range(300)) and got[250].search_type == "keyword"


@pytest.mark.parametrize("stem", [False, True])
def test_postings(spark, tmp_path, stem):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS id", "text AS full_text").union(spark.createDataFrame([(-1, None), (-2, "")], "id long, full_text string"))
    index = retrieval.postings(d, str(tmp_path / "index"), stem)
    for q in ("the heat, erth the ANEA!", "", "nosuchword", "readings of heat"):
        rows = lambda df: [(r.id, pytest.approx(r.score, abs=2e-6)) for r in df.collect()]
        assert rows(retrieval.search_postings(index, q, 20, stem)) == rows(retrieval.keyword_search(d, q, 20, stem))


def test_patterns_as_words(spark):
    """The words that stand for the patterns of layer 2 find what the patterns find."""
    texts = ["a 404", "robot check", "robotverification", "bot\n verification", "subscribe  to view", "subscribe it", "purchase to access", "purchase of", "sign in", "Verify you are human", "x" * 5, "gateway timeout", "limited  access"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for patterns in (validation.ERROR_PAGE, validation.CAPTCHA, validation.PAYWALL, validation.SHOP):
        got = [r.x for r in df.select(validation._holds(F.lower("t"), patterns).alias("x")).collect()]
        assert got == [any(re.search(p, t.lower()) for p in patterns) for t in texts]


def test_rejected_rows(spark):
    """Rows with one id are told apart by their texts; equal rows each come once."""
    ok = "A text of enough words that nothing is wrong with."
    rows = [(1, ok), (1, "short"), (1, "short"), (None, "short"), (2, ok), (None, None)]
    got = validation.rejected(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text, r.error) for r in got), key=repr) == sorted([(1, "short", "Content too short")] * 2 + [(None, "short", "Content too short"), (None, None, "Content too short"), (2, ok, "Duplicate content")], key=repr)


LINKS = [
    ("<a href='/chapter/1'>see <b>Chapter 1</b></a><a href=/x>Chapter 2</a><a href='/chapter/9'>nine</a>", [("see Chapter 1", "/chapter/1")]),
    ("<ul class='toc-item'><a href='u'>U</a></ul><a class='x nav-link' href='v'>V <i>w</i></a><a href='z'>Z</a>", [("U", "u"), ("V w", "v")]),
    ("<div id='sidebar'><p><a href='a'>Chapters</a><a href='b'>2. Two</a><a href='c'>other</a></p></div><a href='d'>3. x</a>", [("Chapters", "a"), ("2. Two", "b")]),
    ("<main><a href='a'>Chapters</a></main>", []), ("", []), (None, []),
]


@pytest.mark.parametrize(("html", "want"), LINKS)
def test_links(html, want):
    assert web.links_of(html) == want


def test_scan_status(spark):
    rows = [(None, 0), ("pending", 0), ("completed", 0), ("completed", 3), ("error", 3), ("crawling", 1), (None, 2), ("pending", 1)]
    got = [r.s for r in spark.createDataFrame(rows, "st string, n int").select(tables.scan_status(F.col("st"), F.col("n")).alias("s")).collect()]
    assert got == ["not_scanned", "not_scanned", "completed", "indexed", "error", "crawling", "indexed", "indexed"]
    assert [one(spark, tables.percent(F.lit(a), F.lit(b))) for a, b in ((7, 9), (1, 0), (5, None))] == [77, None, None]


def test_hybrid(spark):
    v = spark.createDataFrame([(1, 0.9), (2, 0.8)], "id long, score double")
    k = spark.createDataFrame([(2, 0.7), (3, 0.6)], "id long, score double")
    got = lambda n: [(r.id, r.search_type) for r in retrieval.hybrid(v, k, n).orderBy("place").collect()]
    assert got(3) == [(1, "vector"), (2, "vector"), (3, "keyword")] and got(2) == [(1, "vector"), (2, "vector")]
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None)], "id long, embedding array<float>")
    assert [(r.id, r.score) for r in retrieval.nearest(zero, [1.0, 0.0], 5).collect()] == [(2, 1.0), (1, None)]


def test_lifecycle(spark):
    d = spark.createDataFrame([(1, None), (2, None), (3, datetime.date(2020, 1, 1))], "id int, superseded_date date")
    out = lifecycle.supersede(d, F.col("id") >= 2, F.lit(datetime.date(2024, 1, 1))).collect()
    assert [r.superseded_date and r.superseded_date.year for r in sorted(out)] == [None, 2024, 2020]
    a, b = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "old"), (2, "old")], [(2, "new"), (3, "new")]))
    assert sorted(map(tuple, lifecycle.upsert(a, b, ["k"]).collect())) == [(1, "old"), (2, "new"), (3, "new")]
    twice = spark.createDataFrame([(2, "a"), (2, "c"), (2, "b"), (None, "n")], "k int, v string").repartition(3)
    assert sorted(map(tuple, lifecycle.upsert(a, twice, ["k"]).collect()), key=repr) == [(1, "old"), (2, "c"), (None, "n")]
    books = spark.createDataFrame([(1, 7), (2, None), (30_000_000, None)], "k long, found long")
    got = {r.k: (r.source_id, r.created) for r in lifecycle.with_new_ids(books, "found", "k", spark.range(12_000_000, 12_000_003), "id").collect()}
    assert got == {1: (7, False), 2: (12_000_005, True), 30_000_000: (42_000_003, True)}


PAGES = [
    ('<div id="sec_1"><h2>101.1 Scope.</h2><p>All of the walls.</p><script>x</script></div><div id="sec_2">none</div>', [("101.1", "Scope", "101.1 Scope. All of the walls.")]),
    ('<div class="code-section">202.2 Terms that are used in this code here</div>', [("202.2", "Terms that are used in this code here", "202.2 Terms that are used in this code here")]),
    ("<h2>303.1 Heads</h2><p>A body long enough to be taken up.</p><h3>x</h3><h2>Next</h2><p>no</p>", [("303.1", "Heads", "303.1 Heads\nA body long enough to be taken up. x")]),
    ("<b>404.4 Bold</b><p>A body long enough to be taken up, too.</p>", [("404.4", "Bold", "404.4 Bold\nA body long enough to be taken up, too.")]),
    ("<p>505.5 A first sentence. And a second one that is long enough.</p>", [("505.5", "A first sentence.", "505.5 A first sentence. And a second one that is long enough.")]),
    ("<p>nothing</p>", []), (None, []), ("<div id='sec_3'><h2>606.1 T</h2><table><tr><td>a</td><td>b of some length</td></tr></table></div>", [("606.1", "T", "606.1 T\nTABLE:\na | b of some length\nEND TABLE")]),
]


@pytest.mark.parametrize(("html", "want"), PAGES)
def test_web_sections(html, want):
    assert web.sections_of(html) == want


def test_files_and_tokens(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\ftwo")
    import hashlib

    row = files.stored_files(spark, str(tmp_path)).first()
    assert (row.filename, row.size_bytes, row.sha256) == ("a.txt", 7, hashlib.sha256(b"one\ftwo").hexdigest())
    assert files.list_files(spark, str(tmp_path)).count() == 1
    content = spark.read.format("binaryFile").load(str(tmp_path))
    assert [(r.page, r.text) for r in files.file_pages(content, lambda b: b.decode().split("\f")).collect()] == [(1, "one"), (2, "two")]
    embedded = files.with_embeddings(spark.createDataFrame([(1, "ab"), (2, None)], "id int, t string"), "t", lambda ts: [[float(len(t))] for t in ts])
    assert [(r.id, r.embedding) for r in embedded.collect()] == [(1, [2.0]), (2, [0.0])]
    assert [one(spark, files.tokens(F.col("t")), t=t) for t in ('{"response":"x"}', '{"message":{"content":"y"}}', "broken", None)] == ["x", "y", "", ""]


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    ddl = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    stream = ingest.read_events(spark, str(tmp_path / "in"), ddl)
    ingest.run_once(ingest.progress(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = events.groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert got.count() > 0.8 * batch.count() and got.select("start", "event_type", "n").subtract(batch).count() == 0
    ingest.run_once(ingest.first_seen(ingest.read_events(spark, str(tmp_path / "in"), ddl).withColumn("h", F.col("event_id") % 50), "h", late="30 days"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 50


@pytest.mark.parametrize(("word", "want"), [p.split(":") for p in """caresses:caress ponies:poni caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit conformabli:conform radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homolog communism:commun activate:activ angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll""".split()])
def test_stems(word, want):
    """The examples of Porter's paper, carried through all steps."""
    assert lexical.stem(word) == want


def test_rank(spark):
    got = one(spark, lexical.rank(lexical.lexemes(F.lit("a b a, c A")), F.array(F.lit("a"), F.lit("z"))))
    assert got == pytest.approx(0.1 * (1 + 1 / 4 + 1 / 9) / 1.64493406685 / 2, abs=1e-6)
    assert one(spark, lexical.stemmed(F.lit("The readings of Heating"))) == ["read", "heat"]


def test_size_label_between_two(spark):
    """Halfway values go to the even digit, as the query's SQL has it."""
    d = spark.createDataFrame([(x,) for x in (1280, 1408, 790 * 1024 + 512, 791 * 1024 + 512, 5, 0)], "n long")
    assert [r[0] for r in d.select(text.size_label(F.col("n"))).collect()] == ["1.2 KB", "1.4 KB", "790 KB", "792 KB", "5.0 B", "—"]


def test_few_row_groups_are_dealt_over_the_cores(spark):
    """The part table is one small file: references are looked for by more than one task, and each number is resolved once."""
    from corpusloom.catalog import QUERIES
    from corpusloom.plans.references import extracted

    t = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    assert extracted(t).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    plan = QUERIES["link_references"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "BroadcastHashJoin" in plan


def test_words_begin_with_their_stems(spark):
    """All but the last letter of a stem begins its word, so keyword_search stems only such words: over made words of all endings."""
    ends = ["", "s", "es", "ies", "y", "ed", "eed", "ing", "e", "ll", *[x.split(":")[0] for x in f"{lexical.STEP_2} {lexical.STEP_3} {lexical.STEP_4}".split()], "ably", "ency", "ancy", "ently", "ously", "ality", "ivity", "bility"]
    for start in ("a", "re", "hop", "trou", "sens", "activ", "condit", "ya", "controll", "hizz", "é"):
        for one in ends:
            for two in ends:
                word = start + one + two
                assert word.startswith(lexical.stem(word)[:-1]), word
    d = spark.createDataFrame([(1, "other words " * 50 + "heated Heating"), (2, "nothing of it " * 50)], "id long, full_text string")
    found = retrieval.keyword_search(d, "heats", 5, stem=True)
    assert [r.id for r in found.collect()] == [1] and "StartsWith" in found._jdf.queryExecution().optimizedPlan().toString()
