"""The indexes against the scans that they replace."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import catalog  # noqa: F401  the plans register themselves there
from corpusloom.operators import retrieval, trigram_index, vector_index
from corpusloom.plans.retrieval import Q
from corpusloom.steps import shared_dir

DIR = "/root/testdata/sf0.1"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def embeddings(spark):
    v = spark.read.parquet(f"{DIR}/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    return v, vector_index.build(v, shared_dir(spark))


def test_all_rows_are_indexed(embeddings):
    v, index = embeddings
    assert index.rows.select("id").exceptAll(v.select("id")).count() == 0 and index.rows.count() == v.count()
    assert index.counts.sum() == v.count() and len(index.numbers) == round(v.count() ** 0.5)


def test_recall_of_probed_cells(embeddings):
    """Over the vectors whose number is divisible by 100, against all rows by brute force."""
    v, index = embeddings
    rows = v.collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, found = np.array([r.id for r in rows]), {}
    asked = v.filter("id % 100 = 0").withColumnRenamed("id", "query")
    for r in vector_index.search_many(index, asked, 10).collect():
        found.setdefault(r.query, set()).add(r.id)
    hits = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        scores = np.round(x @ x[i], 6)
        want = set(ids[np.lexsort((ids, -scores))[:10]].tolist())
        hits, total = hits + len(want & found[ids[i]]), total + 10
    assert total >= 200 and hits / total >= 0.9


def test_probed_cells_alone_are_read(embeddings):
    _, index = embeddings
    df = vector_index.search(index, Q, 10)
    assert re.search(r"PartitionFilters: \[(isnotnull\(cell#\d+\), )?cell#\d+ (IN|INSET) ", plan_of(df))
    assert df.collect() and index.probes < len(index.numbers)


@pytest.mark.parametrize("k", [1, 10, 300])
def test_exact_mode(embeddings, k):
    v, index = embeddings
    r = np.random.default_rng(k)
    near = v.orderBy("id").first().embedding
    for q in (Q, near, r.normal(size=64).tolist()):
        assert vector_index.search_exact(index, q, k, probes=1).collect() == retrieval.nearest(v, q, k).collect()


def test_exact_mode_leaves_cells_out(spark, tmp_path):
    r = np.random.default_rng(5)
    rows = [(i, (np.eye(8)[i % 8] + r.normal(size=8) * 0.02).tolist()) for i in range(400)]
    index = vector_index.build(spark.createDataFrame(rows, "id long, embedding array<double>"), str(tmp_path / "v"), cells=8)
    df = vector_index.search_exact(index, rows[3][1], 5, probes=1)
    said = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan_of(df), re.S)[1]
    assert said.count(",") < 4  # few cells of the eight


def test_large_cells_and_ties(spark, tmp_path, monkeypatch):
    """A third of the rows in one cell, more queries than a block; equal scores follow by id."""
    monkeypatch.setattr(vector_index, "PIECE", 50)
    monkeypatch.setattr(vector_index, "BLOCK", 7)
    r = np.random.default_rng(2)
    rows = [(i, [1.0, 0.0, 0.0, 0.0] if i % 3 == 0 else r.normal(size=4).tolist()) for i in range(600)]
    rows += [(900, None), (901, [0.0] * 4), (5, rows[5][1])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = vector_index.build(v, str(tmp_path / "v"), cells=6)
    asked = v.filter("id < 60").withColumnRenamed("id", "query").dropDuplicates(["query"])
    got = {}
    for x in vector_index.search_many(index, asked, 8, exact=True).collect():
        got.setdefault(x.query, []).append((x.place, x.id, x.score))
    for q, e in rows[:60:7]:
        want = [(i + 1, y.id, y.score) for i, y in enumerate(retrieval.nearest(v, e, 8).collect())]
        assert [(a, b) for a, b, _ in sorted(got[q])] == [(a, b) for a, b, _ in want]
        assert [c for *_, c in sorted(got[q])] == pytest.approx([c for *_, c in want])
    all_cells = sorted(map(tuple, vector_index.search_many(index, asked, 8, probes=6).collect()))
    assert all_cells == sorted((q, i, s, p) for q, found in got.items() for p, i, s in found)


def test_pieces_meet_blocks_in_slices(spark, tmp_path, monkeypatch):
    """A slice smaller than k, and ties over several slices."""
    monkeypatch.setattr(vector_index, "SLICE", 3)
    rows = [(i, [1.0, float(i % 4)]) for i in range(40)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = vector_index.build(v, str(tmp_path / "v"), cells=2)
    got = vector_index.search_many(index, v.filter("id = 6").withColumnRenamed("id", "query"), 8, exact=True).orderBy("place").collect()
    assert [(r.id, r.score) for r in got] == [tuple(r) for r in retrieval.nearest(v, rows[6][1], 8).collect()]


def test_no_vectors(spark, tmp_path):
    v = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "id long, embedding array<float>")
    index = vector_index.build(v, str(tmp_path / "v"))
    assert vector_index.search(index, [1.0, 0.0], 3).count() == vector_index.search_exact(index, [1.0, 0.0], 3).count() == 0
    assert vector_index.search_many(index, v.withColumnRenamed("id", "query"), 3).count() == 0


TEXTS = [None, "", "ab", "abc", "ABC def", "xx%yy_zz", "a\\b c", "été Été", "İstanbul", "tab\tnew\nline abc", "aaaaaaa", "the heat of the anea", "😀😀😀 end", "abXcd abYcd", "ab" + "c" * 4000]
PATTERNS = ["abc", "ABC D", "ab_cd", "th%anea", "%", "_", "", "ab", "été", "ÉTÉ", "i̇st", "😀😀😀", "xx\\%yy", "\\_zz", "zzz", "aaaaaa", "new\nline", "c%c", "heat%abc", "a\\\\b c", "ccc%ccc", "___", "no such text"]


@pytest.fixture(scope="module")
def text_index(spark):
    rows = [(i, TEXTS[(i * 5) % len(TEXTS)] if i % 2 else f"title {i}", TEXTS[i % len(TEXTS)], i) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, section_title string, full_text string, gram long").repartition(3)
    return df, trigram_index.build(df, shared_dir(spark))


@pytest.mark.parametrize("q", PATTERNS)
def test_same_rows_as_the_scan(text_index, q):
    df, index = text_index
    assert trigram_index.search(index, q).collect() == retrieval.like_search(df, q).collect()


def test_many_candidates_are_joined(text_index, monkeypatch):
    df, index = text_index
    monkeypatch.setattr(trigram_index, "LISTED", 1)
    assert trigram_index.search(index, "abc").collect() == retrieval.like_search(df, "abc").collect()


def test_trigrams_by_brute_force(spark):
    r = random.Random(4)
    texts = ["".join(r.choices("abAé😀 \n", k=r.randint(0, 40))) for _ in range(200)]
    for row in spark.createDataFrame([(t,) for t in texts], "t string").select("t", trigram_index.trigrams(F.col("t")).alias("g"), F.lower("t").alias("l")).collect():
        assert sorted(row.g) == sorted({row.l[i : i + 3] for i in range(len(row.l) - 2)})


def test_postings_are_lists_of_places(spark, tmp_path):
    """A row for each chunk and trigram: many sections that share their trigrams make few rows."""
    d = spark.range(3000).selectExpr("id", "'title' AS section_title", "concat('the same text ', id % 3) AS full_text")
    index = trigram_index.build(d.coalesce(1), str(tmp_path / "t"))
    assert index.grams.count() < 3000
    assert index.counts.filter("gram = 'sam'").first().n == 3000
    texts = ["", "abcab", "\U0001f600abc" * 9, "ab", "abc\0\0"]
    found, at = trigram_index._places(texts)
    assert dict(zip(found.to_pylist(), at.to_pylist(), strict=True)) == {g: [i for i, t in enumerate(texts) if g in t] for g in {t[i : i + 3] for t in texts for i in range(len(t) - 2)}}


def test_wildcards_in_a_long_text_are_not_tried_again(spark):
    """A text that holds the first pieces very often and the last one never: LIKE's own expression tries every way."""
    d = spark.createDataFrame([(1, "t", "th heat " * 20000), (2, "t", "th heat " * 20000 + "heats an")], "id long, section_title string, full_text string")
    assert [r.id for r in retrieval.like_search(d, "th%heat%heat_ an").collect()] == [2]


def test_row_groups_are_skipped(spark):
    """The filter on the trigrams reaches the scan of postings, which reads a part of them."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id AS id", "source AS section_title", "text AS full_text")
    index = trigram_index.build(d, shared_dir(spark))
    found = trigram_index.candidates(index, "heat_ an")
    assert "PushedFilters: [" in plan_of(found) and "In(gram" in plan_of(found)
    rows = trigram_index.search(index, "heat_ an")
    assert "In(id" in plan_of(rows) or "EqualTo(id" in plan_of(rows)
    assert rows.collect() == retrieval.like_search(d, "heat_ an").collect()


def test_empty_index(spark, tmp_path):
    df = spark.createDataFrame([], "id long, section_title string, full_text string")
    assert trigram_index.search(trigram_index.build(df, str(tmp_path / "t")), "abc").count() == 0


def counted(d):
    """Terms of each section by the words themselves."""
    return d.select("id", F.explode(retrieval.lexemes(F.col("full_text"))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("n"))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_postings_count_all_words(spark, tmp_path, kind):
    """Odd texts, an id that comes twice, and letters that some engines don't know as such (a Vithkuqi and a Kawi one)."""
    r = random.Random(7)
    texts = [None, "", " ", ".,;", "one", "One ONE,one!", "İstanbul STRASSE straße", "éte été", "a\u0000b\nb\ta", "x_y-7٣ ½", "\U00010570a \U00011f04b ࡰc", "\U0001f600heat\U0001f600", "word " * 5000]
    texts += ["".join(r.choices("abÀÉßж中🙂 ,\n0", k=r.randint(0, 60))) for _ in range(300)]
    rows = [(i, x) for i, x in enumerate(texts)] + [(5, "one two"), (-3, "two " * 3)]
    d = spark.createDataFrame(rows, "id long, full_text string").select(F.col("id").cast(kind).alias("id"), "full_text").repartition(3)
    index = retrieval.postings(d, str(tmp_path / "p"))
    assert index.schema["n"].dataType.simpleString() == "bigint" and index.columns == ["term", "id", "n"]
    want = sorted(map(tuple, counted(d).collect()))
    assert sorted(map(tuple, index.collect())) == want and len(want) > 500
    assert sorted(map(tuple, retrieval.open_postings(spark, str(tmp_path / "p"), d.schema).collect())) == want


def test_postings_are_a_row_for_each_batch_and_term(spark, tmp_path):
    """Many sections that share their terms make few rows, which are all that is dealt and sorted; a search's filter reaches their scan."""
    d = spark.range(3000).selectExpr("id", "concat('the same heat the text ', id % 3) AS full_text")
    index = retrieval.postings(d.coalesce(1), str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    assert stored.count() < 3000 and index.filter("term = 'the' AND n = 2").count() == 3000
    found = retrieval.search_postings(index, "the heat", 20)
    assert "PushedFilters: [In(term, [" in plan_of(found)
    assert found.collect() == retrieval.keyword_search(d, "the heat", 20).collect()


def test_no_postings(spark, tmp_path):
    d = spark.createDataFrame([], "id long, full_text string")
    assert retrieval.search_postings(retrieval.postings(d, str(tmp_path / "p")), "abc", 5).count() == 0
