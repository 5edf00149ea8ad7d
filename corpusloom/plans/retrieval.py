"""Search over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.operators import retrieval as r
from corpusloom.operators.outline import two_hops
from corpusloom.sources.files import with_embeddings
from corpusloom.steps import shared_dir, written

Q = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in Q) + "]"
WORDS = "the heat, erth the ANEA!"


def sections(t):
    return t("documents").selectExpr("doc_id AS id", "source AS section_title", "text AS full_text")


def vectors(t):
    return t("embeddings").selectExpr("vec_id AS id", "embedding")


_DOT = "list_sum(list_transform(generate_series(1, 64), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_COSINE = f"round({_DOT.format(a='embedding', b=_Q)} / (sqrt({_DOT.format(a='embedding', b='embedding')}) * sqrt({_DOT.format(a=_Q, b=_Q)})), 6)"
_V = f"v AS (SELECT vec_id AS id, {_COSINE} AS score FROM embeddings ORDER BY score DESC NULLS LAST, id LIMIT 10)"
_TERMS = "['the', 'heat', 'erth', 'anea']"
_K = f"""k AS (SELECT id, round(list_sum(list_transform({_TERMS}, lambda q: coalesce(list_sum(list_transform(range(1, 1 + len(list_filter(w, lambda x: x = q))), lambda k: 1.0::DOUBLE / (k * k))), 0.0))) * 0.1 / 1.64493406685 / 4, 6) AS score
 FROM (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}0-9]+'), lambda x: x <> '') AS w FROM documents) WHERE list_has_any(w, {_TERMS}) ORDER BY score DESC, id LIMIT 10)"""
_H = f"""WITH {_V}, {_K}, h AS (SELECT id, score, search_type, row_number() OVER (ORDER BY leg, score DESC, id) AS place FROM (SELECT id, score, 1 AS leg, 'vector' AS search_type FROM v UNION ALL SELECT id, score, 2, 'keyword' FROM k WHERE id NOT IN (SELECT id FROM v))),
hybrid AS (SELECT * FROM h WHERE place <= 15)"""


@query("G1 P2 P12 T1", "SELECT doc_id AS id, source AS section_title, substring(text, 1, 500) AS full_text FROM documents WHERE source ILIKE '%heat%' OR text ILIKE '%heat%' ORDER BY doc_id LIMIT 50")
def lexical_search(t):
    return r.like_search(sections(t), "heat")


@query("G2 T2 P6", f"WITH {_V} SELECT * FROM v")
def cosine_topk(t):
    return r.nearest(vectors(t), Q, 10)


@query("P5", f"SELECT vec_id AS id, {_COSINE} AS score FROM embeddings WHERE {_COSINE} > 0.2 ORDER BY score DESC, id LIMIT 5")
def cosine_above(t):
    return r.nearest(vectors(t), Q, 5, 0.2)


@query("G3 P7 F30", f"WITH {_K} SELECT * FROM k")
def keyword_topk(t):
    return r.keyword_search(sections(t), WORDS, 10)


@query("G3 P7")
def keyword_stemmed(t):
    """The same by stems, without stop words; the stemmer is held against published pairs in tests/test_operators.py."""
    return r.keyword_search(sections(t), "heating the anthly readings", 10, stem=True)


@query("G3 P7 F30", f"WITH {_K} SELECT * FROM k")
def keyword_index(t):
    """The same from an index of postings, written once and read for the query's terms only."""
    d = sections(t)
    return r.search_postings(r.postings(d, shared_dir(d.sparkSession)), WORDS, 10)


def _hybrid(t):
    return r.hybrid(r.nearest(vectors(t), Q, 10), r.keyword_search(sections(t), WORDS, 10), 15)


@query("G4 U2 J12", _H + " SELECT id, score, search_type, CAST(place AS INTEGER) AS place FROM hybrid")
def hybrid_merge(t):
    return _hybrid(t)


@query("G5", _H + """, e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem), one AS (SELECT DISTINCT id AS source, dst AS id, 1 AS depth FROM hybrid JOIN e ON src = id WHERE place <= 5),
 reached AS (SELECT * FROM one UNION SELECT DISTINCT source, dst, 2 FROM one JOIN e ON src = one.id), near AS (SELECT place, r.id, min(depth) AS depth FROM reached r JOIN hybrid h ON h.id = r.source WHERE place <= 5 GROUP BY place, r.id),
 cut AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY depth, id) AS n FROM near QUALIFY n <= 10), fresh AS (SELECT id, min((place, n)) AS p FROM cut WHERE id NOT IN (SELECT id FROM hybrid) GROUP BY id),
 listed AS (SELECT id, place, 0 AS n FROM hybrid WHERE place <= 5 UNION ALL SELECT id, p[1], p[2] FROM fresh)
 SELECT string_agg('Section ' || id || ': ' || source || chr(10) || substring(text, 1, 500) || '...', chr(10) || chr(10) ORDER BY place, n) AS context FROM listed JOIN documents ON doc_id = id""")
def rag_context(t):
    """The text that goes before a question: hits, and what they refer to."""
    hits = written(_hybrid(t).select("id", "place"))
    edges = t("lineitem").selectExpr("l_partkey AS src", "l_suppkey AS dst").distinct()
    reached = two_hops(edges, hits.filter("place <= 5").select(F.col("id").alias("source")))
    listed = r.context(hits, reached, sections(t))
    line = F.concat(F.lit("Section "), F.col("id").cast("string"), F.lit(": "), "section_title", F.lit("\n"), F.substring("full_text", 1, r.SHOWN), F.lit("..."))
    return listed.agg(F.array_sort(F.collect_list(F.struct("place", "n", line.alias("line")))).alias("x")).select(F.array_join(F.transform("x", lambda s: s.line), "\n\n").alias("context"))


@query("S17", "SELECT doc_id, [length(text)::DOUBLE, (length(text) - length(replace(text, ' ', '')))::DOUBLE] AS embedding FROM documents")
def embed_texts(t):
    """Vectors of texts by an embedder of the caller's, in Arrow batches; here one that counts characters and spaces, so that SQL can tell what it gives."""
    made = with_embeddings(t("documents").select("doc_id", "text"), "text", lambda ts: [[float(len(x)), float(x.count(" "))] for x in ts])
    return made.select("doc_id", F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))
