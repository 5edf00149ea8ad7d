"""Search by indexes: each query builds its index in the shared folder and searches that."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.operators import retrieval as r
from corpusloom.operators import trigram_index, vector_index
from corpusloom.plans.retrieval import _DOT, _H, _V, Q, WORDS, sections, vectors
from corpusloom.steps import shared_dir

LIKE = "th%heat_ an"


def _vectors(t):
    v = vectors(t)
    return vector_index.build(v, shared_dir(v.sparkSession))


@query("G2 T2", f"WITH {_V} SELECT * FROM v")
def vector_index_exact(t):
    """The ten nearest of all by the index: cells that can't hold one of them aren't read."""
    return vector_index.search_exact(_vectors(t), Q, 10)


@query("G2 T2")
def vector_index_probed(t):
    """The ten nearest in the nearest cells. Recall is measured in tests/test_indexes.py."""
    return vector_index.search(_vectors(t), Q, 10)


_NEIGHBOURS = f"""SELECT query, id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS place FROM (SELECT q.vec_id AS query, e.vec_id AS id,
 round({_DOT.format(a='q.embedding', b='e.embedding')} / (sqrt({_DOT.format(a='q.embedding', b='q.embedding')}) * sqrt({_DOT.format(a='e.embedding', b='e.embedding')})), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) QUALIFY place <= 10"""


@query("G2 T3", _NEIGHBOURS)
def vector_neighbours(t):
    """The ten nearest of all rows to each of the stated queries, the vectors whose number is divisible by 100."""
    asked = t("embeddings").filter("vec_id % 100 = 0").selectExpr("vec_id AS query", "embedding")
    return vector_index.search_many(_vectors(t), asked, 10, exact=True)


@query("G2 T3")
def vector_neighbours_probed(t):
    """The same in each query's nearest cells."""
    asked = t("embeddings").filter("vec_id % 100 = 0").selectExpr("vec_id AS query", "embedding")
    return vector_index.search_many(_vectors(t), asked, 10)


@query("G1 P2 P12 T1", f"SELECT doc_id AS id, source AS section_title, substring(text, 1, 500) AS full_text FROM documents WHERE source ILIKE '%{LIKE}%' OR text ILIKE '%{LIKE}%' ORDER BY doc_id LIMIT 50")
def substring_index(t):
    """Substring search, with wildcards, by trigrams."""
    d = sections(t)
    return trigram_index.search(trigram_index.build(d, shared_dir(d.sparkSession)), LIKE)


@query("G4 U2 J12 G3", _H + " SELECT id, score, search_type, CAST(place AS INTEGER) AS place FROM hybrid")
def hybrid_index(t):
    """The hybrid merge of both indexes: cells of vectors, postings of terms."""
    d = sections(t)
    index = r.postings(d, shared_dir(d.sparkSession))
    return r.hybrid(vector_index.search_exact(_vectors(t), Q, 10), r.search_postings(index, WORDS, 10), 15)
