"""Lexical, vector and hybrid search, and the context of an answer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.lexical import LIMIT, WEIGHT, lexemes, parted, rank, stemmed, stems
from corpusloom.steps import written

SHOWN, MOST = 500, 50
#: Arrow batches of postings end at so many bytes.
BATCH_BYTES = 8 << 20


def like_pattern(spark: SparkSession, q: str) -> str | None:
    """A regular expression for small letters that hold ``q`` (``%`` and ``_`` are wildcards, a backslash makes them ordinary); None where a backslash stands before anything else.

    Each piece between two ``%`` is taken where it first occurs after the one before, and not looked for again: what LIKE's own expression does for a text without the last piece grows with the square of the text or faster.
    """
    low = q.lower() if q.isascii() else spark.range(1).select(F.lower(F.lit(q))).first()[0]
    pieces, quoted = [""], False
    for c in low:
        if quoted and c not in "%_\\":
            return None
        if not quoted and c == "%":
            pieces.append("")
        elif quoted or c != "\\":
            pieces[-1] += "." if c == "_" and not quoted else f"\\x{{{ord(c):x}}}"
        quoted = c == "\\" and not quoted
    return None if quoted else r"(?s)\A" + "".join(f"(?>.*?{p})" for p in pieces if p)


def like_search(sections: DataFrame, q: str, fields: tuple[str, ...] = ("section_title", "full_text"), limit: int = MOST) -> DataFrame:
    """Rows where a field holds ``q`` in any case (``%`` and ``_`` are wildcards); the first by id, since nothing else orders them."""
    hit, pattern = None, like_pattern(sections.sparkSession, q)
    for f in fields:
        # Spark searches for a text without wildcards as such
        one = F.lower(f).rlike(pattern) if pattern and "%" in q else F.col(f).ilike(f"%{q}%")
        hit = one if hit is None else hit | one
    found = sections.filter(hit) if q else sections
    return found.orderBy("id").limit(limit).withColumn("full_text", F.substring(F.coalesce("full_text", F.lit("")), 1, SHOWN))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, summed in double; null where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def nearest(vectors: DataFrame, q: list[float], k: int, least: float | None = None) -> DataFrame:
    """(id, score) of the ``k`` nearest of ``vectors`` (id, embedding): exact; a scan and one top-k, of which each task keeps k rows."""
    scored = vectors.filter("embedding IS NOT NULL").select("id", F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])), 6).alias("score"))
    if least is not None:
        scored = scored.filter(F.col("score") > least)
    return scored.orderBy(F.desc_nulls_last("score"), "id").limit(k)


def keyword_search(sections: DataFrame, q: str, k: int, stem: bool = False) -> DataFrame:
    """(id, score) of the ``k`` best of ``sections`` (id, full_text) that hold a term of ``q``; by stems, or by words as they are. A scan of all texts: for more than a few searches see ``postings``."""
    terms = query_lexemes(sections.sparkSession, q, stem)
    text = F.lower("full_text")
    # a word begins with its stem but for the stem's last letter: texts without such beginnings go, and of the rest only words with one are stemmed
    begun = [t[:-1] if stem else t for t in terms]
    near = reduce(lambda a, b: a | b, [text.contains(t) for t in begun], F.lit(False))

    def of(c: Column) -> Column:
        words = lexemes(c)
        return stems(F.filter(words, lambda w: reduce(lambda a, b: a | b, [w.startswith(b) for b in begun], F.lit(False)))) if stem else words

    wanted = F.array(*map(F.lit, terms)) if terms else F.expr("cast(array() as array<string>)")
    found = sections.filter(near).select("id", of(F.col("full_text")).alias("_words")).filter(F.arrays_overlap("_words", wanted))
    return found.select("id", rank(F.col("_words"), wanted).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def query_lexemes(spark, q: str, stem: bool) -> list[str]:
    """The distinct terms of a query, cut as texts are."""
    return spark.range(1).select(F.array_distinct((stemmed if stem else lexemes)(F.lit(q)))).first()[0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For batches of id and words parted by blanks: each term, the ids of the sections that have it, and how often each does."""
    for b in batches:
        n = max(b.num_rows, 1)
        words = pc.split_pattern(b.column(1), " ")
        coded = words.flatten().dictionary_encode()
        # sorted by term, then row: what is equal stands together
        both = coded.indices.to_numpy().astype(np.int64)
        both *= n
        both += pc.list_parent_indices(words).to_numpy()
        both.sort()
        first = np.flatnonzero(np.append(len(both) > 0, both[1:] != both[:-1]))
        times = pa.array(np.diff(np.append(first, len(both))).astype(np.int32))
        code, row = np.divmod(both[first], n)
        starts = pa.array(np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(starts, v) for v in (b.column(0).take(pa.array(row)), times)]
        made = pa.record_batch([coded.dictionary, *lists], names=["term", "ids", "times"])
        yield made.filter(pc.not_equal(coded.dictionary, ""))


def postings(sections: DataFrame, path: str, stem: bool = False) -> DataFrame:
    """(term, id, n): how often each section (id, full_text) has each term, written to ``path`` in the order of term, so that a search reads the pages of its terms only. With ``stem``, each different word is stemmed once.

    Words are counted within a batch of sections. A row for each batch and term, with lists of ids and counts, is what is shuffled, once, and sorted; large parts are divided, even those of one term.
    """
    spark = sections.sparkSession
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    words = sections.select("id", parted(F.col("full_text")).alias("_words")).mapInArrow(_counted, _lists(sections.schema))
    if stem:
        words = written(words)
        stems_ = words.select("term").distinct().select("term", F.explode(stems(F.array("term"))).alias("_stem"))
        words = words.join(stems_, "term").select(F.col("_stem").alias("term"), "ids", "times")
    words.hint("rebalance", "term").sortWithinPartitions("term").write.parquet(path)
    return open_postings(spark, path, sections.schema)


def _lists(schema: T.StructType) -> str:
    return f"term string, ids array<{schema['id'].dataType.simpleString()}>, times array<int>"


def open_postings(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The postings below ``path``, in this session or a later one; a filter on the term reaches their scan. ``schema``: that of the sections."""
    one = spark.read.schema(_lists(schema)).parquet(path).select("term", F.explode(F.arrays_zip("ids", "times")).alias("_x"))
    return one.groupBy("term", F.col("_x.ids").alias("id")).agg(F.sum("_x.times").alias("n"))


def search_postings(index: DataFrame, q: str, k: int, stem: bool = False) -> DataFrame:
    """What ``keyword_search`` gives, from ``postings``."""
    terms = query_lexemes(index.sparkSession, q, stem)
    weight = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("n")), F.lit(0.0), lambda s, i: s + 1.0 / (i * i))
    hits = index.filter(F.col("term").isin(terms)).select("id", weight.alias("w"))
    score = F.round(F.sum("w") * WEIGHT / LIMIT / max(len(terms), 1), 6)
    return hits.groupBy("id").agg(score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hybrid(by_vector: DataFrame, by_keyword: DataFrame, limit: int) -> DataFrame:
    """Both lists (id, score) one after the other, an id that both have from the vectors; the first ``limit``. Both are top-k lists, so their merge is small by construction."""
    by_vector = written(by_vector)  # used twice, computed once
    ranked = lambda df, leg, name: df.withColumn("leg", F.lit(leg)).withColumn("search_type", F.lit(name))
    both = ranked(by_vector, 1, "vector").unionByName(ranked(by_keyword.join(by_vector, "id", "left_anti"), 2, "keyword"))
    place = F.row_number().over(Window.orderBy("leg", F.desc("score"), "id"))
    return both.withColumn("place", place).filter(F.col("place") <= limit).drop("leg")


def context(hits: DataFrame, reached: DataFrame, sections: DataFrame, top: int = 5, each: int = 10) -> DataFrame:
    """The sections that go into an answer's context, in order. ``hits``: (id, place); ``reached``: (source, id, depth) of references.

    The first ``top`` hits stand in order, each followed by the sections its references reach (at most ``each``, by depth, then id) that were neither hit, even beyond the first ``top``, nor reached from an earlier hit.
    """
    first = hits.filter(F.col("place") <= top)
    near = reached.join(first.select(F.col("id").alias("source"), "place"), "source").groupBy("place", "id").agg(F.min("depth").alias("depth"))
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("place").orderBy("depth", "id"))).filter(F.col("n") <= each)
    fresh = near.join(hits.select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct("place", "n")).alias("p")).select("id", "p.place", "p.n")
    listed = first.select("id", "place", F.lit(0).alias("n")).unionByName(fresh)
    return listed.join(sections, "id")
