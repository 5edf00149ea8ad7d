"""Source divergence audit: how far the sources of a language differ in their terms, and by which terms, in DataFrame and SQL functions alone.

A term's counts in all sources of its language are pivoted into one array, indexed by the sorted sources. Higher-order functions turn each such vector into smoothed shares and emit |p_i - p_j| for every pair of places; the map side of the aggregate sums these before anything is shuffled, so that a pair sends one row for each task. Terms are counted by partial aggregates too: no term, source or language is gathered in one task, however many of the rows it has.

Only the vectors of kept terms are written (one row each); the table of languages with their sources has one row for each language, and Spark broadcasts it only while it is below its own threshold. Numbers are exact: products are decimals of up to 38 digits and are divided as integers.

Defined results: null text, lang and source count as ``""``; each row is a document by itself, so that a repeated row counts again; an empty or letterless text makes its group occur and adds no term; a language without kept terms has value 0 for all its pairs and no terms; a language of one source has no pairs; equal values follow by the UTF-8 order of the item; an empty table gives an empty result; doc_id and other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, table

LEAST_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50

_UPPER = "".join(map(chr, range(65, 91)))
#: ASCII characters that belong to no term.
_OUTSIDE = "".join(map(chr, [*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group, and its documents there. A document's terms are sorted, so that the first of equal ones stands for the document."""
    letters = F.translate(F.coalesce("text", F.lit("")), _UPPER + _OUTSIDE, _UPPER.lower() + " " * len(_OUTSIDE))
    rows = docs.select("lang", "source", F.sort_array(F.split(letters, " ")).alias("_terms")).select("lang", "source", "_terms", F.posexplode("_terms").alias("_at", "term"))
    again = (F.col("_at") > 0) & (F.get("_terms", F.col("_at") - 1) == F.col("term"))
    return rows.filter("term <> ''").groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(again, None).otherwise(1)).alias("docs"))


def term_vectors(counts: DataFrame, sources: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, counts): the kept terms of a language, with an array of their occurrences in its ``sources``."""
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("_by")).filter(F.col("docs") >= least_docs)
    return kept.join(sources, "lang").select("lang", "term", F.transform("sources", lambda s: F.coalesce(F.try_element_at("_by", s), F.lit(0).cast("long"))).alias("counts"))


def _share(count: str, total: str) -> str:
    return f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + {SMOOTHING} AS DECIMAL(20, 0))) DIV CAST({total} + {SMOOTHING} * terms AS DECIMAL(20, 0))"


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source): part ``pair`` has the summed difference to each other source, part ``term`` the ``top`` terms that a source uses more than its language."""
    named = docs.select("text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    sources = materialize(named.select("lang", "source").distinct().groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources")))
    vectors = materialize(term_vectors(term_counts(named), sources, least_docs))
    # occurrences of kept terms by source, as an array too, and by language
    by_place = vectors.select("lang", F.posexplode("counts").alias("_i", "_n")).groupBy("lang", "_i").agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("terms"))
    sizes = by_place.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("_i", "_n")))["_n"].alias("sizes"), F.sum("_n").alias("size"), F.max("terms").alias("terms"))
    langs = materialize(sources.join(sizes, "lang", "left"))
    scored = vectors.join(langs, "lang").select(
        "lang", "term", "counts", F.expr(f"transform(counts, (c, i) -> {_share('c', 'sizes[i]')})").alias("p"),
        F.expr(_share("aggregate(counts, 0L, (a, c) -> a + c)", "size")).alias("q"),
    )

    nothing = langs.select("lang", F.transform("sources", lambda s: F.lit(0).cast("long")).alias("p"))
    emitted = "flatten(transform(p, (x, i) -> transform(slice(p, i + 2, size(p)), (y, j) -> named_struct('i', i, 'j', i + 1 + j, 'f', abs(x - y)))))"
    sums = scored.select("lang", "p").union(nothing).select("lang", F.explode(F.expr(emitted)).alias("_c")).groupBy("lang", "_c.i", "_c.j").agg(F.sum("_c.f").alias("value"))
    both = sums.join(langs.select("lang", "sources"), "lang").select("lang", "value", F.explode(F.expr("array(struct(sources[i] AS source, sources[j] AS item), struct(sources[j] AS source, sources[i] AS item))")).alias("_p"))
    pairs = both.select("lang", "_p.source", F.lit("pair").alias("part"), "_p.item", "value")

    used = scored.join(langs.select("lang", "sources"), "lang").select("lang", "term", "sources", "q", F.posexplode(F.arrays_zip("counts", "p")).alias("_i", "_v")).filter("_v.counts > 0 AND _v.p > q")
    terms = used.select("lang", F.expr("sources[_i]").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("_v.p") - F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    # the limit also holds before the shuffle, where Spark keeps as many rows of each group and task
    return pairs.withColumn("rank", rank).union(terms.withColumn("rank", rank).filter(F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 11 over all documents."""
    return divergence(table(spark, sf_dir, "documents"))


_P = f"1 + ({SCALE}::HUGEINT * ({{n}} + {SMOOTHING})) // ({{size}} + {SMOOTHING} * terms)"
ORACLE_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS text FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
groups AS (SELECT DISTINCT lang, source FROM d),
counted AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
cells AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, kept.n AS all_n FROM groups JOIN kept USING (lang) LEFT JOIN counted c USING (lang, source, term)),
sizes AS (SELECT lang, source, sum(n) AS size, sum(all_n) AS lang_size, count(*) AS terms FROM cells GROUP BY lang, source),
scored AS (SELECT lang, source, term, n, {_P.format(n='n', size='size')} AS p, {_P.format(n='all_n', size='lang_size')} AS q FROM cells JOIN sizes USING (lang, source)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM scored a JOIN scored b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM scored WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every QUALIFY part = 'pair' OR rank <= {TOP}"""
