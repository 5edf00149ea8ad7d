"""A substring index: which section's field holds which three characters in a row, so that a search reads the postings of its pattern's rarest trigrams and then only the rows that hold them all.

Three tables are written: ``grams`` (gram, field, chunk, places), for each chunk of at most ``CHARS`` characters or ``PLACES`` sections the places of those that hold a trigram, in the order of gram, so that row groups of other trigrams are skipped; its rows without a gram give the chunks' ids; ``counts`` (gram, field, n), in the same order; ``rows``, the sections in the order of id, so that a few candidates are read from their row groups alone. A row for each chunk and trigram, not for each section and trigram, is what is shuffled and sorted: its list of 16-bit places takes some bytes a section. Candidates are verified by the pattern itself. A pattern without three characters in a row between its wildcards can't use the index and scans ``rows``.

Defined results: those of ``retrieval.like_search``; null fields hold nothing; fields shorter than three characters have no trigram, and no pattern that uses the index matches them; an empty table gives an index without rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.retrieval import MOST, like_search

SIZE = 3
#: Trigrams of a pattern that are read, the rarest; candidates that are fetched by a list of ids, beyond which they are joined.
READ, LISTED = 4, 2000
#: A chunk of postings ends at so many characters or sections; Arrow batches end at so many bytes.
CHARS, PLACES, BATCH_BYTES = 1 << 20, 1 << 15, 16 << 20


@dataclass
class TrigramIndex:
    grams: DataFrame
    counts: DataFrame
    rows: DataFrame
    fields: tuple[str, ...]


def trigrams(text):
    """The different trigrams of a text in small letters, in one pass over its characters."""
    chars = F.split(F.lower(text), "")
    # three shifted copies, joined place by place: an expression inside a lambda would be computed anew for each place
    n = F.greatest(F.char_length(F.lower(text)) - (SIZE - 1), F.lit(0))
    one, two, three = (F.slice(chars, F.lit(k), n) for k in (1, 2, 3))
    return F.array_distinct(F.zip_with(F.zip_with(one, two, lambda a, b: F.concat(a, b)), three, lambda a, b: F.concat(a, b)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``grams`` for batches of id and the fields in small letters."""
    chunk = TaskContext.get().partitionId() << 32
    for b in batches:
        texts = [[t.decode("utf-8", "replace") for t in c.to_pylist()] for c in b.columns[1:]]
        sizes, start = np.cumsum([sum(map(len, row)) for row in zip(*texts, strict=True)]), 0
        while start < b.num_rows:
            before = sizes[start - 1] if start else 0
            end = min(start + PLACES, max(start + 1, int(np.searchsorted(sizes, before + CHARS, "right"))))
            ids = pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), b.column(0).slice(start, end - start))
            yield _posting(chunk, ids, pa.array([None], pa.string()), 0, pa.nulls(1, pa.list_(pa.int16())))
            for field, t in enumerate(texts):
                grams, places = _places(t[start:end])
                yield _posting(chunk, pa.nulls(len(grams), ids.type), grams, field, places)
            chunk, start = chunk + 1, end


def _posting(chunk: int, ids: pa.Array, grams: pa.Array, field: int, places: pa.Array) -> pa.RecordBatch:
    n = len(grams)
    return pa.record_batch([pa.array(np.full(n, chunk, np.int64)), ids, grams, pa.array(np.full(n, field, np.int32)), places], names=["chunk", "ids", "gram", "field", "places"])


def _places(texts: list[str]) -> tuple[pa.Array, pa.Array]:
    """The different trigrams of ``texts`` and, for each, the places of the texts that hold it."""
    chars, code = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), return_inverse=True)
    row, k = np.repeat(np.arange(len(texts)), [len(t) for t in texts]), len(chars)
    if len(row) < SIZE:
        return pa.array([], pa.string()), pa.array([], pa.list_(pa.int16()))
    whole = row[:-2] == row[2:]
    gram, row = ((code[:-2] * k + code[1:-1]) * k + code[2:])[whole], row[:-2][whole]
    if k**3 * len(texts) < 1 << 63:
        both = np.sort(gram * len(texts) + row)
        both = both[np.diff(both, prepend=-1) > 0]
        gram, row = both // len(texts), both % len(texts)
    else:  # very many different characters
        order = np.lexsort((row, gram))
        gram, row = gram[order], row[order]
        new = (np.diff(gram, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0)
        gram, row = gram[new], row[new]
    first = np.flatnonzero(np.diff(gram, prepend=-1))
    held = gram[first]
    letters = chars[np.stack([held // (k * k), held // k % k, held % k], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    grams = pa.array([letters[i : i + SIZE] for i in range(0, len(letters), SIZE)], pa.string())
    return grams, pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(row.astype(np.int16)))


def build(sections: DataFrame, path: str, fields: tuple[str, ...] = ("section_title", "full_text")) -> TrigramIndex:
    """Writes the index of ``sections`` (id and the fields) below ``path``."""
    sections.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/rows")
    rows = sections.sparkSession.read.schema(sections.schema).parquet(f"{path}/rows")
    spark, kind = sections.sparkSession, sections.schema["id"].dataType.simpleString()
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    held = rows.select("id", *[F.lower(F.coalesce(f, F.lit(""))).cast("binary").alias(f"_{k}") for k, f in enumerate(fields)]).mapInArrow(_chunks, f"chunk long, ids array<{kind}>, gram string, field int, places array<smallint>")
    # the rows that give ids are dealt by their chunk
    dealt = held.repartition(F.coalesce("gram", F.col("chunk").cast("string")))
    dealt.select("gram", "field", "chunk", "places", "ids").sortWithinPartitions("gram", "field", "chunk").write.parquet(f"{path}/grams")
    stored = sections.sparkSession.read.parquet(f"{path}/grams")
    stored.filter("gram IS NOT NULL").groupBy("gram", "field").agg(F.sum(F.size("places")).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
    return open_index(sections.sparkSession, path, sections.schema, fields)


def open_index(spark: SparkSession, path: str, schema, fields: tuple[str, ...] = ("section_title", "full_text")) -> TrigramIndex:
    """The index below ``path``, in this session or a later one."""
    kind = schema["id"].dataType.simpleString()
    return TrigramIndex(
        spark.read.schema(f"gram string, field int, chunk long, places array<smallint>, ids array<{kind}>").parquet(f"{path}/grams"), spark.read.schema("gram string, field int, n long").parquet(f"{path}/counts"),
        spark.read.schema(schema).parquet(f"{path}/rows"), fields,
    )


def literal_parts(q: str) -> list[str]:
    """What a pattern asks for between its wildcards ``%`` and ``_``; a backslash makes the next character an ordinary one."""
    parts, part, quoted = [], "", False
    for c in q:
        if quoted or c not in "%_\\":
            part, quoted = part + c, False
        elif c == "\\":
            quoted = True
        else:
            parts, part = [*parts, part], ""
    return [p for p in [*parts, part] if p]


def candidates(index: TrigramIndex, q: str) -> DataFrame | None:
    """(id) of the sections of which a field holds the rarest trigrams of ``q``; None where it has no trigram."""
    grams = sorted({p[i : i + SIZE] for p in _lowered(index.grams.sparkSession, literal_parts(q)) for i in range(len(p) - SIZE + 1)})
    if not grams:
        return None
    known = index.counts.filter(F.col("gram").isin(grams)).collect()  # a row for each trigram and field
    wanted = None
    for field in range(len(index.fields)):
        n = {r.gram: r.n for r in known if r.field == field}
        if all(g in n for g in grams):
            rarest = sorted(grams, key=lambda g: (n[g], g))[:READ]  # noqa: B023
            at = index.grams.filter(F.col("gram").isin(rarest) & (F.col("field") == field)).select("chunk", F.explode("places").alias("place"))
            # a chunk has each trigram of a field once, and a place once in it
            found = at.groupBy("chunk", "place").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(rarest)).select("chunk", "place")
            wanted = found if wanted is None else wanted.union(found)
    if wanted is None:
        return index.rows.select("id").limit(0)
    ids = index.grams.filter("gram IS NULL").select("chunk", "ids")
    return wanted.distinct().join(ids, "chunk").select(F.get("ids", F.col("place").cast("int")).alias("id")).distinct()


def _lowered(spark: SparkSession, parts: list[str]) -> list[str]:
    """In small letters as Spark writes them."""
    return [r[0] for r in spark.createDataFrame([(p,) for p in parts], "p string").select(F.lower("p")).collect()] if parts else []


def search(index: TrigramIndex, q: str, limit: int = MOST) -> DataFrame:
    """What ``retrieval.like_search`` gives for ``q``, read through the index."""
    found = candidates(index, q)
    if found is None:
        return like_search(index.rows, q, index.fields, limit)
    few = [r.id for r in found.limit(LISTED + 1).collect()]
    rows = index.rows.filter(F.col("id").isin(few)) if len(few) <= LISTED else index.rows.join(found, "id", "left_semi")
    return like_search(rows, q, index.fields, limit)

