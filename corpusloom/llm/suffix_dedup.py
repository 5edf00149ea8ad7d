"""Suffix-array dedup: substrings of ``length`` bytes that start earlier are removed, found by distributed prefix doubling.

Ranks of positions double from 8 to 16 to 32 bytes, Spark sorts rank-position rows, unique ranks drop out, what is left is ranked on at 93 and 100 bytes, past the threshold. ``repeats`` says how rows of neighbouring positions travel as one.

This departs from the textbook form, in which every position is a row of every sort. Up to 32 bytes a rank is a 64-bit name that a worker computes by doubling within the document, so these rounds need no sort; and of the positions only anchors are sorted, about one in 35. README.md has the figures that made it necessary.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; matches never cross documents; rows that share a doc_id but not the text count as documents in the order of their texts' MD5, equal rows as one document (each keeps its row), null doc_ids come first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import repeats
from corpusloom.llm.common import map_batches, materialize, table, texts_of

LENGTH, KEY = 100, 32


def bytes_of(text: bytes) -> tuple:
    return np.frombuffer(text, np.uint8), text, None, None


def scheme(length: int = LENGTH, key: int = KEY) -> repeats.Scheme:
    if not 8 <= key <= length or key & (key - 1):
        raise ValueError("key must be a power of two from 8 to length")
    return repeats.Scheme(bytes_of, length, key, True)


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, spans (array of start, end: the maximal removed runs of bytes) and kept (binary)."""
    s = scheme(length, key)
    known, renumbered = repeats.with_row_ids(docs)
    texts = known.select("doc", "text")
    rows = materialize(repeats.settle(repeats.runs_of(texts, s), s).select("doc", "first", "last", "kind"))
    ranges = repeats.repeated_ranges(rows, texts, s)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], []]
        for t, r in zip(texts_of(b.column(1)), b.column(2).to_pylist(), strict=True):
            gone = repeats.covered(len(t), r or [], length)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).tolist()
            kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if edges else t
            for c, x in zip(cols, (len(t), len(t) - len(kept), [{"start": i, "end": j} for i, j in zip(edges[::2], edges[1::2], strict=True)], kept), strict=True):
                c.append(x)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return map_batches(repeats.with_ranges(known, renumbered, ranges), f, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 1 over all documents."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.selectExpr("doc_id", "n_bytes", "n_removed", "cast(size(spans) as long) n_spans", "sha2(kept, 256) kept_sha256")
