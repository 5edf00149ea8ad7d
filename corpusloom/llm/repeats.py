"""Repeated substrings of documents, exactly and without a row for each position: what suffix-array dedup (bytes) and the fingerprint index (words) have in common.

A document is an array of symbols. A *window* is ``length`` consecutive symbols. The rank of a position at length L is a 64-bit name of the L symbols from there; names double as in prefix doubling, name(i, 2L) = mix(name(i, L), name(i + L, L)), up to ``key`` symbols. The least of the names at length ``key`` within a window is its *anchor*: equal windows have equal anchors at equal offsets, so a window whose anchor is unique is unique, and all consecutive windows with one anchor travel as one row, a *run*. That is what keeps the sort small: about 2 / (length - key + 2) rows for each position, and rows of unique names drop out at once.

1. ``runs_of``: rows (name of the anchor, digest of the whole run, document, first and last window). Within an Arrow batch equal runs are folded: all but the earliest are known to repeat and don't travel. A batch that meets several different runs with one anchor sends one mark instead of them. So no name has more rows than there are batches, however often it occurs.
2. ``settle``: Spark sorts the rows by name, digest and position. A run whose name has no other row is unique. Among equal runs all but the earliest repeat. Where one name has several different runs, they go on to round 3.
3. ``pieces_of``: those runs are cut into pieces of 8 windows by their distance from the anchor, and a piece is named by the symbols that all its windows share (two names of doubled length that overlap); ``settle`` again, so that unique names drop out and equal pieces are settled at once. Pieces that still differ are cut into single windows, named at their full length, and settled. Names and digests (of the symbols' own bytes) are independent, so two windows are taken for equal by 128 bits.

What comes out are ranges of windows (document, first, last) that repeat an earlier one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, materialize, ragged, texts_of

RUN, MARK, REPEAT, SPLIT = 0, 1, 2, 3
PIECES = (8, 1)
ROWS = "name long, digest long, doc long, first long, last long, kind int"
_FIELDS = ["name", "digest", "doc", "first", "last", "kind"]
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


@dataclass(frozen=True)
class Scheme:
    """What is compared. symbols: from a text's bytes to its symbols, and, where a symbol is not just a byte of the text, the bytes that digests read and where in them each symbol begins and ends; length of a window and of an anchor; whether an earlier window of the same document counts."""

    symbols: Callable[[bytes], tuple[np.ndarray, bytes, np.ndarray | None, np.ndarray | None]]
    length: int
    key: int
    within: bool


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name for each pair of names."""
    x = a * _A + b
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    x *= _C
    return x


def names_at(symbols: np.ndarray, length: int) -> np.ndarray:
    """Names of all substrings of ``length`` (a power of two) symbols."""
    x, n = symbols, 1
    while n < length:
        if x.dtype != np.uint64:  # still narrow enough to be a name that is the substring itself
            wide = {1: np.uint16, 2: np.uint32, 4: np.uint64}[x.dtype.itemsize]
            x = x[:-n].astype(wide) | (x[n:].astype(wide) << wide(8 * x.dtype.itemsize))
        else:
            x = mix(x[:-n], x[n:])
        n *= 2
    return x


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = 1
    while n < width:
        step = min(n, width - n)
        x = np.minimum(x[:-step], x[step:])
        n += step
    return x


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a sorted table's key differs from the row before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _earliest(new: np.ndarray, doc: np.ndarray, within: bool) -> np.ndarray:
    """Of rows sorted by key, document and position, with ``new`` where a key begins: which don't repeat an earlier one."""
    return new if within else doc == doc[np.flatnonzero(new)][np.cumsum(new) - 1]


class _Batch:
    """All symbols of some texts in one array, for each text its offset and its number of windows, and digests of the symbols' own bytes."""

    def __init__(self, scheme: Scheme, texts: list[bytes]):
        parts = [scheme.symbols(t) for t in texts]
        sizes = np.array([len(p[0]) for p in parts], np.int64)
        self.symbols, self.offsets = np.concatenate([p[0] for p in parts]), np.cumsum(sizes) - sizes
        self.windows = np.maximum(sizes - scheme.length + 1, 0)
        self.raw, self.begin, self.end = b"".join([p[1] for p in parts]), None, None
        if parts and parts[0][2] is not None:
            widths = np.array([len(p[1]) for p in parts], np.int64)
            shift = np.repeat(np.cumsum(widths) - widths, sizes)
            self.begin, self.end = (np.concatenate([p[k] for p in parts]) + shift for k in (2, 3))

    def digests(self, first: np.ndarray, last: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """A 64-bit digest of the bytes of symbols ``first`` to ``last``, each with its seed."""
        a, b = (first, last + 1) if self.begin is None else (self.begin[first], self.end[last])
        raw, hash_ = memoryview(self.raw), xxhash.xxh3_64_intdigest
        return np.array([hash_(raw[i:j], k) for i, j, k in zip(a.tolist(), b.tolist(), seed.tolist(), strict=True)], np.uint64)


def _rows(name, digest, doc, first, last, kind) -> pa.RecordBatch:
    as_long = lambda x: pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64, copy=False))
    return pa.RecordBatch.from_arrays([*map(as_long, (name, digest, doc, first, last)), pa.array(kind.astype(np.int32, copy=False))], _FIELDS)


def _joined(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple:
    """Ranges sorted by document and position, those that touch made one."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] > last[:-1] + 1)
    at = np.flatnonzero(new)
    return doc[at], first[at], np.maximum.reduceat(last, at) if len(at) else last


def _fold(name, digest, doc, first, last, offset, within: bool) -> pa.RecordBatch:
    """The rows that a batch sends on for its runs. ``offset``: of the anchor from the first window; it travels above the two lowest bits of kind."""
    order = np.lexsort((first, doc, digest, name))
    name, digest, doc, first, last, offset = (x[order] for x in (name, digest, doc, first, last, offset))
    by_name, by_run = _changes(name), _changes(name, digest)
    kept = _earliest(by_run, doc, within)
    at = np.flatnonzero(by_name)
    several = np.add.reduceat(by_run.astype(np.int64), at) > 1
    split = kept & several[np.cumsum(by_name) - 1]
    one, marks = kept & ~split, at[several]
    gone = _joined(doc[~kept], first[~kept], last[~kept])
    # what is settled needs no company of its name: it is spread over all tasks
    spread = lambda d, x: mix(d.astype(np.uint64), x.astype(np.uint64))
    none = lambda n: np.zeros(n, np.int64)
    parts = [
        (name[one], digest[one], doc[one], first[one], last[one], RUN | offset[one] << 2),
        (name[marks], *[none(len(marks))] * 4, np.full(len(marks), MARK)),
        (spread(gone[0], gone[1]), none(len(gone[0])), *gone, np.full(len(gone[0]), REPEAT)),
        (spread(doc[split], first[split]), name[split], doc[split], first[split], last[split], SPLIT | offset[split] << 2),
    ]
    return _rows(*(np.concatenate([x.view(np.int64) if x.dtype == np.uint64 else x for x in column]) for column in zip(*parts, strict=True)))


def runs_of(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Rows (``ROWS``) of ``docs`` (doc, text), folded within batches. REPEAT rows are ranges already known to repeat; SPLIT rows runs whose windows must be told apart; these have their name as digest."""
    width = scheme.length - scheme.key + 1

    def f(b: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = b.column(0).to_numpy()
        batch = _Batch(scheme, texts_of(b.column(1)))
        s, offsets, counts = batch.symbols, batch.offsets, batch.windows
        if not counts.any():
            return None
        names = names_at(s, scheme.key)
        keyed = mix(names, names) >> np.uint64(32) << np.uint64(32) | np.arange(len(names), dtype=np.uint64)
        starts = np.repeat(offsets, counts) + ragged(counts)
        anchors = (_least(keyed, width)[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        begin = np.flatnonzero(_changes(anchors, np.repeat(np.arange(len(ids)), counts)))
        first, last, anchor = starts[begin], starts[np.append(begin[1:], len(starts)) - 1], anchors[begin]
        row = np.searchsorted(offsets, first, "right") - 1
        # texts without symbols share an offset with the next one
        digest = batch.digests(first, last + scheme.length - 1, anchor - first)
        return _fold(names[anchor], digest, ids[row], first - offsets[row], last - offsets[row], anchor - first, scheme.within)

    return map_batches(docs, f, ROWS)


def settle(rows: DataFrame, scheme: Scheme, remember: bool = False) -> DataFrame:
    """Of ``ROWS`` those with kind REPEAT, ranges of windows that repeat an earlier one, and SPLIT, runs to be told apart; with ``remember`` also what later rows must be held against: RUN rows of the earliest runs, and marks of marked names.

    Each task reads its rows in the order of name, digest and position, batch by batch. Of the name that a batch ends with, it keeps only what the next one needs: the earliest rows of the one digest met so far, or, once there are several, the last digest and its first document. So a name may have any number of rows.
    """

    def step(state: list[np.ndarray] | None, batch: list[np.ndarray], last_batch: bool):
        """``state``: columns as a batch's, and a sixth that is True for rows that only stand for what was told before."""
        n = len(batch[0])
        columns = [*batch, np.zeros(n, bool)]
        if state is not None:
            columns = [np.concatenate(x) for x in zip(state, columns, strict=True)]
        name, digest, doc, first, last, kind, told = columns
        code = kind & 3
        by_name, at = _changes(name), np.flatnonzero(code == RUN)
        group = np.cumsum(by_name) - 1
        new, kept = np.zeros(len(name), bool), np.zeros(len(name), bool)
        new[at] = _changes(name[at], digest[at])
        kept[at] = _earliest(new[at], doc[at], scheme.within)
        starts = np.flatnonzero(by_name)
        marked = np.logical_or.reduceat(code == MARK, starts)
        several = (np.add.reduceat(new.astype(np.int64), starts) > 1) | marked
        split = kept & several[group]
        pending = np.zeros(len(name), bool) if last_batch else kept & ~split & (group == group[-1])
        out = np.where(code >= REPEAT, kind, np.where(split, kind | SPLIT, np.where((code == RUN) & ~kept, REPEAT, -1)))
        parts = [[x[(out >= 0) & ~told] for x in (name, np.where(split, name, digest), doc, first, last, out)]]
        if remember:
            fresh = kept & ~told & ~pending
            marks = np.flatnonzero((code == MARK) & ~told)
            marks = marks[_changes(name[marks])]
            parts += [[x[fresh] for x in (name, digest, doc, first, last, kind)], [x[marks] for x in (name, digest, doc, first, last, kind)]]
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if several[-1]:
            # a mark, and the first row of the last digest, both told
            head = at[new[at]][-1:]
            head = head[group[head] == group[-1]]
            mark = [name[-1:], *[np.zeros(1, np.int64)] * 4, np.array([MARK], kind.dtype)]
            state = [np.concatenate([m, x[head]]) for m, x in zip(mark, (name, digest, doc, first, last, kind), strict=True)]
            state.append(np.ones(len(state[0]), bool))
        else:
            state = [x[pending] for x in columns] if pending.any() else None
        return state, _rows(*joined) if len(joined[0]) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, waiting = None, None
        for b in batches:
            if b.num_rows:
                if waiting is not None:
                    state, out = step(state, waiting, False)
                    if out is not None:
                        yield out
                waiting = [b.column(i).to_numpy() for i in range(len(_FIELDS))]
        if waiting is not None:
            _, out = step(state, waiting, True)
            if out is not None:
                yield out

    return rows.repartition("name").sortWithinPartitions("name", "digest", "doc", "first").mapInArrow(run, ROWS)


def pieces_of(split: DataFrame, docs: DataFrame, scheme: Scheme, size: int) -> DataFrame:
    """``ROWS`` of the SPLIT runs ``split`` of ``docs`` (doc, text), cut into pieces of ``size`` windows by their place from the anchor, and folded within batches.

    A piece's name is that of the symbols that all windows of its place have in common; with a size of 1 that is the window itself.
    """
    wanted = split.groupBy("doc").agg(F.collect_list(F.struct("first", "last", F.shiftright("kind", 2).cast("long").alias("offset"))).alias("runs"))
    core = scheme.length - size + 1
    half = 1 << (core - 1).bit_length() - 1

    def f(b: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = b.column(0).to_numpy()
        batch = _Batch(scheme, texts_of(b.column(1)))
        s, offsets = batch.symbols, batch.offsets
        runs = b.column(2)
        flat = runs.flatten()
        lo, hi, off = (flat.field(k).to_numpy() for k in ("first", "last", "offset"))
        lo, hi = (x + np.repeat(offsets, np.diff(runs.offsets.to_numpy())) for x in (lo, hi))
        row = np.repeat(np.arange(len(ids)), np.diff(runs.offsets.to_numpy()))
        each = hi - lo + 1
        run = np.repeat(np.arange(len(lo)), each)
        starts = lo[run] + ragged(each)
        anchor = (lo + off)[run]
        place = (anchor - starts) // size
        begin = np.flatnonzero(_changes(run, place))
        first, last = starts[begin], starts[np.append(begin[1:], len(starts)) - 1]
        anchor, place, row = anchor[begin], place[begin], row[run[begin]]
        names = names_at(s, half)
        at = anchor - place * size
        name = mix(mix(names[at], names[at + core - half]), place.astype(np.uint64))
        digest = batch.digests(first, last + scheme.length - 1, anchor - first)
        return _fold(name, digest, ids[row], first - offsets[row], last - offsets[row], anchor - first, scheme.within)

    # sorted, so that a task that runs again folds the same batches, whatever order its rows were fetched in
    return map_batches(docs.join(wanted, "doc").select("doc", "text", "runs").sortWithinPartitions("doc"), f, ROWS)


def with_row_ids(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` (doc_id, text) with doc, a number that orders and tells apart its different rows, and whether doc is not just doc_id.

    Where doc_ids are unique and not null, doc is doc_id. Else rows are numbered by doc_id (null first) and MD5 of the text; equal rows get one number.
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    if not docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count():
        # the filter drops nothing; it stands in inner joins anyway, and with it all joins of the texts share one shuffle
        return docs.withColumn("doc", F.col("doc_id")).filter("doc IS NOT NULL"), False
    sign = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    keys = ["doc_id", "sign", "none"]
    named = docs.withColumns({"sign": sign, "none": F.col("text").isNull()})
    # numbered by ranges: within a range by its own order, after the numbers of the ranges before (one row each)
    ranged = materialize(named.select(keys).distinct().repartitionByRange(*keys).withColumn("range", F.spark_partition_id()))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    starts = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*keys))
    numbered = materialize(ranged.join(starts, "range").select(*keys, (F.col("start") + place).alias("doc")))
    return named.join(numbered, [named.doc_id.eqNullSafe(numbered.doc_id), named.sign == numbered.sign, named.none == numbered.none]).select(named.doc_id, "text", "doc"), True


def repeated_ranges(rows: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(doc, ranges): for each document with any, the ranges of windows that repeat an earlier one. ``rows``: what ``settle`` has returned for its runs, written; ``docs``: (doc, text)."""
    of = lambda rows, kind: rows.filter(f"(kind & 3) = {kind}").select("doc", "first", "last", "kind")
    repeated = of(rows, REPEAT)
    for size in (p for p in PIECES if p <= scheme.length - scheme.key + 1):
        rows = settle(pieces_of(of(rows, SPLIT), docs, scheme, size), scheme)
        repeated = repeated.union(of(rows, REPEAT))
    return repeated.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))


def covered(n: int, ranges: list[dict], length: int) -> np.ndarray:
    """Which of ``n`` symbols lie in a window of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    if ranges:
        np.add.at(edge, [r["first"] for r in ranges], 1)
        np.add.at(edge, [r["last"] + length for r in ranges], -1)
    return np.cumsum(edge[:-1]) > 0


def with_ranges(known: DataFrame, renumbered: bool, ranges: DataFrame) -> DataFrame:
    """(doc_id, text, ranges) for each row of what ``with_row_ids`` has returned. Where doc is doc_id, the texts are those that ``pieces_of`` joins, so that Spark shuffles them once for all."""
    if renumbered:
        return known.join(ranges, "doc", "left").select("doc_id", "text", "ranges")
    return known.select("doc", "text").join(ranges, "doc", "left").select(F.col("doc").alias("doc_id"), "text", "ranges")
