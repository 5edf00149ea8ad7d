"""Substring dedup against a log-structured fingerprint index: words covered by a window of ``length`` words that also starts in an earlier document are removed.

The index knows the fingerprints of all windows of the documents seen so far: for each run of windows with one anchor (``repeats``) its name, digest and place. It is a log of immutable tables in a folder: Parquet, bucketed and sorted by name, so that a batch of new documents is dealt by name once and merge-joined with every table without any table moving. One row stands for a name: its only run, or the mark that it has several.

For each name of a batch there are three cases. The index doesn't know it: its run is remembered. The index has the same run, by name and digest of the words themselves: the batch's is a repeat. Else the runs with that name are *open*, in the batch and in the index, and are verified window by window, each window by a name and a digest of its words; open runs are remembered by name, too, so that a later batch is held against them.

Tables have levels: a batch becomes one of level 0, and when a level has more than ``fanout`` tables they are merged into one of the next by a full outer join of buckets. A manifest lists the live tables of each generation; it is written last, so that an index whose batch was lost is what it was before, and a later session opens it by its folder.

Batches must come in the order of doc_id, since only smaller doc_ids count.

Defined results: a null text has no words; texts of fewer words lose nothing; a window that repeats within its own document only is kept; rows that share a doc_id but not the text count as documents in the order of their texts' MD5, equal rows as one document (each keeps its row), null doc_ids come first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import repeats
from corpusloom.llm.common import map_batches, materialize, shared_dir, table, texts_of

LENGTH, KEY, BATCHES, FANOUT = 50, 16, 3, 1
_MANIFEST = "generation long, role string, level int, path string, buckets int, length int, anchor int, last long"
#: A table's rows: a name with its run, or several; head: the row stands for its name; the others tell what the batch met. Open runs need no more than their place.
_HEADS = "name long, several boolean, digest long, doc long, first long, last long, kind int, head boolean, repeats boolean, opens boolean, opens_old boolean, old_doc long, old_first long, old_last long, old_kind int"
_OPEN = "name long, doc long, first long, last long, kind int"
_RUN = ["digest", "doc", "first", "last", "kind"]


def words_of(text: bytes) -> tuple:
    """A 64-bit hash of each word, and the words joined by one space."""
    words, h = text.split(), xxhash.xxh3_64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return np.array([h(w) for w in words], np.uint64), b" ".join(words), ends - sizes, ends


def scheme(length: int = LENGTH, key: int = KEY) -> repeats.Scheme:
    if not 2 <= key <= length or key & (key - 1):
        raise ValueError("key must be a power of two from 2 to length")
    return repeats.Scheme(words_of, length, key, False)


class FingerprintIndex:
    """The index in the folder ``path``: opened if it is there, else new. ``buckets``: of each table, by default the session's shuffle partitions; an index keeps its own."""

    def __init__(self, spark: SparkSession, path: str, length: int = LENGTH, key: int = KEY, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.scheme, self.generation, self.last = scheme(length, key), 0, None
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: Live tables by role (heads, open): (level, path, rows).
        self.tables: dict[str, list[tuple[int, str, DataFrame]]] = {"heads": [], "open": []}
        try:
            rows = spark.read.schema(_MANIFEST).json(f"{self.path}/manifest").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        if rows:
            self.generation = max(r.generation for r in rows)
            live = [r for r in rows if r.generation == self.generation]
            if (live[0].length, live[0].anchor) != (length, key):
                raise ValueError(f"the index has windows of {live[0].length} words and anchors of {live[0].anchor}")
            self.buckets, self.last = live[0].buckets, live[0].last
            for r in sorted((r for r in live if r.role in self.tables), key=lambda r: (-r.level, r.path)):
                self.tables[r.role].append((r.level, r.path, self._opened(r.path, _HEADS if r.role == "heads" else _OPEN)))

    def _opened(self, path: str, schema: str) -> DataFrame:
        """A bucketed table's rows. The session's catalog knows it only until its plan is made."""
        name = f"corpusloom_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (name) SORTED BY (name) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self._taken(name)

    def _taken(self, name: str) -> DataFrame:
        df = self.spark.table(name)
        df.schema  # resolved now
        self.spark.sql(f"DROP TABLE {name}")
        return df

    def _write(self, role: str, level: int, df: DataFrame) -> DataFrame:
        """Writes ``df``, dealt by name, as a new table."""
        name = f"corpusloom_{uuid.uuid4().hex}"
        path = f"{self.path}/{name}"
        df.write.format("parquet").bucketBy(self.buckets, "name").sortBy("name").option("path", path).saveAsTable(name)
        rows = self._taken(name)
        self.tables[role].append((level, path, rows))
        return rows

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.buckets, "name")

    def _heads(self) -> list[DataFrame]:
        return [t.filter("head") for _, _, t in self.tables["heads"]]

    def compact(self) -> None:
        """Merges the tables of each level that has more than ``fanout``."""
        for role, live in self.tables.items():
            level = 0
            while any(x[0] >= level for x in live):
                own = [x for x in live if x[0] == level]
                if len(own) > self.fanout:
                    live[:] = [x for x in live if x[0] != level]
                    if role == "open":
                        merged = self._dealt(reduce(DataFrame.union, [t for *_, t in own]))
                    else:
                        merged = reduce(self._merged, [t.filter("head").select("name", "several", *_RUN) for *_, t in own])
                        merged = merged.select("*", F.lit(True).alias("head"), *[F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in _HEADS.split(", ")[8:])])
                    self._write(role, level + 1, merged)
                level += 1

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Heads of two tables: a name that has several runs in either has several; its run, if it has one, stands in one of them only."""
        two = b.select("name", *[F.col(c).alias(f"b_{c}") for c in ("several", *_RUN)])
        several = F.coalesce("several", F.lit(False)) | F.coalesce("b_several", F.lit(False))
        return a.join(two, "name", "full").select("name", several.alias("several"), *[F.coalesce(c, f"b_{c}").alias(c) for c in _RUN])

    def add(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Takes a batch of ``docs`` (doc, text), all with a doc above those of all batches before. Returns rows (doc, first, last, kind): REPEAT ranges of the batch, and SPLIT runs, of it and of earlier documents, that must be told apart."""
        code = "(kind & 3)"
        inner = materialize(repeats.settle(repeats.runs_of(docs, self.scheme), self.scheme, remember=True))
        run = F.expr(f"{code} = {repeats.RUN}")
        of_name = Window.partitionBy("name")
        digest = F.when(run, F.col("digest"))
        own = self._dealt(inner.filter(f"{code} < {repeats.REPEAT}")).withColumns({
            # a document may have one run at several places: that is one run
            "several": F.coalesce(F.min(digest).over(of_name) < F.max(digest).over(of_name), F.lit(False)) | F.max(~run).over(of_name),
            "one": F.row_number().over(of_name.orderBy(~run, "digest", "doc", "first")) == 1,
        })
        heads = self._heads()
        for k, t in enumerate(heads):
            own = own.join(t.select("name", F.col("several").alias(f"s{k}"), F.struct(*_RUN).alias(f"r{k}")), "name", "left")
        none = F.lit(None).cast("struct<digest:long,doc:long,first:long,last:long,kind:int>")
        known = reduce(lambda a, b: a | b, [F.col(f"s{k}").isNotNull() for k in range(len(heads))], F.lit(False))
        old_several = reduce(lambda a, b: a | b, [F.coalesce(f"s{k}", F.lit(False)) for k in range(len(heads))], F.lit(False))
        old = F.coalesce(none, *[F.when(~F.col(f"s{k}"), F.col(f"r{k}")) for k in range(len(heads))])
        met = own.withColumns({"run": run, "known": known, "old_several": old_several, "old": old})
        met = met.withColumn("same", F.col("known") & ~F.col("old_several") & ~F.col("several") & (F.col("digest") == F.col("old.digest")))
        first_clash = F.col("one") & F.col("known") & ~F.col("same") & ~F.col("old_several")
        met = met.select(
            "name", (F.col("several") | F.col("known")).alias("several"), *_RUN, ((F.col("one") & ~F.col("known")) | first_clash).alias("head"),
            (F.col("run") & F.col("same")).alias("repeats"), (F.col("run") & F.col("known") & ~F.col("same") & ~F.col("several")).alias("opens"), first_clash.alias("opens_old"), *[F.col(f"old.{c}").alias(f"old_{c}") for c in _RUN[1:]],
        )
        met = self._write("heads", 0, met)
        place = ["doc", "first", "last"]
        repeated = inner.filter(f"{code} = {repeats.REPEAT}").select(*place, "kind").union(met.filter("repeats").select(*place, F.lit(repeats.REPEAT)))
        split = F.expr(f"kind | {repeats.SPLIT}").alias("kind")
        fresh = inner.filter(f"{code} = {repeats.SPLIT}").select(F.col("digest").alias("name"), *place, "kind").union(met.filter("opens").select("name", *place, split))
        first = met.filter("opens_old").select("name", *[F.col(f"old_{c}").alias(c) for c in place], F.expr(f"old_kind | {repeats.SPLIT}").alias("kind"))
        history = [t for _, _, t in self.tables["open"]]
        opened = self._write("open", 0, self._dealt(fresh.union(first)))
        wanted = opened.select("name").distinct()
        contested = reduce(DataFrame.union, [opened, *[t.join(wanted, "name", "left_semi") for t in history]])
        top = docs.agg(F.max("doc")).first()[0]
        self.generation, self.last = self.generation + 1, max((x for x in (self.last, top) if x is not None), default=None)
        self.compact()
        rows = [(self.generation, role, level, path, self.buckets, self.scheme.length, self.scheme.key, self.last) for role, live in self.tables.items() for level, path, _ in live]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return repeated, contested.select(*place, "kind")

    def update(self, docs: DataFrame, texts: DataFrame) -> DataFrame:
        """Adds a batch of ``docs`` (doc, text) and returns (doc, ranges) of it. ``texts``: (doc, text) of all documents, the batch's and earlier ones, of which only those with open runs are read closely."""
        after = self.last
        rows = reduce(DataFrame.union, self.add(docs))
        ranges = repeats.repeated_ranges(rows, texts, self.scheme)
        return ranges if after is None else ranges.filter(F.col("doc") > after)


def find_repeats(docs: DataFrame, s: repeats.Scheme, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc, ranges) of ``docs`` (doc, text): all batches added to a new index in the order of doc, and what they leave open verified together."""
    bounds = docs.approxQuantile("doc", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    bounds = sorted({int(b) for b in bounds})
    index = FingerprintIndex(docs.sparkSession, shared_dir(docs.sparkSession), s.length, s.key, fanout)
    found = []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = docs if low is None else docs.filter(F.col("doc") > low)
        found.append(index.add(part if high is None else part.filter(F.col("doc") <= high))[0])
    left = [t.select("doc", "first", "last", "kind") for _, _, t in index.tables["open"]]
    return repeats.repeated_ranges(reduce(DataFrame.union, found + left), docs, s)


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: int = KEY, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, spans (array of start, end: the maximal removed runs of words) and kept (the other words, joined by one space)."""
    known, renumbered = repeats.with_row_ids(docs)
    ranges = find_repeats(known.select("doc", "text"), scheme(length, key), batches, fanout)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], []]
        for t, r in zip(texts_of(b.column(1)), b.column(2).to_pylist(), strict=True):
            words = t.split()
            gone = repeats.covered(len(words), r or [], length)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).tolist()
            spans = list(zip(edges[::2], edges[1::2], strict=True))
            kept, at = [], 0
            for i, j in [*spans, (len(words), 0)]:
                kept += words[at:i]
                at = j
            for c, x in zip(cols, (len(words), len(words) - len(kept), [{"start": i, "end": j} for i, j in spans], b" ".join(kept)), strict=True):
                c.append(x)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), *made[:3], made[3].cast(pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    return map_batches(repeats.with_ranges(known, renumbered, ranges), f, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 3 over all documents."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.selectExpr("doc_id", "n_words", "n_removed", "cast(size(spans) as long) n_spans", "sha2(kept, 256) kept_sha256")
