"""An index of the texts that were taken in before: batches come one after the other, and each row is told from the first of its text, whichever batch that came in.

The index is a folder of immutable Parquet tables (hash, first), bucketed and sorted by hash. A batch is dealt to the same buckets once, and each table is joined bucket by bucket, so that the index itself is never shuffled. What the batch has of its own becomes a table; more than ``fanout`` tables of a level are merged to one of the next. A manifest, written by Spark after the tables, names those that count: a batch that failed half way leaves files that nothing names, and is simply taken in again.

Defined results: rows are ordered by (batch, order); of rows with one hash the first is no duplicate, and of equal orders none precedes the other. A batch whose id was taken in already gives the same answer again and adds nothing, as long as it is the latest; an older one is refused. A null text has no hash and is never a duplicate; the empty text is a text. An empty batch gives no rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.steps import written

_ROWS, _MANIFEST = "hash string, batch long, first long", "batch long, level int, path string, buckets int"


class DuplicateIndex:
    """The index below ``path``, new or as an earlier session left it. ``buckets`` is fixed when it is made: about one for each 100 MB that the index will hold."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, fanout: int = 4):
        self.spark, self.path, self.buckets, self.fanout, self.last = spark, path, buckets, fanout, -1
        self.tables: list[tuple[int, str]] = []
        try:
            rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").collect()  # a few rows a batch
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        if rows:
            self.last = max(r.batch for r in rows)
            live = [r for r in rows if r.batch == self.last]
            self.buckets = live[0].buckets
            self.tables = sorted((r.level, r.path) for r in live if r.path)

    def _open(self, path: str) -> DataFrame:
        """A table's rows with their buckets; the session's catalog knows the name only until the rows are resolved, and the files stay."""
        name = f"corpusloom_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({_ROWS}) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        try:
            df = self.spark.table(name)
            df.schema  # resolved now
        finally:
            self.spark.sql(f"DROP TABLE {name}")
        return df

    def _write(self, rows: DataFrame) -> str:
        name = f"corpusloom_{uuid.uuid4().hex}"
        path = f"{self.path}/{name}"
        rows.select("hash", "batch", "first").write.format("parquet").bucketBy(self.buckets, "hash").sortBy("hash").option("path", path).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return path

    def earlier(self, firsts: DataFrame, before: int) -> DataFrame:
        """``firsts`` (hash, ...) with known: whether a batch below ``before`` has the hash."""
        out = firsts.repartition(self.buckets, "hash").withColumn("known", F.lit(False))
        for _, path in self.tables:
            there = self._open(path).filter(F.col("batch") < before).select("hash", F.lit(True).alias("_there")).hint("merge")
            out = out.join(there, "hash", "left").withColumn("known", F.col("known") | F.col("_there").isNotNull()).drop("_there")
        return out

    def add(self, rows: DataFrame, batch: int, text: str = "text", order: str = "doc_id") -> DataFrame:
        """(``order``, hash, duplicate) of each of ``rows``, after all batches before; the index then holds them too."""
        if batch < self.last:
            raise ValueError(f"batch {batch} comes after batch {self.last}")
        narrow = written(rows.select(F.col(order), F.sha2(text, 256).alias("hash")))
        firsts = narrow.filter("hash IS NOT NULL").groupBy("hash").agg(F.min(order).cast("long").alias("first"))
        told = written(self.earlier(firsts, batch))
        if batch > self.last:
            new = told.filter("NOT known").withColumn("batch", F.lit(batch).cast("long"))
            self.tables.append((0, self._write(new)))
            self._compact()
            self._commit(batch)
        late = F.col("known") | (F.col(order) > F.col("first"))
        return narrow.join(told, "hash", "left").select(order, "hash", F.coalesce(late, F.lit(False)).alias("duplicate"))

    def _compact(self) -> None:
        """Tables hold different hashes, so that a merge is their union, bucket by bucket."""
        level = 0
        while len(own := [p for at, p in self.tables if at == level]) > self.fanout:
            merged = reduce(DataFrame.unionAll, [self._open(p) for p in own])
            self.tables = [x for x in self.tables if x[0] != level] + [(level + 1, self._write(merged.repartition(self.buckets, "hash")))]
            level += 1

    def _commit(self, batch: int) -> None:
        live = [(batch, level, path, self.buckets) for level, path in self.tables]
        self.spark.createDataFrame(live, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self.last = batch
