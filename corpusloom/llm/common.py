"""What the operators of this subpackage share: tables, batches, words, materialised steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.steps import shared_dir  # noqa: F401
from corpusloom.steps import written as materialize  # noqa: F401

#: Arrow batches end at so many bytes or rows, so that a run of very long texts can't fill a worker.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4000

#: A word of contracts 3, 4 and 7, as a Java or Python pattern (bytes.split() cuts at the same six characters).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes and rows of the Arrow batches that Python workers get. Spark reads these settings when a plan runs, so they stay; those that the session has already are its user's and aren't touched."""
    known = spark.conf.getAll
    for name, value in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        if (key := f"spark.sql.execution.arrow.{name}") not in known:
            spark.conf.set(key, str(value))


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``df`` with each Arrow batch replaced by ``f`` of it."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives empty bytes."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def word_count(text: str = "text"):
    """Number of words of a text column, a native expression; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def crc_fold(column: str, k: int):
    """crc32(column as text) mod ``k``; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(k))


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of ``counts``, in one array."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def columns_ddl(df: DataFrame) -> str:
    """The columns of ``df`` as a schema text."""
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def sample_by(df: DataFrame, key: str, n: int, most: int = 60_000) -> DataFrame:
    """At most ``n`` different rows (``key``, text) for each value of ``key``, and about ``most`` in all: with many values fewer of each, at least one; of more than ``most`` values those with the most texts. The rows are those whose text has the lowest hash. Equal texts count once, a null key not at all. Each task first leaves out what is surely above, so that about 1.5 times the rows that are kept are ordered."""
    order = F.pmod(F.xxhash64("text"), F.lit(1 << 31))
    totals = materialize(df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.approx_count_distinct(order, 0.02).alias("_of")))
    n = min(n, max(1, most // max(totals.count(), 1)))
    least = F.lit(1 << 31) * F.least(F.lit(1.0), F.lit(1.5 * n) / F.greatest("_of", F.lit(1)))
    values = F.broadcast(totals.orderBy(F.desc("_of"), key).limit(most).select(key, least.alias("_least")))  # ``most`` values of a key
    few = df.join(values, key).filter(order < F.col("_least")).select(key, "text", order.alias("_order")).distinct()
    return few.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_order", "text"))).filter(F.col("_n") <= n).select(key, "text")


def bounded_sample(df: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows of ``df``, those of the lowest hash. Each task first leaves out what is surely above, so that about 1.5 * n rows in all are ordered, on however many tasks."""
    order = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 31))
    total = df.count()
    few = df.filter(order < int((1 << 31) * 1.5 * n / total)) if total > 1.5 * n else df
    return few.orderBy(order, *df.columns).limit(n)
