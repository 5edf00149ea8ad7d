"""Relational operators that the queries share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A dimension is broadcast only while its file statistics say that it is no larger; beyond, Spark joins by shuffle.
BROADCAST_BYTES = 32 << 20
SPREAD_BYTES = 8 << 20


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its estimated size is below ``BROADCAST_BYTES``."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Narrow rows dealt by ``by`` before dear work on each: a small file of few row groups is read by as few tasks, however many cores there are. As many parts as three times the cores, or one for each ``SPREAD_BYTES`` of the estimated size."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(3 * df.sparkSession.sparkContext.defaultParallelism, min(4096, size // SPREAD_BYTES)), *by)


def first_of(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def optional_equal(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal each of the values given; None, 0 and the empty text are no filter."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == F.lit(kv[1])), [kv for kv in wanted.items() if kv[1]], df)


def scan_status(status: Column, sections: Column) -> Column:
    """Of a book, from its latest source's status and its sections; the order of the cases matters."""
    return (
        F.when((status.isNull() | (status == "pending")) & (sections == 0), "not_scanned")
        .when(status.isin("crawling", "error"), status)
        .when(sections > 0, "indexed")
        .otherwise(F.coalesce(status, F.lit("not_scanned")))
    )


def percent(done: Column, total: Column) -> Column:
    """Whole percents, cut off; null where total is 0 or null."""
    return F.when(total > 0, F.floor(done * 100 / total).cast("int"))
