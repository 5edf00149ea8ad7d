"""Sections by book in a folder, where a batch writes only the parts of the books that it holds.

A book lies in one part, a folder by its hash. A batch reads the parts of its books, stamps their live rows, appends the new versions and puts those parts in place of the old ones (dynamic partition overwrite); the files of all other parts stay. Each row carries the batch that brought it, and a part is replaced as a whole: a batch that broke off half way, run again, takes up only the books that it hasn't brought yet, and run a third time writes nothing. A part may have any number of files and tasks, so that one huge book is not one task.

Defined results: a null book is a book of its own, a null number a section of its own; equal rows of a batch are all kept, with the same version; an empty batch writes nothing; columns of the batch beyond those of the folder are refused by Spark, as are missing ones.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.lifecycle import supersede
from corpusloom.steps import written

#: What the folder adds to a batch's own columns.
OWN = "version long, batch long, superseded_date string, part int"


def part_of(book: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(book), F.lit(parts)).cast("int")


def current(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The rows of the folder, of the batches' ``columns`` (a schema text) and ``OWN``; none where nothing was written."""
    schema = f"{columns}, {OWN}"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def replace_books(path: str, fresh: DataFrame, batch: int, today: str, book: str = "book", number: str = "number", parts: int = 256) -> list[int]:
    """Takes the books of ``fresh`` in as batch ``batch``; ``parts`` must stay what it was. Returns the parts that were written."""
    spark = fresh.sparkSession
    columns = ", ".join(f"`{n}` {t}" for n, t in fresh.dtypes)
    rows = written(fresh.withColumn("part", part_of(book, parts)))
    held = current(spark, path, columns)
    wanted = [r.part for r in rows.select("part").distinct().collect()]  # no more than ``parts``
    there = held.filter(F.col("part").isin(wanted))
    brought = there.filter(F.col("batch") == batch).select(F.col(book).alias("_book"), "part").distinct()
    pending = rows.join(brought, (rows.part == brought.part) & rows[book].eqNullSafe(brought._book), "left_anti")
    touched = sorted(r.part for r in pending.select("part").distinct().collect())
    if not touched:
        return []
    old = there.filter(F.col("part").isin(touched))
    tops = old.groupBy(F.col(book).alias("_book"), F.col(number).alias("_number")).agg(F.max("version").alias("_top"))
    new = pending.join(tops, F.col(book).eqNullSafe(F.col("_book")) & F.col(number).eqNullSafe(F.col("_number")), "left")
    new = new.withColumns({"version": F.coalesce("_top", F.lit(0)).cast("long") + 1, "batch": F.lit(batch).cast("long"), "superseded_date": F.lit(None).cast("string")})
    books = pending.select(F.col(book).alias("_book")).distinct().withColumn("_read", F.lit(True))
    stamped = supersede(old.join(books, F.col(book).eqNullSafe(F.col("_book")), "left"), F.coalesce("_read", F.lit(False)), F.lit(today))
    # written apart first: the folder is read until here
    step = written(stamped.select(held.columns).unionByName(new.select(held.columns)).repartitionByRange("part", book, number))
    step.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return touched
