"""Versions, merges, reviews and progress. Tables are immutable: each operator returns the next snapshot or the rows to append."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The phases of an import, in order.
PHASES = ("queued", "parsing", "indexing", "completed", "failed")


def supersede(sections: DataFrame, which: Column, today: Column, stamp: str = "superseded_date") -> DataFrame:
    """``sections`` with live rows of ``which`` stamped; others as they are."""
    return sections.withColumn(stamp, F.when(which & F.col(stamp).isNull(), today).otherwise(F.col(stamp)))


def upsert(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``current`` with the rows of ``new`` in place of those with the same key, and the rest of ``new``; of several new rows with one key the greatest by its other columns, in their order. A null in a key equals nothing."""
    rest = [c for c in new.columns if c not in key]
    one = new.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(*key, "_r.*") if rest else new.select(key).distinct()
    return current.join(one.select(key), key, "left_anti").unionByName(one.select(new.columns))


def with_new_ids(df: DataFrame, found: str, key: str, taken: DataFrame, id_: str) -> DataFrame:
    """``df`` with source_id, ``found`` where there is one, else a new id: beyond all of ``taken`` (``id_``) by the row's ``key``, a positive number that no other row has. created says which."""
    top = taken.agg(F.coalesce(F.max(id_), F.lit(0)).alias("_top"))
    return df.join(F.broadcast(top)).withColumns({"source_id": F.coalesce(F.col(found), F.col("_top") + 1 + F.col(key)), "created": F.col(found).isNull()}).drop("_top")


def split_new(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``incoming`` with accepted: its key is not among ``known``."""
    there = known.select(F.col(key).alias("_k")).distinct().withColumn("_there", F.lit(True))
    return incoming.join(there, F.col(key) == F.col("_k"), "left").withColumn("accepted", F.col("_there").isNull()).drop("_k", "_there")


def next_versions(sections: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """``sections`` with version: one above the highest of the history."""
    top = history.groupBy(key).agg(F.max("version").alias("_top"))
    return sections.join(top, key, "left").withColumn("version", F.coalesce("_top", F.lit(0)) + 1).drop("_top")


def latest_progress(ticks: DataFrame, job: str, ts: str, *values: str) -> DataFrame:
    """The last tick of each job; partial maxima, so a busy job costs no more."""
    return ticks.groupBy(job).agg(F.max(F.struct(ts, *values)).alias("_t")).select(job, "_t.*")


def review(quarantine: DataFrame, approved: list[int], rejected: list[int], now: Column, key: str = "id") -> DataFrame:
    """Approved rows get a stamp, rejected ones go."""
    return quarantine.filter(~F.col(key).isin(rejected)).withColumn("reviewed_at", F.when(F.col(key).isin(approved), now).otherwise(F.col("reviewed_at")))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with n, from 1 within the first column, in the order of the others: the same on every run."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(order[0]).orderBy(*order[1:])))


def backfill(sections: DataFrame, clean: Column, hash_of: Callable[[Column], Column], every: bool = False) -> DataFrame:
    """The live rows of ``sections`` (full_text, full_text_raw, superseded_date) normalized again: raw text kept, or set from the text where there is none; ``clean`` of ``_raw``, and its hash. Without ``every``, only rows that have no raw text yet."""
    live = sections.filter("superseded_date IS NULL")
    stale = live if every else live.filter("full_text_raw IS NULL")
    fresh = stale.withColumn("_raw", F.coalesce("full_text_raw", "full_text")).withColumns({"full_text_raw": F.col("_raw"), "full_text": clean})
    return fresh.withColumn("normalized_hash", hash_of(F.col("full_text"))).drop("_raw")


def changed_texts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Those rows of ``after`` (id, normalized_hash, ...) whose hash isn't that of the row of ``before`` (id, normalized_hash), or that are new there: what has to be embedded again. Narrow rows of ``before`` meet ``after`` in one join."""
    old = before.select("id", "normalized_hash").distinct()
    return after.join(old.withColumnRenamed("id", "_id").withColumnRenamed("normalized_hash", "_hash"), F.col("id").eqNullSafe(F.col("_id")) & F.col("normalized_hash").eqNullSafe(F.col("_hash")), "left_anti")


def reindex(sections: DataFrame, fresh: DataFrame, key: str, today: Column) -> DataFrame:
    """The next snapshot of ``sections`` when the books (``key``) of ``fresh`` were read again: their live rows stamped, the new rows after them."""
    read = fresh.select(F.col(key).alias("_key")).distinct().withColumn("_read", F.lit(True))
    old = supersede(sections.join(read, F.col(key) == F.col("_key"), "left"), F.coalesce("_read", F.lit(False)), today).select(sections.columns)
    return old.unionByName(fresh.withColumn("superseded_date", F.lit(None).cast(dict(sections.dtypes)["superseded_date"])).select(sections.columns))


# Kinds of sources, and the host whose pages can be read.
FILE_SOURCE, WEB_SOURCE, HOST = "pdf_parse", "web_scrape", "iccsafe.org"


def route(kind: Column, url: Column) -> Column:
    """What becomes of a trigger, by the source's kind and address."""
    return F.when(kind == FILE_SOURCE, "error: upload the file").when((kind == WEB_SOURCE) & F.coalesce(url.contains(HOST), F.lit(False)), "triggered").otherwise("error: unsupported")


def scannable(url: Column) -> Column:
    """Whether an address is there and can be fetched."""
    return F.coalesce((url != "") & url.startswith("http") & ~url.contains("javascript:"), F.lit(False))
