"""Files, tables and token streams as sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stored_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, filename, size_bytes, sha256, modified) of the files below ``path`` (one or several), read by Spark's own reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As ``stored_files``, without reading any content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "path")


def stored_bytes(spark: SparkSession, path: str | list[str], wanted: DataFrame) -> DataFrame:
    """(path, filename, sha256, content) of the files below ``path`` whose hash is among ``wanted`` (sha256)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("sha256"), "content")
    return named.join(wanted.select("sha256").distinct(), "sha256", "left_semi")


def fetch_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, size_bytes, content) of the file that ``list_files`` gives as ``path``; no other one is read."""
    return spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"), "content")


def file_pages(files: DataFrame, open_pages: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page, text) of ``files`` (path, content), by a reader of the caller's that gives the texts of a file's pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, k, t) for p, c in zip(b.path, b.content, strict=True) for k, t in enumerate(open_pages(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return files.select("path", "content").mapInPandas(run, f"path {dict(files.dtypes)['path']}, page int, text string")


def with_embeddings(df: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """``df`` with embedding, batch by batch, by a function of the caller's (a local model or a service)."""
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(embedding=embed([t or "" for t in b[text]]))[[*columns, "embedding"]]

    ddl = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(run, f"{ddl}, embedding array<float>")


def tokens(line: Column) -> Column:
    """The answer's piece in one line of a token stream (JSON); empty where the line is broken or has none."""
    read = F.from_json(line, "response string, done boolean, message struct<content:string>", {"mode": "PERMISSIVE"})
    return F.coalesce(read["response"], read["message"]["content"], F.lit(""))
