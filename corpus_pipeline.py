"""A corpus pipeline over ``documents``: toxicity, near duplicates, benchmark contamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps; the last adds slot and shard. A stage's result is written as Parquet and read again as the next one's docs.

Defined results: a null or empty text gets a toxicity score like any other, and all texts without words are one group of near duplicates, of which one stays; rows that share a doc_id but not the text are judged each by itself, repeated rows together; a null source is a source of its own, a null doc_id is placed as the text ``""``; an empty table gives an empty result; columns beyond those of ``documents`` stay out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, mixing, near_copies, sharding, toxicity
from corpusloom.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on labelled ones, doesn't reject."""
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels"))


def first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates: two bits of SimHash, or five-word shingles of similarity 0.8."""
    return near_copies.drop_near_copies(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows."""
    return decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")).filter("not contaminated").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return mixing.mix_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slot and shard; copies of one go together."""
    return sharding.place(docs)


STAGES = [("toxicity", ordinary), ("simhash near-dedup", first_of_group), ("benchmark decontamination", uncontaminated), ("mixing", mixed), ("sharding", sharded)]
#: Compression distances and XXH64 have no SQL form; the stages are held against brute force in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
