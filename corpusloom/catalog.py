"""The queries of the library by name, and the DuckDB SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The inventory ids that each query covers.
COVERS: dict[str, str] = {}
FLAGSHIP = "catalog_flat"


def query(ids: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Registers a function of (t), where ``t(name)`` gives a table, under its own name. ``ids``: what it covers; ``sql``: its DuckDB SQL."""

    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        COVERS[f.__name__] = ids
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# each module registers its queries
from corpusloom.plans import graph, indexes, lifecycle, references, relational, retrieval, structure, text, validation  # noqa: E402, F401
