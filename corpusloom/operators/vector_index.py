"""An index of vectors by coarse cells: k-means on a bounded sample, every vector written in the folder of its cell, and searches that read the nearest cells' folders alone.

Vectors are made unit length, so the order by cosine is that by distance. A cell keeps its centre, its number of rows and its radius; by the triangle inequality no row of a cell is nearer than the distance to its centre less the radius, and so the exact mode leaves out just those cells that can't hold one of the k nearest.

The table of cells has at most ``MOST_CELLS`` rows, whatever the number of vectors; only it reaches the driver. A cell that holds very many rows (equal vectors fall into one) is written as several files, and searched in pieces of at most about ``PIECE`` rows.

Defined results: a null vector, or one of length 0, has no cosine and isn't indexed; repeated rows are each indexed; equal scores follow by id; an empty table gives an index without cells and searches without rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.retrieval import nearest

#: Rows of the sample that centres are fitted on, for each cell and in all; the most cells; rows searched as one piece; queries as one block; rows of a piece that meet a block at once.
SAMPLE_PER_CELL, MOST_SAMPLE, MOST_CELLS, PIECE, BLOCK, SLICE = 64, 200_000, 4096, 20_000, 512, 2048
DECIMALS = 6
#: Queries that the number of probed cells is chosen by, their neighbours, and the share of these that must be found.
TRIED, TRIED_K, RECALL = 200, 10, 0.95


@dataclass
class VectorIndex:
    """``rows``: (id, embedding, cell), a folder for each cell; ``cells``: number, centres (one row each), radii and rows of the cells; ``probes``: how many cells a search reads unless it is told."""

    rows: DataFrame
    numbers: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    counts: np.ndarray
    probes: int = 1

    def distances(self, q: np.ndarray) -> np.ndarray:
        """From unit vectors (one row each) to all centres."""
        square = (q * q).sum(1)[:, None] + (self.centres * self.centres).sum(1)[None, :] - 2 * q @ self.centres.T
        return np.sqrt(np.maximum(square, 0))


def _unit(v: str = "embedding"):
    """The vector in double precision, of length 1; null where it has no length."""
    wide = F.transform(v, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size > 0, F.transform(wide, lambda x: x / size))


def build(vectors: DataFrame, path: str, cells: int | None = None, rounds: int = 12, seed: int = 1) -> VectorIndex:
    """Writes the index of ``vectors`` (id, embedding) below ``path``. ``cells``: by default the root of the number of rows. Centres come from rows of the lowest hashes, at most ``SAMPLE_PER_CELL`` for each cell; all rows are indexed."""
    known = vectors.select("id", "embedding", _unit().alias("_unit")).filter("_unit IS NOT NULL")
    n = known.count()
    cells = max(1, min(MOST_CELLS, cells or round(n**0.5), n))
    if not n:
        known.select("id", "embedding", F.lit(0).alias("cell")).write.partitionBy("cell").parquet(f"{path}/rows")
        return open_index(vectors.sparkSession, path, vectors.dtypes)
    share = min(1.0, 1.2 * min(MOST_SAMPLE, SAMPLE_PER_CELL * cells) / n)
    order = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    sample = known.filter(order < int(share * (1 << 30)) + 1).select(array_to_vector("_unit").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=rounds).fit(sample)
    centres = [list(map(float, c)) for c in model.clusterCenters()]
    placed = model.setPredictionCol("cell").transform(known.withColumn("features", array_to_vector("_unit"))).drop("features")
    # as many files for a large cell as its rows need, and few files in all: AQE splits and joins the pieces of this shuffle
    placed.hint("rebalance", "cell").select("id", "embedding", "_unit", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    centre = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in centres]), F.col("cell") + 1) if len(centres) <= 64 else None
    spark = vectors.sparkSession
    table = spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>")
    stored = spark.read.parquet(f"{path}/rows")
    away = stored.withColumn("centre", centre) if centre is not None else stored.join(F.broadcast(table), "cell")  # at most MOST_CELLS rows
    far = F.sqrt(F.aggregate(F.zip_with("_unit", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    radii = away.groupBy("cell").agg(F.max(far).alias("radius"), F.count(F.lit(1)).alias("n"))
    radii.join(F.broadcast(table), "cell").coalesce(1).write.parquet(f"{path}/cells")
    probes = enough_probes(open_index(spark, path, vectors.dtypes))
    spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.parquet(f"{path}/settings")
    return open_index(spark, path, vectors.dtypes)


def enough_probes(index: VectorIndex, k: int = TRIED_K, recall: float = RECALL, queries: int = TRIED) -> int:
    """The least number of cells that gives ``queries`` of the rows, those of the lowest hashes, a share ``recall`` of their ``k`` nearest. One exact search of all rows."""
    asked = index.rows.select(F.col("id").alias("query"), "_unit").orderBy(F.xxhash64("id"), "id").limit(queries)
    at = {r["query"]: r["_unit"] for r in asked.collect()}
    found = search_many(index, asked.withColumnRenamed("_unit", "embedding"), k, exact=True).join(index.rows.select("id", "cell"), "id").select("query", "cell").collect()
    rank = {q: np.argsort(np.argsort(index.distances(np.array([v]))[0], kind="stable")) for q, v in at.items()}
    place = {int(c): i for i, c in enumerate(index.numbers)}
    needed = np.sort([rank[r["query"]][place[r["cell"]]] for r in found])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def open_index(spark: SparkSession, path: str, dtypes: list[tuple[str, str]]) -> VectorIndex:
    """The index below ``path``; ``dtypes``: of the vectors that it was built from."""
    kind = dict(dtypes)
    rows = spark.read.schema(f"id {kind['id']}, embedding {kind['embedding']}, _unit array<double>, cell int").parquet(f"{path}/rows")
    # an index of no rows has no cells
    table = sorted(spark.read.parquet(f"{path}/cells").select("cell", "centre", "radius", "n").collect()) if _there(spark, f"{path}/cells") else []
    probes = spark.read.parquet(f"{path}/settings").first().probes if _there(spark, f"{path}/settings") else 1
    return VectorIndex(rows, np.array([r.cell for r in table], np.int32), np.array([r.centre for r in table]) if table else np.empty((0, 0)), np.array([r.radius for r in table]), np.array([r.n for r in table], np.int64), probes)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def search(index: VectorIndex, q: list[float], k: int, probes: int | None = None) -> DataFrame:
    """(id, score) of the ``k`` nearest in the ``probes`` cells with the nearest centres; more than these while they hold fewer than ``k`` rows. Other cells' folders aren't read."""
    return nearest(index.rows.filter(F.col("cell").isin(_nearest_cells(index, q, k, probes))), q, k)


def search_exact(index: VectorIndex, q: list[float], k: int, probes: int | None = None) -> DataFrame:
    """(id, score) of the ``k`` nearest of all: those of the nearest cells tell how far the k-th is at most, and cells that begin farther away aren't read."""
    first = _nearest_cells(index, q, k, probes)
    if not first:
        return nearest(index.rows.limit(0), q, k)
    found = [r.score for r in nearest(index.rows.filter(F.col("cell").isin(first)), q, k).collect()]
    # scores are rounded: a row that rounds to the k-th score may still come first by its id
    bound = np.sqrt(max(0.0, 2 - 2 * (found[-1] - 10.0**-DECIMALS))) + 1e-9 if len(found) >= k else np.inf
    least = index.distances(_as_unit(q))[0] - index.radii
    return nearest(index.rows.filter(F.col("cell").isin([int(c) for c in index.numbers[least <= bound]])), q, k)


def _as_unit(q: list[float]) -> np.ndarray:
    v = np.array([q], float)
    return v / max(np.linalg.norm(v), 1e-300)


def _nearest_cells(index: VectorIndex, q: list[float], k: int, probes: int | None) -> list[int]:
    if not len(index.numbers):
        return []
    order = np.argsort(index.distances(_as_unit(q))[0], kind="stable")
    enough = int(np.searchsorted(np.cumsum(index.counts[order]), k)) + 1
    return [int(c) for c in index.numbers[order[: max(probes or index.probes, enough)]]]


def search_many(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query, id, score, place) of the ``k`` nearest to each of ``queries`` (query, embedding), over its ``probes`` nearest cells or, if ``exact``, over all rows.

    A cell's rows are dealt into pieces, its queries into blocks; every block meets every piece of its cell as two matrices, from which each query's ``k`` best go on. So neither a large cell nor many equal queries make a large group.
    """
    spark, numbers, counts = queries.sparkSession, index.numbers, index.counts
    asked = queries.select("query", _unit().alias("_q")).filter("_q IS NOT NULL")
    if exact:
        # cells don't matter: pieces of all rows
        pieces = max(1, -(-int(counts.sum()) // PIECE))
        at = asked.select("query", "_q", F.lit(0).alias("cell"), F.lit(pieces).alias("_pieces"))
        rows = index.rows.select("id", "_unit", F.lit(0).alias("cell"), F.pmod(F.xxhash64("id"), F.lit(pieces)).cast("int").alias("piece"))
    else:
        probes = probes or index.probes
        shared = spark.sparkContext.broadcast(index.centres)  # at most MOST_CELLS rows
        split = np.maximum(1, -(-counts // PIECE))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for b in (whole.slice(i, BLOCK) for whole in batches for i in range(0, whole.num_rows, BLOCK)):
                if len(c):
                    q = np.stack(b.column(1).to_numpy(zero_copy_only=False))
                    best = np.argsort((c * c).sum(1)[None, :] - 2 * q @ c.T, axis=1, kind="stable")[:, :probes]
                    row = np.repeat(np.arange(len(q)), best.shape[1])
                    yield pa.record_batch([*b.take(pa.array(row)).columns, pa.array(numbers[best.ravel()]), pa.array(split[best.ravel()].astype(np.int32))], names=["query", "_q", "cell", "_pieces"])

        at = asked.mapInArrow(near, f"query {dict(queries.dtypes)['query']}, _q array<double>, cell int, _pieces int")
        by_cell = spark.createDataFrame([(int(c), int(s)) for c, s in zip(numbers, split, strict=True)], "cell int, _pieces int")
        rows = index.rows.join(F.broadcast(by_cell), "cell").select("id", "_unit", "cell", F.pmod(F.xxhash64("id"), "_pieces").cast("int").alias("piece"))
    # queries in blocks of about BLOCK by hash; a cell is asked by as many blocks as it has queries for
    blocks = at.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    left = at.join(blocks, "cell").select("query", "_q", "cell", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("piece"), F.pmod(F.xxhash64("query"), "_blocks").cast("int").alias("block"))
    right = rows.join(blocks, "cell").select("id", "_unit", "cell", "piece", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _NOTHING(left, right)
        query, q = left.column("query"), _matrix(left.column("_q"))
        scores, places = np.empty((len(q), 0)), np.empty((len(q), 0), np.int64)  # rows of right
        order = np.argsort(right.column("id").to_numpy(), kind="stable")
        for at in range(0, len(order), SLICE):
            # of equal scores those that come first by id stay first
            part = order[at : at + SLICE]
            scores = np.hstack([scores, np.round(q @ _matrix(right.column("_unit").take(pa.array(part))).T, DECIMALS)])
            places = np.hstack([places, np.broadcast_to(part, (len(q), len(part)))])
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            scores, places = (np.take_along_axis(x, best, 1) for x in (scores, places))
        ids, row = right.column("id"), np.repeat(np.arange(len(q)), scores.shape[1])
        return pa.table({"query": query.take(pa.array(row)), "id": ids.take(pa.array(places.ravel())), "score": pa.array(scores.ravel())})

    kinds = f"query {dict(queries.dtypes)['query']}, id {dict(index.rows.dtypes)['id']}, score double"
    found = left.groupBy("cell", "piece", "block").cogroup(right.groupBy("cell", "piece", "block")).applyInArrow(meet, kinds)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long vectors as rows, without an object for each."""
    n = len(vectors)
    flat = pa.chunked_array([c.flatten() for c in vectors.chunks]) if isinstance(vectors, pa.ChunkedArray) else vectors.flatten()
    return flat.to_numpy().reshape(n, -1)


def _NOTHING(left: pa.Table, right: pa.Table) -> pa.Table:  # noqa: N802
    return pa.table({"query": left.column("query")[:0], "id": right.column("id")[:0], "score": pa.array([], pa.float64())})
