"""SimHash near-duplicates, found by hashing balls that meet in the middle, and grouped into components.

Fingerprints within ``radius`` bits (an even number) link exactly where their balls of half that radius share a point. Each distinct fingerprint emits all variants within half the radius (65 for a radius of 2); a group of equal points holds at most as many fingerprints as a ball has points, however many documents share them. For a radius of 2 it is folded into one row, whose mask says which neighbours of the point are fingerprints. All members of a group lie within the radius of one another, so the first is linked to each other one: no pairs of documents, and none within a group, are listed.

Components follow by alternating large-star and small-star rounds over the links of distinct fingerprints. Each round is written to the shared folder; only a count and a checksum reach the driver.

Defined results: a null or empty text has no words and the fingerprint 0, linked like any other; repeated rows stay; a null doc_id never names a component unless it has no other document (then null); an empty table gives an empty result; input columns but doc_id and text are ignored, in ``drop_near_duplicates`` kept. There, of each group the rows of one fingerprint and one doc_id stay, the smallest (null last) and of it the smallest fingerprint; rows that share a doc_id but not the text are documents each by itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import columns_ddl, map_batches, materialize, table, texts_of

SHINGLE, SEED, RADIUS, CHUNK = 3, 42, 2, 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """The 8 bytes, highest first, of a text's SimHash."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    n = max(len(words) - shingle + 1, 1)
    if n == 1:
        return digest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, ends = [0, *ends[: n - 1].tolist()], (ends[shingle - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        h = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[i : i + CHUNK], ends[i : i + CHUNK], strict=True)])
        ones += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every document; fp is the fingerprint as a signed 64-bit number."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.frombuffer(b"".join(fingerprint(t, shingle, seed) for t in texts_of(b.column(1))), ">u8").astype(np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), f, "doc_id long, fp long")


def ball_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: links between the distinct fingerprints ``fps`` (fp) that connect exactly those that chains of at most ``radius`` differing bits connect."""
    if radius < 2 or radius % 2:
        raise ValueError("the radius must be an even number, from 2")
    # a row becomes as many as a ball has points: spread first, over a number of tasks that isn't coalesced
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    return _links_of_one(spread) if radius == 2 else _links_of_more(spread, radius // 2)


def _links_of_one(fps: DataFrame) -> DataFrame:
    """Balls of one bit: a point's members are told by the bits in which they differ from it."""
    flips = F.array(*[F.struct(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long").alias("bit"), F.lit(False).alias("own")) for i in range(64)], F.struct(F.lit(0).cast("long").alias("bit"), F.lit(True).alias("own")))
    variants = fps.select("fp", F.explode(flips).alias("x")).select(F.col("fp").bitwiseXOR(F.col("x.bit")).alias("point"), "x.bit", "x.own")
    met = variants.groupBy("point").agg(F.bit_or("bit").alias("bits"), F.max("own").alias("own")).filter(F.bit_count("bits") + F.col("own").cast("int") > 1)
    bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)), lambda b: F.col("bits").bitwiseAND(b) != 0)
    members = F.array_sort(F.concat(F.transform(bits, lambda b: F.col("point").bitwiseXOR(b)), F.when(F.col("own"), F.array("point")).otherwise(F.expr("array()").cast("array<long>"))))
    return _star(met.select(members.alias("m")))


def _links_of_more(fps: DataFrame, half: int) -> DataFrame:
    """Balls of ``half`` bits: one bit more is flipped in each step, always a higher one; a point's members are a set of at most a ball's size."""
    spheres = [fps.select("fp", F.col("fp").alias("point"), F.lit(-1).alias("top"))]
    for _ in range(half):
        higher = F.explode(F.when(F.col("top") < 63, F.sequence(F.col("top") + 1, F.lit(63)))).alias("bit")
        flipped = F.col("point").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")))
        spheres.append(spheres[-1].select("fp", "point", higher).select("fp", flipped.alias("point"), F.col("bit").alias("top")))
    met = reduce(DataFrame.union, spheres).groupBy("point").agg(F.collect_set("fp").alias("m"))
    return _star(met.filter(F.size("m") > 1).select(F.array_sort("m").alias("m")))


def _star(groups: DataFrame) -> DataFrame:
    """(a, b): the first of each group's members ``m`` with each other one."""
    return groups.select(F.col("m")[0].alias("a"), F.explode(F.slice("m", F.lit(2), F.size("m"))).alias("b")).distinct()


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for each end of ``links`` (a, b); root is the smallest node of the component. Large-star and small-star rounds until nothing changes."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct()
        edges = materialize(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def near_duplicate_groups(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id, root) for every document; component_id is the smallest doc_id that links of at most ``radius`` bits reach, root the smallest fingerprint."""
    by_doc = materialize(fingerprints(docs, shingle, seed))
    first = materialize(by_doc.groupBy("fp").agg(F.min("doc_id").alias("first")))
    named = named_components(first, "fp", components(ball_links(first.select("fp"), radius)))
    return by_doc.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def named_components(first: DataFrame, node: str, roots: DataFrame) -> DataFrame:
    """(``node``, component_id, root) of every row of ``first`` (``node``, first): the least of ``first`` in its component by ``roots`` (node, root). Written, so that a join with it shuffles both sides by itself and Spark can split a node that many documents share."""
    placed = first.join(roots.select(F.col("node").alias(node), "root"), node, "left").select(node, "first", F.coalesce("root", node).alias("root"))
    lowest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return materialize(placed.join(lowest, "root").select(node, "component_id", "root"))


def keep_first(docs: DataFrame, groups: DataFrame, node_of: Callable[[bytes], int]) -> DataFrame:
    """``docs`` with those documents only that are the first of their group: ``groups`` is (doc_id, node, root), ``node_of`` gives a text's node. The first has the smallest doc_id (null last), and of several nodes with that doc_id the smallest one."""
    pairs = materialize(groups.select("doc_id", "node", "root").distinct())
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    best = pairs.groupBy("root").agg(F.min(order).alias("best"))
    judged = materialize(pairs.join(best, "root").select("doc_id", "node", (order == F.col("best")).alias("stays")))
    by_id = materialize(judged.groupBy("doc_id").agg(F.max("stays").alias("some"), F.min("stays").alias("all")).filter("not all"))
    same = lambda other: docs.doc_id.eqNullSafe(other._id)
    gone = by_id.select(F.col("doc_id").alias("_id"))
    kept = docs.join(gone, same(gone), "left_anti")
    mixed = by_id.filter("some")
    if not mixed.limit(1).count():
        return kept
    # doc_ids of which some texts stay and some go: only their texts are looked at again
    mixed = mixed.select(F.col("doc_id").alias("_id"))
    odd = docs.join(mixed, same(mixed), "left_semi")
    at, names = odd.columns.index("text"), [*odd.columns, "_node"]

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, pa.array([node_of(t) for t in texts_of(b.column(at))], pa.int64())], names)

    with_node = map_batches(odd, f, f"{columns_ddl(odd)}, _node long")
    stays = judged.filter("stays").select(F.col("doc_id").alias("_id"), F.col("node").alias("_stays"))
    return kept.union(with_node.join(stays, with_node.doc_id.eqNullSafe(stays._id) & (with_node._node == stays._stays), "left_semi").drop("_node"))


def as_long(fp: bytes) -> int:
    """A fingerprint's 8 bytes as a signed number."""
    return int.from_bytes(fp, "big", signed=True)


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """``docs`` without those that aren't the first of their component (see the module's defined results)."""
    groups = near_duplicate_groups(docs, shingle, seed, radius).withColumnRenamed("fp", "node")
    return keep_first(docs, groups, lambda t: as_long(fingerprint(t, shingle, seed)))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 4 over all documents."""
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
