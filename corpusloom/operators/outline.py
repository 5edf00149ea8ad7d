"""Outlines and reference graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.scan import running
from corpusloom.steps import written

#: A forest of 2^30 levels is none: its edges have a cycle.
MOST_DOUBLINGS = 30


def with_parents(outline: DataFrame, number: str = "number") -> DataFrame:
    """``outline`` with parent: the number without its last part if the outline has it, else the outline's chapter of its first part, or appendix of its letters, or the letters alone; null at the root. Numbers count without the blanks around them, and one that stands twice is one parent."""
    n = F.trim(F.col(number))
    dotted = n.rlike(r"^\d+(\.\d+)+$")
    letters = F.regexp_extract(n, r"^([A-Z]{1,3})\.\d+", 1)
    keys = outline.select(F.trim(F.col(number)).alias("key")).distinct()
    named = keys.select(F.lower(F.regexp_extract("key", r"(?i)^(Chapter|Appendix)\s+[A-Za-z0-9]+\b", 1)).alias("what"), F.lower(F.regexp_extract("key", r"(?i)^(?:Chapter|Appendix)\s+([A-Za-z0-9]+)\b", 1)).alias("of"), "key").filter("what <> ''").groupBy("what", "of").agg(F.min("key").alias("named"))
    wanted = outline.withColumns({
        "_up": F.when(dotted, F.regexp_replace(n, r"\.\d+$", "")),
        "_what": F.when(dotted, "chapter").when(letters != "", "appendix"),
        "_of": F.lower(F.when(dotted, F.element_at(F.split(n, r"\."), 1)).otherwise(letters)),
        "_letters": F.when(letters != "", letters),
    })
    up, alone = keys.select(F.col("key").alias("_up"), F.col("key").alias("_k1")), keys.select(F.col("key").alias("_letters"), F.col("key").alias("_k2"))
    return (
        wanted.join(up, "_up", "left").join(named.selectExpr("what AS _what", "of AS _of", "named AS _named"), ["_what", "_of"], "left").join(alone, "_letters", "left")
        .withColumn("parent", F.coalesce("_k1", "_named", "_k2"))
        .select(*outline.columns, "parent")
    )


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor, distance) of a forest ``edges`` (node, parent), each node its own ancestor at 0, however deep. Paths double: with all ancestors nearer than 2^k and each node's one at 2^k, a join gives those nearer than 2^(k+1). Each step is written; the edges are read once."""
    known = written(edges.select("node", "parent"))
    jump = known.filter("parent IS NOT NULL").select(F.col("node").alias("ancestor"), F.col("parent").alias("up"))
    known = known.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    for k in range(MOST_DOUBLINGS):
        if not jump.limit(1).count():
            return known
        further = known.join(jump, "ancestor").select("node", F.col("up").alias("ancestor"), (F.col("distance") + (1 << k)).alias("distance"))
        known = written(known.union(further))
        jump = written(jump.join(jump.select(F.col("ancestor").alias("up"), F.col("up").alias("_up")), "up").select("ancestor", F.col("_up").alias("up")))
    raise ValueError("the edges have a cycle")


def two_hops(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct (source, id, depth) that ``edges`` (src, dst) lead to from ``sources`` (source) in one or two steps. A second step's edges start where the first's ended, so each step is one join on a key."""
    e = edges.filter("src IS NOT NULL AND dst IS NOT NULL")
    one = e.join(sources, F.col("src") == F.col("source")).select("source", F.col("dst").alias("id"), F.lit(1).alias("depth")).distinct()
    two = one.join(e, F.col("id") == F.col("src")).select("source", F.col("dst").alias("id"), F.lit(2).alias("depth")).distinct()
    return one.union(two)


def typed_hops(references: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct (source, id, depth, type) that ``references`` (src, dst, type) lead to in one or two steps; type is that of the last one."""
    e = references.filter("src IS NOT NULL AND dst IS NOT NULL")
    one = e.join(sources, F.col("src") == F.col("source")).select("source", F.col("dst").alias("id"), F.lit(1).alias("depth"), "type").distinct()
    start = one.select("source", F.col("id").alias("_at")).distinct()
    return one.union(start.join(e, F.col("_at") == F.col("src")).select("source", F.col("dst").alias("id"), F.lit(2).alias("depth"), "type").distinct())


def interval_labels(nodes: DataFrame) -> DataFrame:
    """(node, first, last, depth) of a forest ``nodes`` (node, parent, seq): a node's place in document order, from 1, and that of the last node below it; written in the order of first.

    A subtree is the range from first to last, and a node's ancestors are those whose range holds its place, so that neither lookup joins by depth. Sizes are counted from ``ancestors``; a node stands after its parent and the subtrees of its earlier siblings (by seq, then node), and its place is the sum of these distances over its ancestors. Siblings are summed along ranges (``scan.running``), so one parent may have any number of children.

    Defined results: roots follow one another as siblings; a parent that isn't a node makes a root; nodes are distinct; an empty table gives an empty result; a cycle raises an error.
    """
    known = written(nodes.join(nodes.select(F.col("node").alias("_p")), F.col("parent") == F.col("_p"), "left").select("node", F.col("_p").alias("parent"), "seq"))
    above = ancestors(known)
    sizes = above.groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("size"))
    sized = known.join(sizes, "node").withColumn("_under", F.coalesce(F.concat(F.lit("n"), F.col("parent").cast("string")), F.lit("root")))
    upto = running(sized, "_under", ["seq", "node"], {"_upto": F.col("size")})
    away = written(upto.select("node", "size", (F.col("_upto") - F.col("size") + 1).alias("_away")))
    placed = above.join(away.select(F.col("node").alias("ancestor"), "_away"), "ancestor").groupBy("node").agg(F.sum("_away").alias("first"), F.max("distance").alias("depth"))
    labels = placed.join(away, "node").select("node", "first", (F.col("first") + F.col("size") - 1).alias("last"), "depth")
    return written(labels.repartitionByRange("first").sortWithinPartitions("first"))


def subtree_of(labels: DataFrame, node) -> DataFrame:
    """(place, node, depth) of a node and all below it, in document order from place 1: one range of ``labels``, of which other row groups are skipped. A node that isn't there gives no row."""
    at = labels.filter(F.col("node") == F.lit(node)).first()
    span = (at["first"], at["last"]) if at else (1, 0)
    return labels.filter(F.col("first").between(*map(F.lit, span))).select((F.col("first") - span[0] + 1).alias("place"), "node", "depth").orderBy("place")


def way_to(labels: DataFrame, node) -> DataFrame:
    """(depth, node) from the root down to a node: the labels whose range holds its place."""
    at = labels.filter(F.col("node") == F.lit(node)).first()
    place = at["first"] if at else 0
    return labels.filter((F.col("first") <= place) & (F.col("last") >= place)).select("depth", "node").orderBy("depth")
