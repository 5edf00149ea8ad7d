"""Outline trees and reference graphs. The outline: chapters from region, their sections from nation and customer keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.operators.outline import ancestors, interval_labels, subtree_of, two_hops, typed_hops, way_to, with_parents


def outline(t):
    n = t("nation")
    chapters = t("region").selectExpr("concat('Chapter ', r_regionkey) AS number", "r_name AS title")
    sections = n.selectExpr("concat(n_regionkey, '.', n_nationkey) AS number", "n_name AS title")
    parts = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("concat(n_regionkey, '.', n_nationkey, '.', c_custkey) AS number", "c_name AS title")
    return chapters.union(sections).union(parts)


_OUTLINE = """WITH o AS (SELECT 'Chapter ' || r_regionkey AS number, r_name AS title FROM region UNION ALL SELECT n_regionkey || '.' || n_nationkey, n_name FROM nation UNION ALL SELECT n_regionkey || '.' || n_nationkey || '.' || c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
tree AS (SELECT number, title, CASE WHEN number LIKE 'Chapter%' THEN NULL WHEN length(number) - length(replace(number, '.', '')) = 1 THEN 'Chapter ' || split_part(number, '.', 1) ELSE split_part(number, '.', 1) || '.' || split_part(number, '.', 2) END AS parent FROM o)"""


def _edges(t):
    return with_parents(outline(t)).select(F.col("number").alias("node"), "parent", "title")


@query("G8 J14", _OUTLINE + " SELECT number, title, parent FROM tree")
def outline_tree(t):
    return with_parents(outline(t))


@query("G9", _OUTLINE + ", s AS (SELECT number FROM tree WHERE number = 'Chapter 1' UNION ALL SELECT number FROM tree WHERE parent = 'Chapter 1' UNION ALL SELECT number FROM tree WHERE parent IN (SELECT number FROM tree WHERE parent = 'Chapter 1')) SELECT number FROM s")
def subtree(t):
    """A node and all below it."""
    return ancestors(_edges(t)).filter("ancestor = 'Chapter 1'").select(F.col("node").alias("number"))


@query("G10", _OUTLINE + " SELECT a.number, concat_ws(' > ', c.number, b.number, a.number) AS trail FROM tree a LEFT JOIN tree b ON a.parent = b.number LEFT JOIN tree c ON b.parent = c.number")
def breadcrumbs(t):
    """The way down to each node."""
    up = ancestors(_edges(t)).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("distance", "ancestor")), asc=False).alias("way"))
    return up.select(F.col("node").alias("number"), F.array_join(F.transform("way", lambda s: s.ancestor), " > ").alias("trail"))


@query("P18", _OUTLINE + """, hit AS (SELECT number, parent FROM tree WHERE contains(lower(number), '17') OR contains(lower(title), '17'))
 SELECT number FROM hit UNION SELECT parent FROM hit WHERE parent IS NOT NULL UNION SELECT t.parent FROM hit JOIN tree t ON hit.parent = t.number WHERE t.parent IS NOT NULL""")
def tree_filter(t):
    """Nodes that match, and all above them."""
    edges = _edges(t)
    hits = edges.filter(F.lower("node").contains("17") | F.lower("title").contains("17")).select("node")
    return ancestors(edges).join(hits, "node", "left_semi").select(F.col("ancestor").alias("number")).distinct()


_EDGES = "WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem), src AS (SELECT DISTINCT l_partkey AS source FROM lineitem WHERE l_partkey % 100 = 0)"


@query("J2 J3 A6", _EDGES + " SELECT source, dst AS id, 1 AS depth FROM src JOIN e ON src = source UNION SELECT s.source, f.dst, 2 FROM src s JOIN e ON e.src = s.source JOIN e f ON f.src = e.dst")
def two_hop_graph(t):
    """Part to supplier, and on to the suppliers of the part of that number, for the stated queries: the parts whose number is divisible by 100."""
    l = t("lineitem")  # noqa: E741
    edges = l.selectExpr("l_partkey AS src", "l_suppkey AS dst").distinct()
    return two_hops(edges, l.filter("l_partkey % 100 = 0").selectExpr("l_partkey AS source").distinct())


_TYPED = "WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, l_returnflag AS type FROM lineitem), src AS (SELECT DISTINCT l_partkey AS source FROM lineitem WHERE l_partkey % 100 = 0)"


@query("G6", _TYPED + """ SELECT g.id, s_name AS name, source, depth, type FROM (SELECT source, dst AS id, 1 AS depth, type FROM src JOIN e ON src = source UNION SELECT s.source, f.dst, 2, f.type FROM src s JOIN e ON e.src = s.source JOIN e f ON f.src = e.dst) g JOIN supplier ON s_suppkey = g.id""")
def section_graph(t):
    """What the stated parts reach in two steps, with the kind of the last reference (the return flag) and what stands there."""
    l = t("lineitem")  # noqa: E741
    references = l.selectExpr("l_partkey AS src", "l_suppkey AS dst", "l_returnflag AS type").distinct()
    reached = typed_hops(references, l.filter("l_partkey % 100 = 0").selectExpr("l_partkey AS source").distinct())
    return reached.join(t("supplier").selectExpr("s_suppkey AS id", "s_name AS name"), "id").select("id", "name", "source", "depth", "type")


@query("G7", """SELECT l_partkey AS section, 'internal' AS side, l_returnflag AS type, CAST(l_orderkey AS VARCHAR) AS target FROM lineitem WHERE l_partkey % 50 = 3 AND l_linenumber <> 2
 UNION ALL SELECT l_partkey, 'external', NULL, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey % 50 = 3""")
def section_references(t):
    """Of the stated sections (parts): references to other sections with their kind, where the target is known (here: not those of line 2), and to standards."""
    own = t("lineitem").filter("l_partkey % 50 = 3")
    internal = own.withColumn("target", F.when(F.col("l_linenumber") != 2, F.col("l_orderkey"))).filter("target IS NOT NULL")
    external = own.join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return internal.selectExpr("l_partkey AS section", "'internal' AS side", "l_returnflag AS type", "cast(target AS string) AS target").union(external.selectExpr("l_partkey AS section", "'external' AS side", "cast(NULL AS string) AS type", "s_name AS target"))


@query("G15", _OUTLINE + " SELECT number, title, parent FROM tree WHERE number IN ('Chapter 1', '3.7', 'no such')")
def find_nodes(t):
    """Nodes of the outline by their numbers; those that aren't there give no row."""
    return with_parents(outline(t)).filter(F.col("number").isin("Chapter 1", "3.7", "no such"))


_ORDERED = """WITH o AS (SELECT 'Chapter ' || r_regionkey AS node, 0 AS depth, r_regionkey AS a, -1 AS b, -1 AS c FROM region UNION ALL SELECT n_regionkey || '.' || n_nationkey, 1, n_regionkey, n_nationkey, -1 FROM nation UNION ALL SELECT n_regionkey || '.' || n_nationkey || '.' || c_custkey, 2, n_regionkey, n_nationkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
 l AS (SELECT node, depth, a, b, row_number() OVER (ORDER BY a, b, c) AS first, CASE depth WHEN 0 THEN count(*) OVER (PARTITION BY a) WHEN 1 THEN count(*) OVER (PARTITION BY a, b) ELSE 1 END AS size FROM o)"""


def _labels(t):
    """Of the outline, siblings in the order of their numbers' last parts."""
    last = F.regexp_extract("node", r"(\d+)$", 1).cast("long")
    return interval_labels(_edges(t).select("node", "parent", last.alias("seq")))


@query("G9 G10 P18", _ORDERED + " SELECT node, first, CAST(first + size - 1 AS BIGINT) AS last, depth FROM l")
def outline_labels(t):
    """Every node's range in document order."""
    return _labels(t)


@query("G9", _ORDERED + " SELECT row_number() OVER (ORDER BY first) AS place, node, depth FROM l WHERE a = 1")
def subtree_in_order(t):
    """A node and all below it, in document order."""
    return subtree_of(_labels(t), "Chapter 1")


@query("G10", _ORDERED + " SELECT depth, node FROM l WHERE node = 'Chapter 3' OR node = '3.3'")
def way_down(t):
    """The way from the root to a node."""
    return way_to(_labels(t), "3.3")
