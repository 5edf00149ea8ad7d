"""Interval labels against a walk over the tree; ranges, pages and parents that were mended."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.citations import expand_range
from corpusloom.operators import structure
from corpusloom.operators.outline import interval_labels, subtree_of, way_to, with_parents


def walk(nodes):
    """(node, first, last, depth) by recursion."""
    known, children = {n for n, *_ in nodes}, {}
    for n, p, s in nodes:
        children.setdefault(p if p in known else None, []).append((s, n))
    out = []

    def down(n, depth):
        at = len(out)
        out.append([n, at + 1, None, depth])
        for _, c in sorted(children.get(n, [])):
            down(c, depth + 1)
        out[at][2] = len(out)

    for _, n in sorted(children.get(None, [])):
        down(n, 0)
    return [tuple(x) for x in out]


def test_labels(spark):
    r = random.Random(6)
    nodes = [("n0", None, 3), ("lost", "no such node", 1), ("hot", None, 2)] + [(f"n{i}", "hot" if i % 3 == 0 else f"n{max(0, i - r.randint(1, 4))}" if i % 5 else None, r.randint(0, 3)) for i in range(1, 120)]
    labels = interval_labels(spark.createDataFrame(nodes, "node string, parent string, seq int").repartition(4))
    want = walk(nodes)
    assert sorted(map(tuple, labels.collect()), key=lambda x: x[1]) == want
    of = {n: (a, b) for n, a, b, _ in want}
    for n in ("hot", "n0", "n7", "no such node"):
        inside = [m for m, a, _, _ in want if n in of and of[n][0] <= a <= of[n][1]]
        got = subtree_of(labels, n)
        assert [x.node for x in got.collect()] == inside and [x.place for x in got.collect()] == list(range(1, len(inside) + 1))
        assert [x.node for x in way_to(labels, n).collect()] == [m for m, a, b, _ in want if n in of and a <= of[n][0] <= b]
    assert "Join" not in subtree_of(labels, "hot")._jdf.queryExecution().executedPlan().toString()
    assert interval_labels(spark.createDataFrame([], "node string, parent string, seq int")).count() == 0


def test_wide_ranges_stay(spark):
    refs = ["706.1 through 706.2000000000", "706.1 through 706.3", "706.3 through 706.1", "1.1 through 1.1000", "1.1 through 1.1001", None]
    got = [r.e for r in spark.createDataFrame([(i, x) for i, x in enumerate(refs)], "i int, t string").orderBy("i").select(expand_range(F.col("t")).alias("e")).collect()]
    assert got[:3] == [[refs[0]], ["706.1", "706.2", "706.3"], []] and len(got[3]) == 1000 and got[4] == [refs[4]] and got[5] in (None, [None])


def test_pages_that_are_null_or_missing(spark):
    toc = spark.createDataFrame([("a", 1, "1", None), ("a", 2, "2", 1), ("a", 3, None, None), ("b", 1, "1", 4)], "doc string, seq int, number string, page int")
    pages = spark.createDataFrame([("a", 1, "x"), ("a", 2, "1 One"), ("a", 3, "2 Two")], "doc string, page int, text string")
    got = {(r.doc, r.seq): (r.page, r.state) for r in structure.repair_pages(toc, pages).collect()}
    assert got == {("a", 1): (2, "verified"), ("a", 2): (3, "verified"), ("a", 3): (3, "unverified"), ("b", 1): (0, "unverified")}


@pytest.mark.parametrize("twice", ["1.1", "1.1 ", " 1.1"])
def test_parents_that_stand_twice(spark, twice):
    df = spark.createDataFrame([("1.1",), (twice,), ("1.1.2",)], "number string")
    rows = [tuple(r) for r in with_parents(df).collect()]
    assert len(rows) == 3 and ("1.1.2", "1.1") in rows
