"""Running values over ranges, and what is built on them, against plain loops; one document over many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import structure
from corpusloom.operators.scan import running


@pytest.mark.parametrize("ranges", [None, 1, 7])
def test_running(spark, ranges):
    r = random.Random(2)
    rows = [(None if i % 50 == 7 else "hot" if i % 3 else f"d{i % 5}", i, r.choice([None, 1, 2, -4]), r.choice([None, None, "x", "y"])) for i in range(500)]
    shuffled = rows[:]
    r.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "doc string, at long, n int, v string").repartition(3)
    got = running(df, "doc", ["at"], {"sum": F.col("n")}, {"last": F.col("v")}, ranges)
    sums, lasts, want = {}, {}, []
    for d, at, n, v in rows:
        sums[d] = sums.get(d, 0) + (n or 0)
        lasts[d] = v if v is not None else lasts.get(d)
        want.append((d, at, n, v, sums[d], lasts[d]))
    assert sorted(map(tuple, got.collect()), key=lambda x: x[1]) == want
    assert running(df.limit(0), "doc", ["at"], {"sum": F.col("n")}).count() == 0


def test_one_document_over_many_ranges(spark):
    """Sections whose chapter and whose first line lie in other ranges."""
    lines = ["before"] + [f"CHAPTER {k}" if k % 40 == 0 else f" {100 + k}.{k % 7} Title {k}" if k % 13 == 0 else f"line {k}" for k in range(1, 400)]
    df = spark.createDataFrame([("one", i, x) for i, x in enumerate(lines)] + [("two", 0, "x"), ("two", 1, "123.4 Only")], "doc string, at int, line string")
    few, many = (sorted(map(tuple, structure.sectionize(df, n).collect())) for n in (1, 16))
    assert few == many
    want, section, chapter, open_ = [], 0, None, None
    for x in lines:
        if x.startswith("CHAPTER"):
            section, chapter, open_ = section + 1, x.split()[1], None
        elif x.startswith(" 1") or x.startswith(" 2") or x.startswith(" 3") or x.startswith(" 4"):
            number, title = x.split(maxsplit=1)
            section += 1
            open_ = ["one", section, chapter, number, title, [x]]
            want.append(open_)
        elif open_:
            open_[5].append(x)
    assert [r for r in many if r[0] == "one"] == [(d, s, c, n, t, "\n".join(b)) for d, s, c, n, t, b in want]
    assert [r for r in many if r[0] == "two"] == [("two", 1, None, "123.4", "Only", "123.4 Only")]


@pytest.mark.parametrize("ranges", [1, 9])
def test_pages_of_lines(spark, ranges):
    r = random.Random(3)
    texts = ["\n".join("x" * r.randint(0, 3) for _ in range(r.randint(1, 6))) for _ in range(90)]
    pages = spark.createDataFrame([("a", i + 1, x) for i, x in enumerate(texts)], "doc string, page int, text string").repartition(4)
    starts = structure.page_starts(pages, ranges)
    at, want = 0, {}
    for i, x in enumerate(texts):
        want[i + 1] = at
        at += x.count("\n") + 1
    assert {p.page: p.start for p in starts.collect()} == want
    lines = spark.createDataFrame([("a", k) for k in range(at)] + [("a", 3), ("none", 1)], "doc string, at int")
    for x in structure.page_of_line(lines, starts, ranges).collect():
        assert x.page == (None if x.doc == "none" else max(p for p, s in want.items() if s <= x["at"]))


def test_no_document_in_one_task(spark):
    """Windows are over a range's part of a document, not over the document."""
    df = spark.createDataFrame([("one", i, "x") for i in range(50)], "doc string, at int, line string")
    plan = running(df, "doc", ["at"], {"n": F.lit(1)})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_range" in plan and "hashpartitioning(doc" not in plan
