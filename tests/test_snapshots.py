"""Batches of books: only their parts are written, and a batch that comes again changes nothing."""

import os

from corpusloom.operators import snapshots
from corpusloom.steps import shared_dir

COLUMNS = "book string, number long, text string"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path.removeprefix("file://")) for f in names if f.endswith(".parquet")}


def rows(spark, path):
    return sorted((tuple(r) for r in snapshots.current(spark, path, COLUMNS).select("book", "number", "text", "version", "batch", "superseded_date").collect()), key=repr)


def test_only_what_changed(spark):
    path = shared_dir(spark)
    take = lambda made, b: snapshots.replace_books(path, spark.createDataFrame(made, COLUMNS), b, f"day{b}", parts=16)
    first = [(f"b{k}", n, "old") for k in range(10) for n in range(3)] + [(None, None, "x"), (None, None, "x")]
    assert take(first, 1)
    before = files(path)
    again = take([("b3", 1, "new"), ("b3", 7, "new"), (None, None, "y")], 2)
    after = files(path)
    kept = {p for p in before if p in after and before[p] == after[p]}
    assert {p for p in before if not any(f"part={k}/" in p for k in again)} == kept and kept
    got = rows(spark, path)
    assert [r for r in got if r[4] == 2] == sorted([("b3", 1, "new", 2, 2, None), ("b3", 7, "new", 1, 2, None), (None, None, "y", 2, 2, None)], key=repr)
    assert {r[0] for r in got if r[5] == "day2"} == {"b3", None} and sum(r[5] is not None for r in got) == 5
    assert take([("b3", 1, "new"), ("b3", 7, "new"), (None, None, "y")], 2) == [] and files(path) == after  # a second run
    assert take([], 3) == [] and files(path) == after


def test_a_batch_that_broke_off(spark):
    path = shared_dir(spark)
    whole = [(f"b{k}", 1, "t") for k in range(8)]
    snapshots.replace_books(path, spark.createDataFrame(whole[:3], COLUMNS), 1, "day", parts=4)  # what it had done
    snapshots.replace_books(path, spark.createDataFrame(whole, COLUMNS), 1, "day", parts=4)
    assert rows(spark, path) == sorted(((*r, 1, 1, None) for r in whole), key=repr)
