"""Batches against the index, held against all rows at once."""

import random

import pytest

from corpusloom.operators.duplicate_index import DuplicateIndex
from corpusloom.steps import shared_dir


def batches(n, size, texts=40):
    dice = random.Random(3)
    return [[(b * 1000 + k, dice.choice([None, "", *(f"text {x}" for x in range(texts))])) for k in range(size)] for b in range(n)]


def whole(parts):
    seen, out = set(), []
    for doc, text in (row for part in parts for row in part):
        out.append((doc, text is not None and text in seen))
        seen.add(text)
    return sorted(out)


def rows_of(spark, part):
    return spark.createDataFrame(part, "doc_id long, text string")


def test_batches_equal_one(spark):
    parts, path = batches(7, 25), shared_dir(spark)
    got = []
    for b, part in enumerate(parts):
        index = DuplicateIndex(spark, path, buckets=3, fanout=2)  # as a later session would
        got += [(r.doc_id, r.duplicate) for r in index.add(rows_of(spark, part), b).collect()]
    assert sorted(got) == whole(parts)
    assert len(index.tables) < 7 and max(level for level, _ in index.tables) > 0
    hashes = [r.hash for _, p in index.tables for r in index._open(p).collect()]
    assert len(hashes) == len(set(hashes)) == len({t for part in parts for _, t in part if t is not None})


def test_again_and_empty(spark):
    parts, path = batches(2, 10, 3), shared_dir(spark)
    index = DuplicateIndex(spark, path, buckets=2)
    index.add(rows_of(spark, parts[0]), 0)
    answers = [sorted((r.doc_id, r.duplicate) for r in index.add(rows_of(spark, parts[1]), 1).collect()) for _ in range(2)]
    assert answers[0] == answers[1]
    assert len(index.tables) == 2
    assert not index.add(rows_of(spark, []), 2).collect()
    with pytest.raises(ValueError):
        index.add(rows_of(spark, parts[0]), 0)
    repeated = index.add(rows_of(spark, [(9, "once"), (9, "once"), (10, "once")]), 3).collect()
    assert sorted((r.doc_id, r.duplicate) for r in repeated) == [(9, False), (9, False), (10, True)]


def test_the_index_is_not_shuffled(spark):
    path = shared_dir(spark)
    index = DuplicateIndex(spark, path, buckets=4)
    for b, part in enumerate(batches(2, 30)):
        index.add(rows_of(spark, part), b)
    plan = index.earlier(rows_of(spark, [(1, "x")]).selectExpr("text AS hash", "doc_id AS first"), 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 2, plan
