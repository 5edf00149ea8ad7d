import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing
from corpusloom.llm.common import word_count
from tests.llm.small import documents, empty
from tests.oracle import differences


def brute_targets(sizes, share=1.5, cap=2):
    """Shares out, stops what is above its cap, and shares the excess again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not above:
            return target | {s: left * weight[s] / total for s in open_}
        for s in above:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def test_targets_and_rates(spark):
    df, rows = documents(spark)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    got = mixing.plan_mix(df.select("doc_id", "source", word_count().alias("size"))).collect()
    assert len(got) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.rate == pytest.approx(want[r.source] / sizes[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1


def test_many_sources_and_edges(spark):
    rows = [(i, f"s{i % 40}", i * i % 97) for i in range(400)] + [(None, None, 5), (None, None, 5), (900, "zero", 0)]
    got = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    want = brute_targets(sizes)
    assert len(got) == len(rows) and all(r.target == pytest.approx(want[r.source]) for r in got)


def test_mixed_rows(spark):
    df, rows = documents(spark)
    out = mixing.mix_documents(df)
    assert out.schema == df.schema
    plan = {(r.doc_id, r.i): r.copies for r in mixing.plan_mix(df.select("doc_id", "source", word_count().alias("size"), F.col("h").alias("i"))).collect()}
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id, r.h] += 1
    assert {k: v for k, v in plan.items() if v} == dict(got)
    assert mixing.mix_documents(empty(spark)).count() == 0


def test_against_sql(spark):
    d = "/root/testdata/sf0.001"
    assert not differences(mixing.op7_mixing_sources(spark, d), mixing.ORACLE_SQL, d)


def test_overlapping_constraints(spark):
    """Against Newton's method with the whole Hessian."""
    r = np.random.default_rng(1)
    cells = [(f"s{a}", f"l{b}", int(r.integers(50, 900))) for a in range(4) for b in range(3) if (a, b) != (2, 1)]
    rates = {k: float(r.uniform(0.4, 1.9)) for k in ["s0", "s1", "s2", "s3", "l0", "l1", "l2"]}
    aims = defaultdict(float)
    for a, b, n in cells:
        aims[a] += n * rates[a] * rates[b]
        aims[b] += n * rates[a] * rates[b]
    names = sorted(aims)
    x = np.array([[float(k in (a, b)) for k in names] for a, b, _ in cells])
    mass, target, lam = np.array([n for *_, n in cells], float), np.array([aims[k] for k in names]), np.zeros(len(names))
    for _ in range(60):
        m = mass * np.exp(x @ lam)
        lam += np.linalg.lstsq((x * m[:, None]).T @ x, target - x.T @ m, rcond=None)[0]
    df = spark.createDataFrame(cells, "source string, lang string, mass long")
    of = lambda c, k: spark.createDataFrame([(n, aims[n]) for n in names if n[0] == k], f"{c} string, target double")
    got = mixing.balance(df, {"source": of("source", "s"), "lang": of("lang", "l")}, tolerance=1e-9)
    tilt = {t[0]: t["lambda"] for g in got.values() for t in g.collect()}
    for (a, b, _), want in zip(cells, np.exp(x @ lam), strict=True):
        assert np.exp(tilt[a] + tilt[b]) == pytest.approx(want, rel=1e-6)


def test_no_text_moves(spark):
    """The plan of the mixed rows joins them with a broadcast table only."""
    df, _ = documents(spark)
    plan = mixing.mix_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Window" not in plan


def test_rows_that_share_a_doc_id(spark):
    rows = [(None if i % 3 == 0 else 5, f"s{i % 2}", f"{'w ' * (i % 17 + 1)}{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    taken = lambda d: sorted((r.source, r.text) for r in mixing.mix_documents(d).collect())
    out = taken(df)
    assert out == taken(df.repartition(2))
    sizes, got = defaultdict(int), defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(t.split())
    for s, t in out:
        got[s] += len(t.split())
    for s, t in brute_targets(sizes).items():
        assert abs(got[s] - t) <= 18


def test_repeated_rows_reach_the_target(spark):
    """One source of equal rows, and equal rows in the midst of others: to within half a row."""
    for rows in ([(1, "s", "a b c d", "x")] * 100, [(7, "s", "a b c", str(i)) for i in range(90)] + [(i, "s", "w " * (i % 5 + 1), "y") for i in range(40)] + [(None, "t", "u v", "z")] * 50):
        df = spark.createDataFrame(rows, "doc_id long, source string, text string, lang string").repartition(5)
        sizes, got = defaultdict(int), defaultdict(int)
        for _, s, t, _ in rows:
            sizes[s] += len(t.split())
        out = mixing.mix_documents(df).collect()
        for r in out:
            got[r.source] += len(r.text.split())
        for s, t in brute_targets(sizes).items():
            assert abs(got[s] - t) <= 2.5
        again = mixing.mix_documents(df.repartition(2)).collect()
        assert Counter((r.doc_id, r.source, r.text) for r in out) == Counter((r.doc_id, r.source, r.text) for r in again)
        assert len(mixing.plan_mix(mixing.materialize(mixing._sized(df))).collect()) == len(rows)
