import re
from collections import Counter, defaultdict

import pytest

from corpusloom.llm import divergence
from tests.llm.small import SCHEMA, documents, empty
from tests.oracle import differences


def brute(rows, least, top=50):
    """By the contract's words, one document after another."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        g = (lang or "", source or "")
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        counts[g].update(terms)
        docs[g[0]].update(set(terms))
    out = set()
    for lang, source in counts:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        whole = sum(groups.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = share(groups[source]), share(whole)
        pair = [(sum(abs(p[t] - o[t]) for t in kept), s) for s, o in ((s, share(c)) for s, c in groups.items() if s != source)]
        term = [(p[t] - q[t], t) for t in kept if groups[source][t] and p[t] > q[t]]
        for part, found, n in (("pair", pair, len(pair)), ("term", term, top)):
            out |= {(lang, source, part, item, v, k) for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:n], 1)}
    return out


@pytest.mark.parametrize("least", [1, 2, 6, 10_000])
def test_against_brute_force(spark, least):
    df, _ = documents(spark)
    got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.divergence(df, least).collect()]
    want = brute([(r.text, r.lang, r.source) for r in df.collect()], least)
    assert len(got) == len(set(got)) and set(got) == want


def test_edges(spark):
    rows = [(1, None, None, None, 0, "x", 0), (1, None, None, None, 0, "x", 0), (2, "Ä ä b B", "l", "s", 0, "x", 0), (2, "Ä ä b B", "l", "s", 0, "x", 0), (3, "", "l", "t", 0, "x", 0), (4, "b" * 40_000 + " b" * 90_000, "l", "u", 0, "x", 0), (5, "1 2", "m", "only", 0, "x", 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"size": "rank", "h": "terms"})
    got = {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.divergence(df, 2).collect()}
    assert got == brute([(r[1], r[2], r[3]) for r in rows], 2) and any(g[2] == "term" for g in got)
    assert divergence.divergence(empty(spark)).collect() == []


def test_counts_beyond_64_bits(spark):
    """A billion times the count passes the range of long; the share stays exact."""
    df = spark.range(1).selectExpr("9000000000123456789 - 5 AS c", "9100000000000000000 AS n", "3 AS terms")
    assert df.selectExpr(divergence._share("c", "n")).first()[0] == 1 + 10**9 * 9000000000123456789 // (9100000000000000000 + 15)


def test_against_sql(spark):
    d = "/root/testdata/sf0.001"
    assert not differences(divergence.op11_source_divergence(spark, d), divergence.ORACLE_SQL, d)


def test_no_python_and_partial_sums(spark):
    df, _ = documents(spark)
    plan = divergence.divergence(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "partial_sum" in plan and "WindowGroupLimit" in plan
