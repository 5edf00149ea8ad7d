import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import fill_middle as fim
from tests.llm.small import SCHEMA, documents, empty, texts
from tests.oracle import differences

GRAMMARS = {"token": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "run": r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", "line": r"[^\n]*\n|[^\n]+", "char": r"(?s)."}
ODD = ["", " ", "\n", "a", " a", "a ", "\t\va  b\r\n\n", " x  y\u0085z", "😀 😀\n\n😀", "a\x1cb \x00 c", "\n\n\n", "x" * 5000, "é ́"]


@pytest.mark.parametrize("grammar", GRAMMARS)
def test_units(spark, grammar):
    ts = [t for t in texts() if t is not None] + ODD
    got = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "i long, t string").select("i", fim.units(F.col("t"), grammar).alias("u")).collect()
    for r in got:
        assert r.u == re.findall(GRAMMARS[grammar], ts[r.i])


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    w = re.findall(GRAMMARS["token"], text)
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = ("".join(x) for x in (w[:a], w[a:b], w[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return len(w), "plain", text, None, None
    if h4 % 100 < 80:
        return len(w), "spm", f"<S>{s}<P>{p}<M>{m}", p, m
    return len(w), "psm", f"<P>{p}<S>{s}<M>{m}", p, m


def test_against_brute_force(spark):
    ts = texts() + ODD + ["a <P> b c d", "x<M>", "< S> <S"] + ["one <S two < three <", "<P <S <M"] * 20
    rows = [(None if i % 17 == 3 else i % 60, t, None, "s", 1, "clash", 5) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"size": "prefix", "h": "n"})
    made = fim.fill_middle(df).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.output, r.prefix, r.middle, r.back) for r in made.collect()), key=repr)
    assert got == sorted(((d, t, *brute(d, t), t or "") for d, t, *_ in rows), key=repr)
    assert {r[3] for r in got} == {"plain", "spm", "psm"} and "source" in made.columns


def test_restored_beside_halves_of_sentinels(spark):
    parts = ["", "<", "<S", "<P", "<M", "S>", "P>", "M>", ">", "<<S"]
    rows = [(p, s, m) for p in parts for s in parts for m in parts if not re.search("<[PSM]>", p + m + s)]
    df = spark.createDataFrame(rows, "p string, s string, m string")
    psm, spm = F.concat(F.lit("<P>"), "p", F.lit("<S>"), "s", F.lit("<M>"), "m"), F.concat(F.lit("<S>"), "s", F.lit("<P>"), "p", F.lit("<M>"), "m")
    whole = F.concat("p", "m", "s")
    assert df.filter((fim.restored(psm, F.lit("psm")) != whole) | (fim.restored(spm, F.lit("spm")) != whole)).count() == 0


def test_edges(spark):
    df, rows = documents(spark)
    assert fim.fill_middle(df, rate=0).filter("form <> 'plain' or output <> coalesce(text, '')").count() == 0
    assert fim.fill_middle(df, rate=100).filter("form = 'plain' and text > ''").count() == 0
    assert fim.fill_middle(empty(spark)).count() == 0
    plan = fim.fill_middle(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_against_sql(spark):
    d = "/root/testdata/sf0.001"
    assert not differences(fim.op13_fill_in_middle(spark, d), fim.ORACLE_SQL, d)
