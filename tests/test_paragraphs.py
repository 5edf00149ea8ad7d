"""Lines put together to paragraphs, against a plain loop over made texts."""

import random
import re

from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import validation

MARK = re.compile(text.OWN_PARAGRAPH)


def by_loop(whole):
    out = []
    for block in re.split(r"\n\s*\n+", whole or ""):
        fresh = True
        for line in filter(None, map(str.strip, block.splitlines())):
            if fresh or MARK.match(line):
                out.append(line)
            elif out[-1].endswith("-"):
                out[-1] = out[-1][:-1] + line
            else:
                out[-1] += " " + line
            fresh = False
    return [re.sub(r"\s{2,}", " ", p).strip() for p in out]


def test_like_a_loop(spark):
    dice = random.Random(5)
    parts = ["\n", "\n\n", "\r\n", "\r", "\x0b", "\x1c", "\x1f", "\x85", " ", "\xa0", " ", "  ", "\t", "-", "-\n", "a", "Wall", "(a) ", "( iv )", "12b. ", "• ", "Note:", "exceptions:", "ß", "\0"]
    texts = ["".join(dice.choices(parts, k=dice.randrange(30))) for _ in range(3000)] + ["", None, "-\n-\n-", "x\n" * 20000, "w " * 100000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", "t", text.paragraphs(F.col("t")).alias("p"))
    for r in rows.collect():
        assert r.p == by_loop(r.t), repr(r.t)[:200]


def test_no_python(spark):
    plan = spark.range(1).select(text.normalize(F.lit("a"), F.lit(""), F.lit("")))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_few_rejects_move_no_text(spark):
    docs = spark.createDataFrame([(1, "short"), (2, "a text that is long enough"), (2, "a text that is long enough"), (3, "a text that is long enough"), (4, None)], "doc_id long, text string")
    out = validation.rejected(docs)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.error) for r in out.collect()) == [(1, "Content too short"), (3, "Duplicate content"), (4, "Content too short")]
