"""Validation of odd texts against its SQL, and how its patterns are looked for."""

from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.operators import validation
from corpusloom.steps import shared_dir
from tests.oracle import differences

PLAIN = "several plain words stand here to be long enough"
TEXTS = [
    "", " ", "\n\t  ", "a" * 19, "a" * 20, f"  {'a' * 19}\n", f" \n{'a' * 20}  ", "a" + " " * 17 + "b", "a" + " " * 18 + "b", "é" * 20, "é" * 19,
    PLAIN + "\x01" * 2, PLAIN + "\x01" * 4, PLAIN + "漢" * 4, PLAIN + "漢" * 8, PLAIN + "⁯" * 9, PLAIN + "⁰" * 9, PLAIN + "\U0001f600" * 9,
    f"{PLAIN} Robot  Check", f"{PLAIN} robot checks", f"{PLAIN} bot verification", f"{PLAIN} 503", f"{PLAIN} Purchase", f"{PLAIN} subscribe\tto view", f"{PLAIN} SHIPPING",
    f"{PLAIN} <", f"{PLAIN} >", "> " * 30 + "<", "<a> b " * 20, "<a b c d e> " * 20, f"{PLAIN} <>",
    "one line\n" * 4 + PLAIN, "one line\n" * 5, "a line\nb line\nc line\nd line\ne line f", "a line\n a line\nc line\nd line\ne line f g h", "x\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\ny",
    f"{PLAIN} ...", f"{PLAIN} ... \n ", f"{PLAIN} ... x", f"{PLAIN}....", "w" * 101, "w" * 101 + " \n", "w" * 100 + ".", "w" * 101 + ")", f"{'w' * 120}\nshort",
    f"{PLAIN} 1234.5678", f"{PLAIN} 123.456.7890.1", f"{PLAIN} 12.3456", f"{PLAIN} 706.1 SHALL comply with astm  E119, Table 5 means", f"{PLAIN} marshall means sections", f"{PLAIN} ACI318 icc 500", f"{PLAIN} éshall", f"{PLAIN} shallé means",
]


def test_odd_texts(spark):
    folder = shared_dir(spark).removeprefix("file://")
    rows = [(12 * i, t) for i, t in enumerate([*TEXTS, *TEXTS[20:30]])]  # no made faults beside them
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    for name in ("validate_documents", "quarantine_split", "outcome_counts"):
        assert not differences(catalog.QUERIES[name](spark, folder), catalog.ORACLES[name], folder), name


def test_patterns_are_looked_for_in_one_pass(spark):
    """All alternatives of a pattern at once, and both layers by one call; else each costs a pass over the text."""
    df = spark.createDataFrame([(1, PLAIN)], "doc_id long, text string").withColumn("found", validation.seen(F.col("text")))
    df = df.select(validation.garbage_error(F.col("text"), F.lit(True), F.col("found")), "found.signs")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") + plan.count("ArrowEvalPython(") == 1
    for word in ("recaptcha", "membership", "nfpa", "regulated"):
        assert word not in plan.lower()
