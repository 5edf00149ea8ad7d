"""Operator 9 on held-out rows of each language."""

import pytest

from corpusloom.llm import toxicity
from corpusloom.llm.common import table
from tests.llm.test_classifiers import DIR, auc


@pytest.fixture(scope="module")
def held_out(spark):
    joined = toxicity.op9_toxicity(spark, DIR).join(table(spark, DIR, "labels"), "doc_id").join(table(spark, DIR, "documents").select("doc_id", "lang"), "doc_id")
    return joined.filter("held_out and toxic is not null").collect()


@pytest.mark.parametrize("lang", ["en", "de", "fr", "es"])
def test_toxicity_held_out_by_language(held_out, lang):
    rows = [r for r in held_out if r.lang == lang]
    found = [r.predicted for r in rows if r.toxic == 1]
    value = auc([r.toxic for r in rows], [r.score for r in rows])
    print(f"FIGURE {lang}: AUC {value:.3f}, {sum(found)} of {len(found)} toxic rows found, {sum(r.predicted for r in rows if r.toxic == 0)} of {len(rows) - len(found)} others rejected")
    assert value > 0.85
