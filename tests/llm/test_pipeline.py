"""Each stage of the pipeline against its operator's brute force, on that stage's own input."""

from collections import Counter

import corpus_pipeline
from corpusloom.llm import mixing, toxicity
from corpusloom.llm.common import word_count
from tests.llm.test_decontaminate import brute
from tests.llm.test_near_copies import brute_groups

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    schema, inputs = docs.schema, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "sharding":
            assert docs.schema == schema and docs.count() > 0
    rows = {name: df.collect() for name, df in inputs.items()}
    ids = {name: Counter(r.doc_id for r in x) for name, x in rows.items()}

    model = toxicity.fit(inputs["toxicity"], spark.read.parquet(f"{DIR}/labels.parquet").filter("pmod(crc32(cast(doc_id as string)), 4) <> 2"))
    scored = {r.doc_id: r.score for r in toxicity.score(inputs["toxicity"], model).collect()}
    assert set(ids["simhash near-dedup"]) == {i for i, s in scored.items() if s < 0.3}

    # near duplicates by either measure that the stage takes: two bits, or five-word shingles of similarity 0.8
    assert set(ids["benchmark decontamination"]) == set(brute_groups([(r.doc_id, r.text) for r in rows["simhash near-dedup"]]).values())

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    clean = set()
    for r in rows["benchmark decontamination"]:
        words = " ".join(r.text.lower().split())
        n, hit, _, _ = brute(r.text, [x for x in items if any(w in words for w in x[1].lower().split()[3:6])])
        if not (hit and 20 * len(hit) >= n):
            clean.add(r.doc_id)
    assert set(ids["mixing"]) == clean

    plan = {r.doc_id: r.copies for r in mixing.plan_mix(inputs["mixing"].select("doc_id", "source", word_count().alias("size"))).collect()}
    assert ids["sharding"] == Counter({k: v for k, v in plan.items() if v})
    out = docs.collect()
    assert Counter(r.doc_id for r in out) == ids["sharding"] and docs.columns == [*schema.fieldNames(), "slot", "shard"]
    assert len({(r.doc_id, r.shard) for r in out}) == len({r.doc_id for r in out})


def test_run(spark):
    assert corpus_pipeline.run(spark, DIR).count() > 0
