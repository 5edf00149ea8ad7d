import hashlib
from collections import Counter

import pytest

from corpusloom.llm import sharding
from tests.llm.small import documents, empty
from tests.oracle import differences


def brute_table(names, slots):
    """Every shard's whole list of preferences, then turns."""
    prefs = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        a, s = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        prefs.append([(a + j * s) % slots for j in range(slots)])
    owner = {}
    while len(owner) < slots:
        for k, p in enumerate(prefs):
            if len(owner) < slots:
                owner[next(x for x in p if x not in owner)] = k
    return [owner[i] for i in range(slots)]


def test_table():
    names = [f"n{i}" for i in range(7)]
    assert sharding.lookup_table(names, 251) == brute_table(names, 251)
    even = Counter(sharding.lookup_table(names, 65537))
    assert max(even.values()) - min(even.values()) <= 1
    twice = Counter(sharding.lookup_table(names, 65537, [2, 1, 1, 1, 1, 1, 1]))
    assert abs(twice[0] - 2 * twice[1]) <= 2
    a, b = sharding.lookup_table(names, 65537), sharding.lookup_table(names[:-1], 65537)
    assert sum(x != y for x, y in zip(a, b)) < 0.25 * len(a)
    for bad in (([], 7), (["a", "a"], 7), (["a"], 9)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement(spark, tmp_path):
    df, rows = documents(spark)
    df = df.withColumnRenamed("h", "slot")
    got = sharding.place(df, shards=5, slots=251)
    assert got.columns == [c for c in df.columns if c != "slot"] + ["slot", "shard"]
    table = brute_table([f"shard-{k:05d}" for k in range(5)], 251)
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % 251
        assert (r.slot, r.shard) == (slot, f"shard-{table[slot]:05d}")
    null = sharding.place(spark.createDataFrame([(None,), (None,)], "doc_id long")).collect()
    assert null[0] == null[1]
    assert sharding.place(empty(spark)).count() == 0
    sharding.write_shards(got, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.001"
    out = sharding.op5_sharding(spark, d)
    assert out.dtypes == [("doc_id", "bigint"), ("slot", "bigint"), ("shard", "string")]
    assert not differences(out, sharding.oracle_sql(), d)
