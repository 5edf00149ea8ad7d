import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import near_copies, simhash
from corpusloom.llm.common import table
from tests.llm.small import documents, empty

DIR = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """fps: doc_id -> fingerprint; the smallest doc_id within reach."""
    nodes = sorted(fps)
    out = {}
    for n in nodes:
        if n not in out:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = n
                    todo += [y for y in nodes if y not in out and (fps[x] ^ fps[y]).bit_count() <= 2]
    return out


def test_fingerprints_and_groups(spark):
    df, rows = documents(spark)
    got = simhash.near_duplicate_groups(df).collect()
    fps = {i: brute_fingerprint(t) for i, t, _ in rows}
    assert len(got) == len(rows)
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == brute_components(fps)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components(fps).values()))


def test_links_of_planted_fingerprints(spark):
    r = random.Random(5)
    fps = []
    for _ in range(25):
        f = r.getrandbits(64)
        for _ in range(r.randint(1, 9)):
            fps.append(f)
            for b in r.sample(range(64), r.randint(0, 4)):
                f ^= 1 << b
    fps += [0, 1 << 63, (1 << 64) - 1]
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    links = simhash.ball_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    roots = {x.node: x.root for x in simhash.components(links).collect()}
    want = brute_components({f: f % (1 << 64) for f in signed})
    assert {f: roots.get(f, f) for f in signed} == want
    assert all(((x.a ^ x.b) % (1 << 64)).bit_count() <= 2 for x in links.collect())


def test_long_chain_and_star(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    roots = {x.node: x.root for x in simhash.components(spark.createDataFrame(pairs, "a long, b long").select(*map(F.col, "ab"))).collect()}
    assert set(roots.values()) == {0, 1000} and len(roots) == 201 + 300


def test_empty_table(spark):
    assert simhash.near_duplicate_groups(empty(spark)).count() == 0
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0


def test_rows_of_one_doc_id(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven", "twelve thirteen fourteen"
    rows = [(1, a), (2, a), (2, b), (3, b), (None, c), (None, a), (7, c), (None, "x y z"), (None, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted([(1, a), (2, b), (7, c), (None, "x y z"), (None, "x y z")], key=repr)
    assert sorted(map(tuple, simhash.drop_near_duplicates(df).collect()), key=repr) == want
    assert sorted(map(tuple, near_copies.drop_near_copies(df).collect()), key=repr) == want


def test_wider_radius(spark):
    r = random.Random(8)
    fps = [r.getrandbits(64) for _ in range(4)]
    for f in list(fps):
        for k in range(1, 7):
            for b in r.sample(range(64), k):
                f ^= 1 << b
            fps.append(f)
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    links = simhash.ball_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4)
    roots = {x.node: x.root for x in simhash.components(links).collect()}
    want = {}
    for n in sorted(signed):
        todo = [n] if n not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += [y for y in signed if ((x ^ y) % (1 << 64)).bit_count() <= 4]
    assert {f: roots.get(f, f) for f in signed} == want
    with pytest.raises(ValueError):
        simhash.ball_links(links, 3)


def test_query(spark):
    out = simhash.op4_simhash_near_dedup(spark, DIR)
    assert out.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    fps = {r.doc_id: brute_fingerprint(r.text) for r in table(spark, DIR, "documents").collect()}
    want = brute_components(fps)
    assert {tuple(r) for r in out.collect()} == {(i, f"{f:016x}", want[i]) for i, f in fps.items()}
