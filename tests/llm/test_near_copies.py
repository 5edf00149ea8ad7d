"""The pipeline's near duplicates against all pairs."""

import random

import corpus_pipeline
import pytest
from corpusloom.llm import near_copies
from tests.llm.small import SCHEMA, documents, empty
from tests.llm.test_simhash import brute_fingerprint


def brute_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(rows):
    """rows: (doc_id, text); the smallest doc_id within reach."""
    sets, fps = {i: brute_set(t) for i, t in rows}, {i: brute_fingerprint(t) for i, t in rows}
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2 or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    out = {}
    for n in sorted(sets):
        if n not in out:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = n
                    todo += [y for y in sets if y not in out and near(x, y)]
    return out


def edited(seed, groups, copies):
    """Texts of 3 to 400 words, with copies in which about 1 word in 60 is another, of the text or of its last copy."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    line, out = [word() for _ in range(12)], []
    for g in range(groups):
        base = [word() for _ in range(r.choice([3, 12, 40, 150, 400]))]
        at = r.randrange(len(base)) if g % 2 else 0
        base[at:at] = line if g % 2 else []
        for k in range(copies):
            out.append(" ".join(base))
            new = [word() if r.random() < 1 / 60 else w for w in base]
            base = new if k % 2 else base
            out.append(" ".join(new))
    return out


def test_stage_finds_all_edited_copies(spark):
    ts = edited(3, 40, 3) + edited(4, 1, 60)
    rows = [(i, t) for i, t in enumerate(random.Random(1).sample(ts, len(ts)))]
    df = spark.createDataFrame([(i, t, None, None, len(t), None, None) for i, t in rows], SCHEMA).repartition(3)
    want = brute_groups(rows)
    assert len(set(want.values())) < len(set(t for _, t in rows))
    kept = corpus_pipeline.first_of_group(spark, df, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_groups_of_small_tables(spark):
    df, rows = documents(spark)
    got = near_copies.near_copy_groups(df).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == brute_groups([(i, t) for i, t, _ in rows])
    assert near_copies.drop_near_copies(empty(spark)).count() == 0


def test_frequent_shingles_and_long_runs(spark, monkeypatch):
    """Boilerplate in all sets: its rows are dealt by set and its runs read in pieces; the groups are the same."""
    line = " ".join(f"line{i}" for i in range(30))
    ts = [f"{t} {line}" for t in edited(5, 25, 3)] + [line] * 40 + [f"{line} {i}" for i in range(60)]
    rows = list(enumerate(random.Random(2).sample(ts, len(ts))))
    df = spark.createDataFrame([(i, t, None, None, len(t), None, None) for i, t in rows], SCHEMA).repartition(5)
    want = brute_groups(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for frequent, held in ((10, 200_000), (10, 3), (10_000, 20), (10_000, 2)):
            for name, value in {"FREQUENT": frequent, "HELD": held, "SALTS": 4, "REMEMBERED": 30}.items():
                monkeypatch.setattr(near_copies, name, value)
            assert {r.doc_id: r.component_id for r in near_copies.near_copy_groups(df).collect()} == want, (frequent, held)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_groups_of_a_table(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = {r.doc_id: r.component_id for r in near_copies.near_copy_groups(df).collect()}
    assert got == brute_groups([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_only_sets_that_meet_others_send_all_shingles(spark, monkeypatch):
    """Heads go first: what all sets together send is far less than all their shingles, and the groups are the same."""
    ts = edited(7, 60, 0) + [" ".join(random.Random(s).choices([f"{a}{b}" for a in "klmnop" for b in "qrstuvw"], k=300)) for s in range(80)] + edited(8, 4, 2)
    ts = [t for k, t in enumerate(ts) if t not in ts[:k]]
    rows = list(enumerate(ts))
    df = spark.createDataFrame([(i, t, None, None, len(t), None, None) for i, t in rows], SCHEMA).repartition(3)
    sent, shared = [], near_copies._shared
    monkeypatch.setattr(near_copies, "_shared", lambda sets, frequent: (sent.append(sum(len(r.x) for r in sets.collect())), shared(sets, frequent))[1])
    assert {r.doc_id: r.component_id for r in near_copies.near_copy_groups(df).collect()} == brute_groups(rows)
    assert sum(sent) < 0.6 * sum(len(brute_set(t)) for t in ts)


def test_heads_of_similar_sets_meet(spark):
    r = random.Random(4)
    for n in [*range(1, 40), 99, 100, 101, 1000]:
        a = set(r.sample(range(10**6), n))
        for gone in range(n // 5 + 1):
            for new in range(n // 4 + 1) if n < 40 else (0, n // 9, n // 4):
                b = set(list(a)[gone:]) | set(range(10**6, 10**6 + new))
                if 5 * len(a & b) >= 4 * len(a | b):
                    order = {x: r.random() for x in a | b}
                    heads = [set(sorted(s, key=order.get)[: near_copies.head_length(len(s))]) for s in (a, b)]
                    least = [(4 * len(s) + 4) // 50 + 1 for s in (a, b)]
                    assert len(heads[0] & heads[1]) >= max(least), (n, gone, new)
    got = spark.range(1001).select("id", near_copies.least_met(near_copies.F.col("id")).alias("m")).collect()
    assert all(row.m == (4 * row.id + 4) // 50 + 1 for row in got)
