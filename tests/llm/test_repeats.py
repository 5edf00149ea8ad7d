"""Operators 1 and 3 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from corpusloom.llm import repeats, substring_dedup, suffix_dedup
from tests.llm.small import documents, empty


def brute_bytes(rows, length):
    """rows: (order, text) with distinct orders."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = [True] * length
            seen.add(b[i : i + length])
        out[d] = (len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), bytes(c for c, g in zip(b, gone) if not g))
    return out


def brute_words(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone, own = [False] * len(w), []
        for i in range(len(w) - length + 1):
            own.append(tuple(w[i : i + length]))
            if own[-1] in seen:
                gone[i : i + length] = [True] * length
        seen.update(own)
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def hard_texts(seed):
    """Copies with edits, periodic texts, one symbol over and over, passages at the ends."""
    r = random.Random(seed)
    base = ["".join(r.choices("ab c", k=r.randint(1, 400))) for _ in range(6)]
    out = []
    for _ in range(60):
        t = "".join(r.choice(base)[r.randint(0, 40) :] for _ in range(r.randint(1, 4)))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(t) + 1)
            t = t[:i] + r.choice(["", "x", "é"]) + t[i + 1 :]
        out.append(t)
    return out + ["a" * 500, "a" * 300, "ab" * 200, "a b " * 150, "", None, " "]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("length", "key"), [(100, 32), (40, 8), (17, 16)])
def test_bytes(spark, seed, length, key):
    rows = list(enumerate(hard_texts(seed)))
    want = brute_bytes(rows, length)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), length, key).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got} == want


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("length", "key", "batches", "fanout"), [(50, 16, 4, 2), (12, 4, 5, 1), (6, 4, 1, 2)])
def test_words(spark, seed, length, key, batches, fanout):
    rows = [(7 * i, t) for i, t in enumerate(hard_texts(seed))]
    want = brute_words(rows, length)
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), length, key, batches, fanout).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want


def test_small_tables(spark):
    df, rows = documents(spark)
    pairs = [(i, t) for i, t, _ in rows]
    want = brute_bytes(pairs, 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()} == want
    want = brute_words(pairs, 50)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(df).collect()} == want
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0 and substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_same_doc_ids_and_nulls(spark):
    import hashlib

    r = random.Random(3)
    long_ = " ".join(r.choices(["ab", "cde", "f", "ghij"], k=200))
    rows = [(5, long_), (5, long_), (5, "x " + long_), (None, long_ + " y"), (None, None), (2, "z " + long_[50:]), (9, long_)]
    distinct = sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5((x[1] or "").encode()).hexdigest(), x[1] is None))
    for got, want in (
        (suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")), {k: v[1] for k, v in brute_bytes([(i, t) for i, (_, t) in enumerate(distinct)], 100).items()}),
        (substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")), {k: v[1] for k, v in brute_words([(i, t) for i, (_, t) in enumerate(distinct)], 50).items()}),
    ):
        found = sorted((x.doc_id is not None, x.doc_id or 0, x.n_removed) for x in got.collect())
        assert found == sorted((d is not None, d or 0, want[distinct.index((d, t))]) for d, t in rows)


@pytest.mark.parametrize("rows", [1, 3, 10])
def test_names_across_batches(spark, monkeypatch, rows):
    """Batches so small that one name's rows span many of them."""
    monkeypatch.setattr("corpusloom.llm.common.BATCH_ROWS", rows)
    r = random.Random(rows)
    line = "".join(r.choices("abcd ", k=60))
    texts = [line + "".join(r.choices("abcd ", k=80)) + r.choice(["", line * 2]) for _ in range(25)] + [line * 3] * 12 + hard_texts(5)[:25]
    pairs = [(3 * i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    want = brute_bytes(pairs, 40)
    assert {x.doc_id: (x.n_bytes, x.n_removed, len(x.spans), bytes(x.kept)) for x in suffix_dedup.remove_repeats(df, 40, 16).collect()} == want
    want = brute_words(pairs, 8)
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in substring_dedup.remove_repeats(df, 8, 4, 3, 1).collect()} == want


def test_names():
    s = np.random.default_rng(0).integers(0, 3, 300, dtype=np.uint8)
    for n in (8, 16, 32):
        names = repeats.names_at(s, n)
        assert len(names) == 300 - n + 1
        by = {}
        for i, x in enumerate(names.tolist()):
            by.setdefault(x, set()).add(s[i : i + n].tobytes())
        assert all(len(x) == 1 for x in by.values()) and len(by) == len({s[i : i + n].tobytes() for i in range(300 - n + 1)})


def test_index_in_two_sessions(spark, tmp_path):
    """Batches added by one session and by another that opens the folder give what all batches at once give."""
    pairs = [(3 * i, t) for i, t in enumerate(hard_texts(9))]
    df = spark.createDataFrame(pairs, "doc long, text string").repartition(4)
    want = {d: {k for k in range(n_words) if gone[k]} for d, (n_words, gone) in brute_gone(pairs, 8).items()}
    path, got = f"file://{tmp_path}/index", {}
    for k, (low, high) in enumerate([(-1, 40), (40, 75), (75, 120), (120, 10_000)]):
        index = substring_dedup.FingerprintIndex(spark if k % 2 else spark.newSession(), path, 8, 4)
        assert index.generation == k and index.last == (None if not k else max(d for d, _ in pairs if d <= low))
        batch = df.filter(f"doc > {low} and doc <= {high}")
        for r in index.update(batch, df.filter(f"doc <= {high}")).collect():
            got[r.doc] = {w for x in r.ranges for w in range(x["first"], x["last"] + 8)}
    assert {d: got.get(d, set()) for d in want} == want
    assert max(level for level, *_ in index.tables["heads"]) >= 2
    with pytest.raises(ValueError):
        substring_dedup.FingerprintIndex(spark, path, 9, 4)


def brute_gone(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone, own = [False] * len(w), []
        for i in range(len(w) - length + 1):
            own.append(tuple(w[i : i + length]))
            if own[-1] in seen:
                gone[i : i + length] = [True] * length
        seen.update(own)
        out[d] = (len(w), gone)
    return out


def test_index_tables_do_not_move(spark, tmp_path):
    """The join of a batch with the index shuffles the batch only."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(hard_texts(4)) if t], "doc long, text string")
    index = substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/index", 8, 4, fanout=9, buckets=8)
    index.add(df.filter("doc < 30"))
    left = index._dealt(repeats.runs_of(df, index.scheme)).groupBy("name").count()
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = left.join(index._heads()[0].select("name", "several"), "name", "left")
        joined.count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan.replace("Bucketed: false", "") or "SelectedBucketsCount" in plan


def test_queries_by_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    sign = lambda b: hashlib.sha256(b).hexdigest()
    out = suffix_dedup.op1_suffix_array_dedup(spark, d)
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    assert {tuple(r) for r in out.collect()} == {(i, n, gone, spans, sign(kept)) for i, (n, gone, spans, kept) in brute_bytes(rows, 100).items()}
    out = substring_dedup.op3_substring_dedup(spark, d)
    assert out.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()} == {(i, n, gone, sign(kept.encode())) for i, (n, gone, kept) in brute_words(rows, 50).items()}


def test_very_long_text(spark):
    """A text of ten million characters among short ones."""
    r = random.Random(2)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(5000)]
    long_ = " ".join(r.choices(words, k=1_400_000))
    rows = [(1, long_[5_000_000:5_000_900]), (2, long_), (3, "short"), (4, long_[7_000_000:7_000_900])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in suffix_dedup.remove_repeats(df).select("doc_id", "n_removed").collect()}
    assert got[1] == 0 and got[2] >= 900 and got[4] == 900
    got = {x.doc_id: x.n_removed for x in substring_dedup.remove_repeats(df).select("doc_id", "n_removed").collect()}
    assert got[2] >= 120 and got[4] >= 120
