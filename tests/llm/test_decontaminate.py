import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate
from tests.llm.small import empty
from tests.oracle import differences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(text, items):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for i, t in items:
        w = WORD.findall(lower(t))
        size = min(13, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == w[k : k + size]:
                    hit.update(range(at, at + size))
                    found.add(str(i))
    return len(words), hit, sorted(found), words


def make(spark):
    r = random.Random(3)
    v = ["".join(r.choices("abcé0", k=r.randint(1, 4))) for _ in range(60)]
    say = lambda k: [r.choice(v) for _ in range(k)]
    items = [(i, " ".join(say(r.choice([1, 4, 13, 14, 30])))) for i in range(12)] + [(12, None), (13, ""), (14, "..."), (None, "Zq zq"), (2, "again twice")]
    docs = [None, "", "--", "zq, ZQ"]
    for i in range(80):
        w = say(r.randint(1, 80))
        if i % 2:
            w[len(w) // 2 : len(w) // 2] = (r.choice(items)[1] or "").upper().split()
        docs.append("".join(x + r.choice([" ", ", ", "\n", "--"]) for x in w))
    return items, docs


@pytest.mark.parametrize("max_chars", [100, 8 << 20])
def test_against_brute_force(spark, max_chars):
    items, docs = make(spark)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(df, bench, max_chars=max_chars).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, found, words = brute(r.text, [("" if i is None else i, t) for i, t in items])
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (n, len(hit), found, len(hit) > 0 and 20 * len(hit) >= n)
        covered = [w for s in r.spans for w in WORD.findall(lower(r.text[s.start : s.end]))]
        assert covered == [words[i] for i in sorted(hit)]


def test_empty_tables(spark):
    items, docs = make(spark)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.find_contamination(empty(spark), bench).count() == 0
    none = decontaminate.find_contamination(spark.createDataFrame([(1, docs[5])], "doc_id long, text string"), bench.limit(0)).first()
    assert none.n_hit == 0 and not none.contaminated and none.n_words == len(WORD.findall(lower(docs[5])))
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_one_build_for_each_worker_and_part(spark, monkeypatch):
    """Four parts' worth of benchmark: the same rows as from one, and an index is built once however many batches a scan has."""
    items, docs = make(spark)
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(docs * 4)), "doc_id long, text string").coalesce(1)
    chars = sum(len(t or "") for _, t in items)
    assert len(list(decontaminate.benchmark_parts(bench, -(-chars // 4)))) == 4
    sort = lambda out: sorted(map(repr, out.collect()))
    assert sort(decontaminate.find_contamination(df, bench, max_chars=-(-chars // 4))) == sort(decontaminate.find_contamination(df, bench))
    built = []
    monkeypatch.setattr(decontaminate, "Index", lambda *a: built.append(a))
    for key in ("a", "a", "b", "b", "b"):
        decontaminate._index(key, [], 13)
    assert len(built) == 2


def test_shared_starts_and_bytes_that_are_no_utf8():
    phrase = "which of these is the one that holds the most water for all"
    index = decontaminate.Index([(str(k), f"{phrase} {k} or {k + 1} yes".encode()) for k in range(500)])
    n, runs, items = index.scan(f"x {phrase} 77 or 78 yes".encode())
    assert n == 18 and items >= {"77"} and runs[-1][1] == 18
    assert index.scan(b"\xff\xfe " + phrase.encode() + b" 3 or \xff")[0] == 17
    assert decontaminate._char_spans("é, ab é".encode(), [(0, 1), (2, 3)]) == [{"start": 0, "end": 1}, {"start": 6, "end": 7}]


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.001"
    out = decontaminate.op8_benchmark_decontamination(spark, d)
    assert out.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean")]
    assert not differences(out, decontaminate.ORACLE_SQL, d)


def test_more_words_than_characters():
    """An index of 1,120,000 different words; each would need a symbol of its own."""
    item = " ".join(f"{k:06d}" for k in range(1_120_000)).encode()
    index = decontaminate.Index([("long", item), ("short", b"000001 000002"), ("other", b"1112064 000004")])
    assert index.shared
    at = lambda k, n: " ".join(f"{i:06d}" for i in range(k, k + n)).encode()
    assert index.scan(at(1_119_980, 13)) == (13, [(0, 13)], {"long"})
    assert index.scan(at(5, 12)) == (12, [], set())
    assert index.scan(b"x 000001 000002 y")[1:] == ([(1, 3)], {"short"})


def test_words_that_share_symbols_give_the_same():
    """With five symbols for all words, against one for each."""
    r = random.Random(8)
    words = [f"w{k}" for k in range(30)]
    items = [(f"i{k}", " ".join(r.choices(words, k=r.choice([1, 2, 5, 12, 13, 14, 40]))).encode()) for k in range(40)]
    one, few = decontaminate.Index(items), decontaminate.Index(items, symbols=5)
    for _ in range(300):
        text = " ".join([*r.choices(words, k=r.randint(0, 20)), *r.choice(items)[1].decode().split()[: r.randint(0, 40)], *r.choices(words, k=3)]).encode()
        assert [decontaminate._merged(x.scan(text)[1]) for x in (one, few)][0] == decontaminate._merged(few.scan(text)[1]) and one.scan(text)[2] == few.scan(text)[2]
