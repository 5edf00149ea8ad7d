"""Operators 2, 9 and 10: held-out accuracy, brute force for what is fixed, and edges."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from corpusloom.llm import language, pii, toxicity
from corpusloom.llm.common import sample_by, table
from tests.llm.small import documents, empty

DIR = "/root/testdata/sf0.1"


def test_language_held_out(spark):
    got = language.op2_language_id(spark, DIR).join(table(spark, DIR, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == table(spark, DIR, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r.lang == r.lang_pred for r in got if r.held_out]
    assert sum(held) / len(held) > 0.97


def test_language_backs_off():
    model = language.train([("aa", "kato kato mela mela kato"), ("aa", "mela katu"), ("bb", "zwirx zwirx zwolx plun plun"), ("bb", "zwolx")] * 3)
    s = language.Scorer(model)
    assert s.predict("kato")[0] == "aa" and s.predict("zwirx zwolx")[0] == "bb"
    assert s.predict("katomel")[0] == "aa" and s.predict("zwirxy")[0] == "bb"
    assert np.argmax(s.word("zw")) == 1 and np.argmax(s.word("k")) == 0
    for t in (None, "", "12 34 -- _", " \n"):
        assert s.predict(t) == ("und", 0.0)
    assert language.Scorer(language.train([])).predict("abc") == ("und", 0.0)


def test_language_scores_by_brute_force(spark):
    """Scores of whole texts by the model's tables, straight from the method's definition."""
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    model = language.fit(docs.filter("pmod(crc32(cast(doc_id as string)), 3) <> 1"))
    tables, names = [dict(zip(k, v.astype(float), strict=True)) for k, v in model["tables"]], model["languages"]

    def word(w):
        if w in tables[0]:
            return tables[0][w] - tables[0][w].max()
        for n in range(5, 0, -1):
            grams = [g for g in ([f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)] if n > 1 else list(w)) if g in tables[n]]
            if grams:
                x = sum(tables[n][g] for g in grams) / len(grams)
                return x - x.max()
        return np.zeros(len(names))

    texts = {r.doc_id: r.text for r in docs.collect()}
    out = language.op2_language_id(spark, d)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    for r in out.collect():
        words = re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower())
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = sum(map(word, words)) * min(1, 12 / len(words))
        share = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert share[names.index(r.lang_pred)] == pytest.approx(share.max(), abs=1e-9) and r.score == pytest.approx(share.max(), abs=2e-6)


def test_rare_language_is_learned(spark):
    rows = [(i, "zug weiß ganz viel " * 3 if i % 1000 == 7 else f"the cat sat {i} on mats", "rare" if i % 1000 == 7 else "often") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.lang, r.lang_pred) for r in language.predict(df, language.fit(df)).select("lang", "lang_pred").distinct().collect()}
    assert got == {("rare", "rare"), ("often", "often")}
    assert {r.lang: r["count"] for r in sample_by(df, "lang", 50).groupBy("lang").count().collect()} == {"often": 50, "rare": 1}


def test_language_edges(spark):
    df, rows = documents(spark)
    out = language.predict(df.withColumnRenamed("size", "score"), language.fit(df))
    assert out.count() == len(rows) and out.columns[-2:] == ["lang_pred", "score"]
    assert {r.lang_pred for r in language.predict(df, language.fit(empty(spark))).collect()} == {"und"}
    assert language.predict(empty(spark), language.fit(df)).count() == 0


def auc(y, s):
    s = np.array(s)
    _, inverse, n = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[inverse]
    y = np.array(y) == 1
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_toxicity_held_out(spark):
    got = toxicity.op9_toxicity(spark, DIR).join(table(spark, DIR, "labels"), "doc_id", "left").join(table(spark, DIR, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == table(spark, DIR, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    # the other languages: test_toxicity_languages.py
    held = [r for r in got if r.held_out and r.toxic is not None and r.lang == "en"]
    assert auc([r.toxic for r in held], [r.score for r in held]) > 0.93


def test_toxicity_edges(spark):
    df, rows = documents(spark)
    for labels in ([], [(0, 1), (3, 0), (None, 1), (6, None), (0, 0), (9, 7)]):
        known = spark.createDataFrame(labels, "doc_id long, toxic int")
        out = toxicity.score(df.withColumnRenamed("h", "predicted"), toxicity.fit(df, known)).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(empty(spark), toxicity.Model()).count() == 0
    for t in (b"", b"a", b"x" * 1000, b"ab " * 300):
        w = toxicity.windows(t)
        assert (b"".join(x[:-1] for x in w) + b" ") == b" " + t + b" " or len(w) > 1 and all(len(x) <= 4 * 48 + 1 for x in w)


def brute_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


HARD = ["a@b.c@d.e x@@y.z _@a.b- a@-.-", "a@b.co_x@y.zz", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3.256", "00001.2.3.4 1..2.3.4", "4785380592391139 4785-3805 92391139", "+1 (523) 555-1055+2 99 ++3 333 333 333", "é 1.1.1.1 é@é.de a.b@x.y.", "+12", "@", "a@b", "1" * 5000, "1." * 400, "٣.٣.٣.٣", "a" * 3000 + "@b.c"]


def test_base_spans():
    r = np.random.default_rng(4)
    texts = HARD + ["".join(r.choice(list("a1.@+- 9()2é"), 80)) for _ in range(1500)]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.fit(table(spark, DIR, "documents"))


def test_network_finds_spans_and_adds_few(spark, tagger):
    texts = [r.text for r in table(spark, DIR, "documents").filter("doc_id % 7 = 3").select("text").collect()]
    found = pii.all_spans(tagger, texts)
    base = sum(len(b) for b, _ in found)
    assert base > 20 and all(set(b) <= set(s) for b, s in found) and sum(len(s) for _, s in found) - base <= 0.05 * base + 2
    own = {i: set(pii.read_spans(texts[i], tags)) for i, tags in pii.tag_texts(tagger, texts)}
    hit = sum(x in own.get(i, ()) for i, (b, _) in enumerate(found) for x in b)
    assert hit > 0.9 * base


def test_network_knows_other_forms(tagger):
    """Recall by kind, of forms that the patterns don't know, in a text and with numbers that training hasn't seen."""
    r = np.random.default_rng(11)
    made = [pii.written_form(r) for _ in range(1500)]
    texts = [(k, f"onre the thing of and {form} heat thion anre") for k, form in made]
    new = [(k, t) for k, t in texts if k >= 0 and not pii.base_spans(t)]
    found = [any(x == k for _, x, _ in spans) for (k, _), (_, spans) in zip(new, pii.all_spans(tagger, [t for _, t in new]), strict=True)]
    for kind in range(4):
        own = [f for (k, _), f in zip(new, found, strict=True) if k == kind]
        print(f"FIGURE {pii.KINDS[kind]}: {sum(own)} of {len(own)}")
        assert len(own) > 20 and sum(own) > 0.9 * len(own), pii.KINDS[kind]
    others = [t for k, t in texts if k < 0]
    assert sum(len(s) for _, s in pii.all_spans(tagger, others)) <= 0.03 * len(others)


def test_one_path_through_the_whole_text(tagger):
    """Where windows overlap, scores are their weighted mean; the path is the best of all paths, found here by trying all."""
    r = np.random.default_rng(2)
    e = r.normal(0, 2, (4, pii.TAGS))
    moves, best = tagger.p["moves"], (-np.inf, None)
    for path in itertools.product(range(pii.TAGS), repeat=4):
        steps = (0, *path, 0)
        value = sum(e[i, t] for i, t in enumerate(path)) + sum(moves[a, b] for a, b in zip(steps, steps[1:]))
        best = max(best, (value, path))
    assert tuple(tagger.paths([e, e[:3]])[0]) == best[1]
    text = "x" * 50 + " mail ann.b7@example.org now " + "y" * 90 + " 12 " + "z" * 200
    ks = pii.zones(text)
    w = tagger.window_scores(pii.window_codes(pii.codes(text), ks))
    for start, s in pii._stretches(ks, w, len(text)):
        for at in range(start, start + len(s)):
            over = [(min(t + 1, 64 - t), w[j, t]) for j, k in enumerate(ks) if 0 <= (t := at - (k * 32 - 16)) < 64]
            assert np.allclose(s[at - start], sum(a * x for a, x in over) / sum(a for a, _ in over))
    assert [x for _, x in pii.all_spans(tagger, [text, "", "no"])] == [pii.base_spans(text), [], []]


def test_gradient():
    r = np.random.default_rng(0)
    t = pii.Tagger()
    x, y = r.integers(0, 130, (6, 3)), r.integers(0, 9, (6, 3))
    _, g = t.gradient(x, y)
    for name, p in t.p.items():
        i = (x[0, 0], 1) if name == "embed" else tuple(r.integers(0, s) for s in p.shape)
        was, e = p[i], 1e-5
        p[i] = was + e
        up = t.gradient(x, y)[0]
        p[i] = was - e
        down = t.gradient(x, y)[0]
        p[i] = was
        assert (up - down) / (2 * e) == pytest.approx(g[name][i], abs=1e-5)


def test_pii_rows(spark, tagger):
    texts = [None, "", *HARD]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as spans")
    got = {r.doc_id: r.spans for r in pii.find_spans(df, tagger).collect()}
    for i, t in enumerate(texts):
        assert [(s.start, pii.KINDS.index(s.kind), s.end) for s in got[i] if s.base] == brute_spans(t or "")
    assert pii.find_spans(empty(spark), tagger).count() == 0
    out = pii.op10_pii(spark, "/root/testdata/sf0.001").collect()
    for r, t in ((r, t.text) for r in out for t in [next(x for x in table(spark, "/root/testdata/sf0.001", "documents").collect() if x.doc_id == r.doc_id)][:1] if r.doc_id < 20):
        b = brute_spans(t)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in b).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in b) for j in range(4))
