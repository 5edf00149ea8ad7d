"""Language identification by words first, backing off to shorter and shorter character n-grams.

Training takes a bounded sample of rows with a language (``SAMPLE_DOCS`` different texts of each language, of at most ``MAX_SAMPLE_CHARS`` characters, lowest hash first, so that a rare language gets as many as a frequent one) and keeps, for each language, the log frequency of its words and of the 5- to 1-grams of its words. A known word is scored by its own log frequencies. An unseen word is scored by the mean log frequency of its n-grams of the greatest length of which the sample knows any. A text's language is the one with the highest sum; its score is that language's share of the posterior, with the sum scaled to at most ``EVIDENCE`` words so that it stays a probability and not a count of words.

Words are runs of letters, in lower case. Prediction is a map over whole texts with a model bounded by the sample: no shuffle. A worker remembers the scores of ``CACHE`` words, and those of one more text.

Defined results: ``und`` with score 0 for a null text, one without letters, and all texts where nothing was learned; ties go to the first language by code point; repeated rows stay; an empty table gives an empty result; input columns named lang_pred or score are replaced.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import columns_ddl, crc_fold, map_batches, sample_by, table

#: Bounds of the training sample (texts of each language, characters of a text), and thereby of the model.
SAMPLE_DOCS, MAX_SAMPLE_CHARS = 1500, 20_000
LONGEST, EVIDENCE, CACHE, SMOOTH = 5, 12, 200_000, 0.5
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)] if n > 1 else list(word)


def train(rows: list[tuple[str, str]]) -> dict:
    """``rows``: language and text. The model: languages; a row of log frequencies for each word (seen at least twice) and n-gram."""
    languages = sorted({lang for lang, _ in rows})
    counts: list[dict[str, Counter]] = [{} for _ in range(LONGEST + 1)]  # by length, 0: words
    for lang, text in rows:
        own = Counter(words_of(text))
        counts[0].setdefault(lang, Counter()).update(own)
    for lang, own in counts[0].items():
        for n in range(1, LONGEST + 1):
            c = counts[n].setdefault(lang, Counter())
            for w, k in own.items():
                for g in grams_of(w, n):
                    c[g] += k
    model: dict = {"languages": languages, "tables": []}
    for by in counts:
        total = Counter()
        for c in by.values():
            total.update(c)
        known = sorted(x for x, k in total.items() if k > 1)
        table_ = np.array([[by.get(lang, {}).get(x, 0) for lang in languages] for x in known], float).reshape(len(known), len(languages))
        sums = np.array([sum(by.get(lang, {}).values()) for lang in languages], float)
        logs = np.log((table_ + SMOOTH) / (sums + SMOOTH * (len(known) + 1)))
        model["tables"].append((known, logs.astype(np.float32)))
    return model


class Scorer:
    """A model with its lookups, and the scores of words met before: a row of ``scores`` for each word of ``rows``."""

    def __init__(self, model: dict):
        self.languages = model["languages"]
        self.tables = [dict(zip(known, map(tuple, logs.tolist()), strict=True)) for known, logs in model["tables"]]
        self.rows: dict[str, int] = {}
        self.scores = np.empty((1024, len(self.languages)))

    def word(self, w: str) -> list[float]:
        """A word's score in each language, less the highest."""
        found = self.tables[0].get(w)
        n = LONGEST
        while found is None and n:
            known = self.tables[n]
            if met := [known[g] for g in grams_of(w, n) if g in known]:
                found = [sum(x) / len(met) for x in zip(*met, strict=True)]
            n -= 1
        if found is None:
            return [0.0] * len(self.languages)
        top = max(found)
        return [x - top for x in found]

    def row(self, w: str) -> int:
        """The row of a word, made if need be."""
        k = self.rows.get(w)
        if k is None:
            k = self.rows[w] = len(self.rows)
            if k == len(self.scores):
                self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
            self.scores[k] = self.word(w)
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text and self.languages else []
        if not words:
            return UNKNOWN, 0.0
        if len(self.rows) > CACHE:
            self.rows.clear()
        at = list(map(self.rows.get, words))
        if None in at:
            at = [self.row(w) if k is None else k for w, k in zip(words, at, strict=True)]
        total = self.scores[at].sum(axis=0) * min(1.0, EVIDENCE / len(words))
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def fit(docs: DataFrame) -> dict:
    """A model of ``docs`` (text, lang), of which rows without text or language are left out."""
    usable = docs.filter(F.col("lang").isNotNull() & (F.length("text") <= MAX_SAMPLE_CHARS)).select("lang", "text")
    return train(sorted((r.lang, r.text) for r in sample_by(usable, "lang", SAMPLE_DOCS).collect()))


_SCORERS: dict[str, Scorer] = {}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred and score."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at, key = kept.index("text"), uuid.uuid4().hex
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(pickle.loads(packed.value))
        found = [_SCORERS[key].predict(t) for t in b.column(at).to_pylist()]
        made = [pa.array([x for x, _ in found], pa.string()), pa.array([round(x, 6) for _, x in found], pa.float64())]
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), *made], [*kept, "lang_pred", "score"])

    return map_batches(docs.select(kept), f, f"{columns_ddl(docs.select(kept))}, lang_pred string, score double")


FOLDS, HELD = 3, 1


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 2 over all documents."""
    docs, held = table(spark, sf_dir, "documents"), crc_fold("doc_id", FOLDS) == HELD
    model = fit(docs.filter(~held))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
