"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark texts, each document scanned once, with the hits mapped back to words and characters of the original.

The automaton reads words, not characters: each word of the benchmark has a symbol, all others share one (where an index has more words than there are characters, words share symbols too, and every hit is compared by the words' numbers). A window is ``size`` consecutive words of an item; an item of fewer words, but not none, is one window. Of the longer items the automaton holds seeds: (size + 1) / 2 words from every place that is a multiple of that number. Each window holds a whole seed, so that every document word that a window may hit lies near a seed's hit; the few windows of the document around it are then looked up by a 64-bit name among all windows and compared word by word. So the automaton has about one state for each word of the benchmark, not ``size`` of them.

The index follows the benchmark, not the corpus, and its size is checked: up to ``MAX_CHARS`` characters of benchmark text are broadcast as one index. A larger benchmark is dealt into parts; each is scanned by itself, one broadcast at a time, and gives rows for those texts alone that it hits, which are then joined back by the texts' hash. An index is built once in each worker and scan.

Words are runs of digits, letters a-z (after A-Z are lowered) and characters beyond ASCII.

Defined results: a null text has no words and no hits; a null item_id counts as the text ``""``; repeated items or documents count each by itself (equal item_ids once); an empty benchmark hits nothing; an empty table gives an empty result; other columns are ignored; a text that isn't valid UTF-8 is read byte by byte, any byte beyond ASCII belonging to a word.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import columns_ddl, map_batches, materialize, table, texts_of

WINDOW, SHARE = 13, 20
MAX_CHARS = 8 << 20

_SEPARATORS = [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_NORMAL = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_NORMAL = bytes(_NORMAL[i] if _NORMAL[i] not in _SEPARATORS else 0x20 for i in range(256))
_ORIGINAL_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: How many indexes this process has built.
BUILT = 0


def words_of(text: bytes) -> list[bytes]:
    """The normalised words of a UTF-8 text."""
    return text.translate(_NORMAL).split()


#: Characters that can stand for words: all but 0, for words that the benchmark lacks, and surrogates.
SYMBOLS = 0x110000 - 0x800 - 1


def _symbol(k: int, symbols: int = SYMBOLS) -> str:
    """The symbol of the ``k``-th word, from 1. Beyond ``symbols`` words they share them, and what is found is only a place to look at."""
    k = 1 + (k - 1) % symbols
    return chr(k if k < 0xD800 else k + 0x800)


class Index:
    """The windows of some items (name, text), and the automaton that finds where they may occur."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW, symbols: int = SYMBOLS):
        global BUILT
        BUILT += 1
        self.size, seed = size, (size + 1) // 2
        texts = [words_of(t) for _, t in items]
        self.names = [n for n, _ in items]
        self.numbers = {w: k for k, w in enumerate(sorted({w for ws in texts for w in ws}), 1)}
        self.symbols = {w: _symbol(k, symbols) for w, k in self.numbers.items()}
        self.shared = len(self.numbers) > symbols
        self.short = {}  # of items that are one window: their words' numbers
        patterns: dict[str, set[int]] = {}
        arrays, places, owners = [], [], []
        at = 0
        for i, ws in enumerate(texts):
            s = "".join([self.symbols[w] for w in ws])
            if 0 < len(s) < size:
                patterns.setdefault(s, set()).add(i)
                self.short[i] = self.codes(ws).tolist()
            elif s:
                for k in range(0, len(s) - seed + 1, seed):
                    patterns.setdefault(s[k : k + seed], set()).add(-1)
                arrays.append(self.codes(ws))
                places.append(np.arange(at, at + len(s) - size + 1))
                owners.append(np.full(len(s) - size + 1, i))
                at += len(s)
        self.text = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
        # windows by name; of equal windows all owners, and one place
        names = self.window_names(self.text, np.concatenate(places)) if places else np.empty(0, np.uint64)
        place, owner = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (places, owners))
        order = np.argsort(names, kind="stable")
        self.window, self.place, self.owner = names[order], place[order], owner[order]
        self.automaton = ahocorasick.Automaton()
        for s, found in patterns.items():
            self.automaton.add_word(s, (len(s), -1 in found, [k for k in found if k >= 0]))
        if patterns:
            self.automaton.make_automaton()

    def codes(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, 0 for those that the benchmark lacks."""
        return np.fromiter((self.numbers.get(w, 0) for w in words), np.uint64, len(words))

    def window_names(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        x = np.zeros(len(starts), np.uint64)
        for k in range(self.size):
            x = (x ^ (x >> np.uint64(29))) * _FACTOR + text[starts + k]
        return x

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words; the runs of words hit (first, end exclusive), sorted; the items that occur."""
        words = words_of(text)
        if not len(self.automaton) or not words:
            return len(words), [], set()
        get = self.symbols.get
        symbols = "".join([get(w, "\0") for w in words])
        runs, items, seeds = [], set(), []
        for end, (n, is_seed, whole) in self.automaton.iter(symbols):
            if is_seed:
                seeds.append(end + 1 - n)
            if whole and self.shared:
                here = self.codes(words[end + 1 - n : end + 1]).tolist()
                whole = [k for k in whole if self.short[k] == here]
            if whole:
                runs.append((end + 1 - n, end + 1))
                items.update(whole)
        if seeds:
            at = np.array(seeds)[:, None] - np.arange(self.size - (self.size + 1) // 2 + 1)
            at = np.unique(at[(at >= 0) & (at <= len(words) - self.size)])
            coded = self.codes(words)
            names = self.window_names(coded, at)
            lo, hi = np.searchsorted(self.window, names, "left"), np.searchsorted(self.window, names, "right")
            span = np.arange(self.size)
            for start, a, b in zip(at[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                same = (self.text[self.place[a:b, None] + span] == coded[start : start + self.size]).all(axis=1)
                if same.any():
                    runs.append((start, start + self.size))
                    items.update(self.owner[a:b][same].tolist())
        return len(words), sorted(runs), {self.names[k] for k in items}


def benchmark_parts(benchmark: DataFrame, max_chars: int = MAX_CHARS):
    """Yields lists of (item_id, text) of about ``max_chars`` characters, dealt by hash: all items, each once."""
    items = benchmark.selectExpr("coalesce(cast(item_id as string), '') i", "coalesce(cast(text as string), '') t").distinct()
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, -(-chars // max_chars))
    for k in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).collect() if parts > 1 else items.collect()
        yield parts, [(r.i, r.t.encode()) for r in sorted(rows)]


_INDEXES: dict[str, Index] = {}


def _index(key: str, items: list[tuple[str, bytes]], size: int) -> Index:
    """The index of a part, built once in each worker; a worker keeps that of the scan it is at."""
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(items, size)
    return _INDEXES[key]


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _char_spans(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """The character spans of runs of words in the original text, in one walk over it."""
    if not runs:
        return []
    starts = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # characters that begin up to each byte
    at = [m.span() for m in _ORIGINAL_WORD.finditer(text)]
    return [{"start": int(starts[at[i][0]]) - 1, "end": int(starts[at[j - 1][1] - 1])} for i, j in runs]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_NEW = {"n_words": ("long", pa.int64()), "n_hit": ("long", pa.int64()), "items": ("array<string>", pa.list_(pa.string())), "spans": ("array<struct<start:long,end:long>>", _SPAN), "contaminated": ("boolean", pa.bool_())}


def _judged(texts: list[bytes], found: list[tuple[int, list, set]], share: int) -> list[pa.Array]:
    """The new columns, from number of words, runs and items of each text."""
    rows = []
    for t, (n, runs, items) in zip(texts, found, strict=True):
        runs = _merged(runs)
        n_hit = sum(j - i for i, j in runs)
        rows.append((n, n_hit, sorted(items), _char_spans(t, runs), n_hit > 0 and share * n_hit >= n))
    columns = zip(*rows, strict=True) if rows else [[]] * len(_NEW)
    return [pa.array(list(c), k) for c, (_, k) in zip(columns, _NEW.values(), strict=True)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = SHARE, max_chars: int = MAX_CHARS) -> DataFrame:
    """All columns of ``docs`` and n_words, n_hit, items (sorted strings), spans (array of the character spans of the hit runs in the original text) and contaminated (n_hit > 0 and share * n_hit >= n_words).

    The input columns may have any names beside ``text``; the five new ones replace columns of the same names.
    """
    context = docs.sparkSession.sparkContext
    kept = docs.select([c for c in docs.columns if c not in _NEW])
    at, names = kept.columns.index("text"), [*kept.columns, *_NEW]
    ddl = ", ".join([columns_ddl(kept), *(f"{n} {t}" for n, (t, _) in _NEW.items())])
    hits = []
    for parts, items in benchmark_parts(benchmark, max_chars):
        key, shared = uuid.uuid4().hex, context.broadcast(items)

        def scan(texts: list[bytes], key=key, shared=shared) -> list:
            return list(map(_index(key, shared.value, size).scan, texts))

        if parts == 1:

            def whole(b: pa.RecordBatch) -> pa.RecordBatch:
                texts = texts_of(b.column(at))
                return pa.RecordBatch.from_arrays([*b.columns, *_judged(texts, scan(texts), share)], names)

            return map_batches(kept, whole, ddl)

        def hit(b: pa.RecordBatch, scan=scan) -> pa.RecordBatch | None:
            found = [(sign, runs, sorted(items)) for sign, (_, runs, items) in zip(b.column(1).to_pylist(), scan(texts_of(b.column(0))), strict=True) if runs]
            if not found:
                return None
            sign, runs, items = zip(*found, strict=True)
            spans = [[{"start": i, "end": j} for i, j in _merged(r)] for r in runs]
            return pa.RecordBatch.from_arrays([pa.array(sign, pa.string()), pa.array(spans, _SPAN), pa.array(list(items), pa.list_(pa.string()))], ["sign", "runs", "items"])

        signed = kept.select(F.col("text").cast("string").alias("text"), _sign("text").alias("sign"))
        hits.append(materialize(map_batches(signed, hit, "sign string, runs array<struct<start:long,end:long>>, items array<string>").dropDuplicates(["sign"])))
        shared.unpersist()
    by_text = reduce(DataFrame.union, hits).groupBy("sign").agg(F.flatten(F.collect_list("runs")).alias("_runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("_items"))
    joined = kept.withColumn("_sign", _sign("text")).join(by_text, F.col("_sign") == F.col("sign"), "left").select(*kept.columns, "_runs", "_items")

    n = len(kept.columns)

    def put_together(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(b.column(at))
        runs = [[(r["start"], r["end"]) for r in x or []] for x in b.column(n).to_pylist()]
        found = [(len(words_of(t)), r, set(i or [])) for t, r, i in zip(texts, runs, b.column(n + 1).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*b.columns[:n], *_judged(texts, found, share)], names)

    return map_batches(joined, put_together, ddl)


def _sign(column: str):
    return F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 8 over all documents and all benchmark items."""
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Windows of items and of documents as texts, and their equality.
ORACLE_SQL = rf"""WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS_SQL} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS n, array_to_string(w[k : k + least({WINDOW}, len(w)) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
dw AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)"""
