"""Toxicity by compression distance: every window of a text is compressed with a zstandard dictionary trained on toxic text and with one trained on ordinary text, and the differences in length are held against calibrated evidence.

Training takes a bounded sample of labelled rows (``SAMPLE`` of each label, texts of at most ``MAX_SAMPLE_CHARS`` characters, lowest hash first), two thirds for the dictionaries, one third for calibration. The sample's texts are first parted by their pairs of bytes into ``CLUSTERS`` clusters, which follow language and script; each cluster that holds enough rows of both labels has a pair of dictionaries of its own, so that what is telling in a rare language isn't outweighed by a common one, and other texts share a pair made from all. A dictionary is filled as zstandard's own trainer fills it, greedily with the segments that cover the most frequent fragments not yet covered; fragments are weighted by the share of toxic documents that surely hold them and by how much rarer they are in ordinary text, so that both dictionaries don't spend themselves on what all texts share. Both end with the same ordinary text and have the same size, so that a window's two lengths differ by what is particular to a label. Calibration gives each difference a log-likelihood ratio in its cluster, and a logistic regression over their sums and peaks gives the score.

Scoring is a map over whole texts with a model of a few kilobytes: no shuffle, bounded memory.

Defined results: a null or empty text is one empty window and gets its score; without both labels in the sample every score is the share of toxic rows (0 if there are none); labels other than 0 and 1 are ignored, rows labelled both ways count as 1; repeated rows stay; an empty table gives an empty result; input columns named score or predicted are replaced.
"""

from __future__ import annotations

import heapq
import pickle
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import bounded_sample, crc_fold, map_batches, table, texts_of

#: Bounds of the training sample: rows of each label, characters of a text.
SAMPLE, MAX_SAMPLE_CHARS = {1: 2500, 0: 5000}, 32_768
WINDOW, FRAGMENT, OWN_BYTES, SHARED_BYTES, LEAST_GAIN, CONTRAST, CLIP = 48, 5, 1024, 1024, 0.03, 4.0, 16
#: Clusters of texts; rows of each label below which a cluster has no pair of its own; width of the byte-pair profile; standard deviations by which a count is taken lower; rows that smooth a ratio.
CLUSTERS, FEW, PROFILE, DOUBT, SMOOTH = 5, 8, 1024, 2.0, 2.0
#: The pair made from all texts.
ALL = -1
THRESHOLD = 0.3
_SPACES = bytes.maketrans(b"\n\t\r\x0b\x0c", b"     ")


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The text in lower case, cut at the first space after ``size`` bytes, or after four times as many."""
    t = _plain(text)
    out, at, last = [], 0, len(t) - 1
    while at < last:
        end = t.find(b" ", at + size, at + 4 * size)
        if end < 0:
            end = min(at + 4 * size, last)
        out.append(t[at : end + 1])
        at = end
    return out


def _fragments(t: bytes) -> set[bytes]:
    return {t[i : i + FRAGMENT] for i in range(len(t) - FRAGMENT + 1)}


def train_dictionary(texts: list[bytes], gain: dict[bytes, float], size: int, least: float, trim: bool) -> bytes:
    """At most ``size`` bytes (and one segment) of words of ``texts`` whose fragments gain the most, each fragment counted once; the best come last, where matches are cheapest."""
    words = Counter(w for t in texts for w in set(t.split()))
    found = {b" " + w + b" ": None for w, n in sorted(words.items()) if n > 1 and len(w) < 40}
    found = {w: x for w in found if (x := sorted(g for g in _fragments(w) if gain.get(g, 0) > least))}
    heap = [(-sum(map(gain.get, x)), w) for w, x in found.items()]
    heapq.heapify(heap)
    covered: set[bytes] = set()
    out: list[bytes] = []
    n = 0
    while heap and n < size:
        _, w = heapq.heappop(heap)
        new = [g for g in found[w] if g not in covered]
        worth = -sum(map(gain.get, new))
        if not new:
            continue
        if heap and worth > heap[0][0]:
            heapq.heappush(heap, (worth, w))
            continue
        segment = w[min(map(w.find, new)) : max(map(w.find, new)) + FRAGMENT] if trim else w
        out.append(segment)
        n += len(segment)
        covered.update(new)
    return b"".join(reversed(out))


def _plain(text: bytes) -> bytes:
    return b" " + text.lower().translate(_SPACES) + b" "


def profiles(texts: list[bytes]) -> np.ndarray:
    """Each text's pairs of adjacent bytes, hashed to ``PROFILE`` counts, as square roots of unit length; texts under two bytes are zero."""
    out = np.zeros((len(texts), PROFILE), np.float32)
    for row, t in zip(out, texts, strict=True):
        if len(t) > 1:
            b = np.frombuffer(t, np.uint8).astype(np.int64)
            row[:] = np.sqrt(np.bincount((b[:-1] * 37 + b[1:]) % PROFILE, minlength=PROFILE) / (len(b) - 1))
    return out


def clusters(x: np.ndarray, k: int, rounds: int = 25, starts: int = 8) -> np.ndarray:
    """At most ``k`` centres of the unit vectors ``x`` by spherical k-means, the best of ``starts`` fixed starts."""
    best, centres = -1.0, x[:0]
    for seed in range(starts):
        c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(rounds):
            of = np.argmax(x @ c.T, axis=1)
            new = np.array([x[of == j].mean(axis=0) if (of == j).any() else c[j] for j in range(len(c))])
            new /= np.linalg.norm(new, axis=1, keepdims=True) + 1e-9
            still = np.allclose(new, c, atol=1e-5)
            c = new
            if still:
                break
        if (fit := float((x @ c.T).max(axis=1).sum())) > best:
            best, centres = fit, c
    return centres


def train_pair(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes] | None:
    """The toxic and the ordinary dictionary of these texts; None where no fragment tells the labels apart."""
    one, none = list(map(_plain, toxic)), list(map(_plain, ordinary))
    documents = Counter(g for t in one for g in _fragments(t))
    sure = {g: n for g, n in documents.items() if n > DOUBT**2}
    often = [Counter(g for t in texts for i in range(len(t) - FRAGMENT + 1) if (g := t[i : i + FRAGMENT]) in sure) for texts in (one, none)]
    rarer = sum(map(len, one)) / max(1, sum(map(len, none)))
    gain = {g: (n - DOUBT * n**0.5) / len(one) * (1 - CONTRAST * rarer * often[1][g] / often[0][g]) for g, n in sure.items()}
    own = train_dictionary(one, gain, OWN_BYTES, LEAST_GAIN, True)
    if not own:
        return None
    common = {g: n / len(none) for g, n in Counter(g for t in none for g in _fragments(t)).items() if n > 1}
    plain = train_dictionary(none, common, SHARED_BYTES + len(own), 0.0005, False)
    shared = plain[-SHARED_BYTES:]
    return own + shared, plain[:-SHARED_BYTES][-len(own) :].rjust(len(own)) + shared


@dataclass
class Model:
    """Centres of the clusters; for each that has them, and for ``ALL``, dictionaries and log-likelihood ratios of the differences; weights of the features; without dictionaries a constant."""

    centres: np.ndarray | None = None
    pairs: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    ratios: dict[int, np.ndarray] = field(default_factory=dict)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    constant: float = 0.0

    def groups(self, texts: list[bytes]) -> list[int]:
        """The pair by which each text is compared."""
        if not texts:
            return []
        return [j if j in self.pairs else ALL for j in np.argmax(profiles(texts) @ self.centres.T, axis=1).tolist()]

    def compressors(self) -> dict[int, tuple]:
        p = zstandard.ZstdCompressionParameters(window_log=15, hash_log=13, chain_log=13, search_log=4, min_match=4, strategy=zstandard.STRATEGY_LAZY2, target_length=16, write_content_size=0, write_checksum=0, write_dict_id=0)
        return {j: tuple(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p).compress for d in pair) for j, pair in self.pairs.items()}

    def features(self, d: np.ndarray, group: int) -> list[float]:
        r = self.ratios[group][d]
        high = np.sort(d)[-3:] - CLIP
        return [r.sum() / len(d) ** 0.5, r.max(), np.log(len(d)), high[-1], r.mean(), r[r > 0.3].sum() / len(d), np.log1p((r > 0.7).sum()), (r > 0.7).mean(), high.mean()]

    def score(self, texts: list[bytes], compressors: dict[int, tuple]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.constant)
        x = np.array([self.features(differences(t, *compressors[j]), j) for t, j in zip(texts, self.groups(texts), strict=True)])
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + (x - self.mean) / self.scale @ self.weights[1:], -30, 30)))


def differences(text: bytes, toxic, ordinary) -> np.ndarray:
    """For each window, how many bytes the toxic dictionary saves against the ordinary one, clipped and moved to 0..2 * CLIP."""
    d = [len(ordinary(w)) - len(toxic(w)) for w in windows(text)]
    return np.clip(d, -CLIP, CLIP) + CLIP


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    z, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge * w)
    return w


def train(rows: list[tuple[bytes, int]], share: float) -> Model:
    """``rows``: texts and labels, in a stable order; ``share``: of toxic ones among all labelled rows."""
    raw = {k: [t for t, x in rows if x == k] for k in (0, 1)}
    if min(map(len, raw.values())) < 3:
        return Model(constant=share)
    cut = {k: 2 * len(raw[k]) // 3 for k in raw}
    spread = {k: profiles(raw[k]) for k in raw}
    m = Model(clusters(np.concatenate([spread[1], spread[0]]), CLUSTERS))
    near = {k: np.argmax(spread[k] @ m.centres.T, axis=1).tolist() for k in raw}
    for j in (ALL, *range(len(m.centres))):
        toxic, ordinary = ([t for t, c in zip(raw[k][: cut[k]], near[k]) if j in (c, ALL)] for k in (1, 0))
        if (j == ALL or min(len(toxic), len(ordinary)) >= FEW) and (pair := train_pair(toxic, ordinary)):
            m.pairs[j] = pair
    if not m.pairs:
        return Model(constant=share)
    m.pairs.setdefault(ALL, next(iter(m.pairs.values())))
    by = m.compressors()
    held = [(differences(t, *by[j]), k, j) for k in raw for t, j in zip(raw[k][cut[k] :], m.groups(raw[k][cut[k] :]), strict=True)]
    for j in m.pairs:
        seen = np.full((2, 2 * CLIP + 1), SMOOTH)
        for d, k, at in held:
            if j in (at, ALL):
                np.add.at(seen[k], d, 1)
        m.ratios[j] = np.diff(np.log(seen / seen.sum(axis=1, keepdims=True)), axis=0)[0]
    x, y = np.array([m.features(d, j) for d, _, j in held]), np.array([k for _, k, _ in held], float)
    m.mean, m.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    m.weights = _logistic((x - m.mean) / m.scale, y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    return m


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), of which only the given rows are used. Of several texts of one doc_id it takes the one of the lowest hash."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not sum(count.values()):
        return Model()
    picked = [bounded_sample(known.filter(f"toxic = {k}"), n) for k, n in sorted(sample.items())]
    ids = F.broadcast(picked[0].union(picked[1]))
    texts = docs.select("doc_id", "text").filter(F.length("text") <= MAX_SAMPLE_CHARS).join(ids, "doc_id")
    one = texts.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    rows = one.select(F.md5(F.col("doc_id").cast("string").cast("binary")).alias("o"), "doc_id", "text", "toxic").collect()
    return train([(r.text.encode(), r.toxic) for r in sorted(rows)], count.get(1, 0) / sum(count.values()))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 where score >= threshold)."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    at, packed = kept.index("text"), pickle.dumps(model.__dict__)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        m = Model(**pickle.loads(packed))
        s = np.round(m.score(texts_of(b.column(at)), m.compressors()), 6)
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    ddl = ", ".join(f"`{n}` {t}" for n, t in docs.select(kept).dtypes)
    return map_batches(docs.select(kept), f, f"{ddl}, score double, predicted int")


FOLDS, HELD = 4, 2


def _model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return fit(docs, table(spark, sf_dir, "labels").filter(crc_fold("doc_id", FOLDS) != HELD))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 9 over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, _model(spark, docs, sf_dir))
    return scored.select("doc_id", (crc_fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", "predicted")


def keep_ordinary(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that a model trained on the rows of ``labels`` (outside the held-out fold) rejects."""
    model = fit(docs, labels.filter(crc_fold("doc_id", FOLDS) != HELD))
    return score(docs, model, threshold).filter("predicted = 0").select(docs.columns)
