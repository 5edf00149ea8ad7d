"""Personal data: fixed patterns, and beyond them a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

The labels come from the patterns, over a bounded sample of documents (``SAMPLE_DOCS`` texts of at most ``MAX_SAMPLE_CHARS`` characters that hold a digit or ``@``, lowest hash first), and from written forms that the patterns don't know, put into windows of the same texts. A window has ``WINDOW`` characters and overlaps its neighbours by half. Windows are scored by the network one by one; where they overlap, a character's scores are their mean, weighted by its distance from each window's edges, and one Viterbi path is then taken through the whole text, so that neither a span nor a path is cut at a window's edge. Every kind holds a digit or ``@``, and what the network adds must hold one too: windows without either can't add a span, so their characters are outside of all by definition, and the path need not be computed there.

What the network adds must hold the digits that its kind asks for (Luhn's test for cards) and touch no span of the patterns, which always stay.

A map over whole texts with a model of some kilobytes: no shuffle; at most ``BATCH`` windows and a text's own are scored together.

Defined results: a null text counts as empty and has no spans; repeated rows stay; without any labelled text in the sample the network is trained on the written forms alone; an empty table gives an empty result; input columns named spans are replaced.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import bounded_sample, columns_ddl, map_batches, table

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, MAX_SAMPLE_CHARS, SAMPLE_WINDOWS, FORMS, EPOCHS = 1500, 20_000, 700, 1500, 8
WINDOW, STEP, BATCH = 64, 32, 1024
EMBED, HIDDEN, TAGS = 12, 16, 1 + 2 * len(KINDS)
LETTER, PAD, SYMBOLS = 128, 129, 130

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Luhn's test."""
    double = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(double) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _emails(text: str):
    """Leftmost emails. The part before each ``@`` is read backwards, so that long words are not scanned again from each of their characters."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str):
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern spans, by start, then kind; code points, end exclusive."""
    if not _TRIGGER.search(text):
        return []
    return sorted((a, k, b) for k, find in enumerate((_emails, _ips, _cards, _phones)) for a, b in find(text))


def codes(text: str) -> np.ndarray:
    """A symbol number for each character: ASCII as it is, all others one symbol."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), LETTER).astype(np.int32)


def zones(text: str) -> np.ndarray:
    """Numbers of the windows to decode: those that hold a digit or ``@``. Window k spans STEP * k - STEP / 2 and the WINDOW characters from there; the STEP characters from STEP * k are its own."""
    p = np.array([m.start() for m in _TRIGGER.finditer(text)], np.int64)
    k = np.unique(np.concatenate([(p - STEP // 2) // STEP, p // STEP, (p + STEP // 2) // STEP]))
    return k[(k >= 0) & (k * STEP < len(text))]


def window_codes(c: np.ndarray, ks: np.ndarray) -> np.ndarray:
    """The symbols of windows ``ks`` of a text with symbols ``c``, padded beyond its ends."""
    at = ks[:, None] * STEP - STEP // 2 + np.arange(WINDOW)
    return np.where((at >= 0) & (at < len(c)), c[np.clip(at, 0, len(c) - 1)], PAD)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class Tagger:
    """The network. Parameters: embeddings; input, state and bias weights of both directions; output layer; transitions between tags."""

    def __init__(self, params: dict[str, np.ndarray] | None = None, seed: int = 7):
        r = np.random.default_rng(seed)
        shapes = {"embed": (SYMBOLS, EMBED), "out": (2 * HIDDEN, TAGS), "out_bias": (TAGS,), "moves": (TAGS, TAGS)}
        for d in "fb":
            shapes |= {f"x_{d}": (EMBED, 4 * HIDDEN), f"h_{d}": (HIDDEN, 4 * HIDDEN), f"bias_{d}": (4 * HIDDEN,)}
        self.p = params or {k: r.normal(0, 0.3 if k == "embed" else 1 / max(s[0], 8) ** 0.5, s) * (len(s) > 1) for k, s in sorted(shapes.items())}

    def _direction(self, x, d, keep):
        """Hidden states (T, B, HIDDEN) of one direction over symbols x (T, B), and what its gradient needs."""
        p = self.p
        table = p["embed"] @ p[f"x_{d}"] + p[f"bias_{d}"]
        order = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        h, c = np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
        hs, saved = np.empty((*x.shape, HIDDEN)), {}
        for t in order:
            z = table[x[t]] + h @ p[f"h_{d}"]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before = (h, c)
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            hs[t] = h
            if keep:
                saved[t] = (i, f, o, g, tc, *before)
        return hs, saved

    def scores(self, x, keep=False):
        f, sf = self._direction(x, "f", keep)
        b, sb = self._direction(x, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["out"] + self.p["out_bias"], both, {"f": sf, "b": sb}

    def window_scores(self, windows: np.ndarray) -> np.ndarray:
        """The scores (B, T, TAGS) of windows (B, T) of symbols."""
        parts = [self.scores(np.ascontiguousarray(windows[i : i + BATCH].T))[0].transpose(1, 0, 2) for i in range(0, len(windows), BATCH)]
        return np.concatenate(parts)

    def paths(self, stretches: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each of some stretches (T, TAGS) of scores, with nothing tagged before and after. Stretches of like length go together."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(stretches)
        groups: dict[int, list[int]] = {}
        for i, s in enumerate(stretches):
            groups.setdefault(len(s).bit_length(), []).append(i)
        moves = self.p["moves"]
        for rows in groups.values():
            n = np.array([len(stretches[i]) for i in rows])
            e = np.full((n.max(), len(rows), TAGS), -1e6, moves.dtype)
            e[:, :, 0] = 0
            for k, i in enumerate(rows):
                e[: n[k], k] = stretches[i]
            best, back = moves[0] + e[0], np.empty((len(e), len(rows), TAGS), np.int8)
            for t in range(1, len(e)):
                all_ = best[:, :, None] + moves
                back[t] = all_.argmax(axis=1)
                best = all_.max(axis=1) + e[t]
            tags, k = np.empty((len(e), len(rows)), np.int64), np.arange(len(rows))
            tags[-1] = (best + moves[:, 0]).argmax(axis=1)
            for t in range(len(e) - 1, 0, -1):
                tags[t - 1] = back[t, k, tags[t]]
            for j, i in enumerate(rows):
                out[i] = tags[: n[j], j]
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood of tags y (T, B) for symbols x (T, B), for each window, and its gradient."""
        p, (n, m) = self.p, x.shape
        e, both, saved = self.scores(x, True)
        moves = p["moves"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, n):
            alpha[t] = _lse(alpha[t - 1][:, :, None] + moves, 1) + e[t]
        for t in range(n - 2, -1, -1):
            beta[t] = _lse(moves + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _lse(alpha[-1], 1)
        rows = np.arange(m)
        gold = sum(e[t, rows, y[t]].sum() + (moves[y[t - 1], y[t]].sum() if t else 0) for t in range(n))
        de = np.exp(alpha + beta - total[:, None])
        np.add.at(de, (np.arange(n)[:, None], rows, y), -1)
        pair = np.exp(alpha[:-1, :, :, None] + moves + (e[1:] + beta[1:])[:, :, None, :] - total[:, None, None]).sum(axis=(0, 1))
        np.add.at(pair, (y[:-1], y[1:]), -1)
        de /= m
        g = {"moves": pair / m, "out": np.einsum("tbh,tbk->hk", both, de), "out_bias": de.sum(axis=(0, 1)), "embed": np.zeros_like(p["embed"])}
        dboth = de @ p["out"].T
        for d, part in (("f", dboth[:, :, :HIDDEN]), ("b", dboth[:, :, HIDDEN:])):
            order = range(n - 1, -1, -1) if d == "f" else range(n)
            dh, dc, dz = np.zeros((m, HIDDEN)), np.zeros((m, HIDDEN)), np.empty((n, m, 4 * HIDDEN))
            dw = np.zeros_like(p[f"h_{d}"])
            for t in order:
                i, f, o, gg, tc, h0, c0 = saved[d][t]
                dh = dh + part[t]
                dc = dc + dh * o * (1 - tc * tc)
                z = dz[t]
                z[:, :HIDDEN] = dc * gg * i * (1 - i)
                z[:, HIDDEN : 2 * HIDDEN] = dc * c0 * f * (1 - f)
                z[:, 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
                z[:, 3 * HIDDEN :] = dc * i * (1 - gg * gg)
                dw += h0.T @ z
                dh, dc = z @ p[f"h_{d}"].T, dc * f
            by_symbol = np.zeros((SYMBOLS, 4 * HIDDEN))
            np.add.at(by_symbol, x.ravel(), dz.reshape(-1, 4 * HIDDEN))
            g |= {f"h_{d}": dw, f"bias_{d}": by_symbol.sum(axis=0), f"x_{d}": p["embed"].T @ by_symbol}
            g["embed"] += by_symbol @ p[f"x_{d}"].T
        return float(total.sum() - gold) / m, g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.015, seed: int = 7) -> list[float]:
        """Trains on windows x (N, T) with tags y by Adam; the mean loss of each epoch."""
        r, losses, k = np.random.default_rng(seed), [], 0
        m1, m2 = ({n: np.zeros_like(v) for n, v in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order, found = r.permutation(len(x)), []
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                loss, g = self.gradient(np.ascontiguousarray(x[rows].T), np.ascontiguousarray(y[rows].T))
                found.append(loss)
                k += 1
                size = np.sqrt(sum((v * v).sum() for v in g.values()))
                for n, v in g.items():
                    v = v * min(1.0, 5.0 / max(size, 1e-9))
                    m1[n] = 0.9 * m1[n] + 0.1 * v
                    m2[n] = 0.999 * m2[n] + 0.001 * v * v
                    self.p[n] = self.p[n] - rate * (1 - 0.7 * epoch / max(1, epochs - 1)) * (m1[n] / (1 - 0.9**k)) / (np.sqrt(m2[n] / (1 - 0.999**k)) + 1e-8)
            losses.append(float(np.mean(found)))
        return losses


def written_form(r: np.random.Generator) -> tuple[int, str]:
    """A kind (-1: none, a string that only looks like one) and a string of it, in a form that the patterns know or one that they don't."""
    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    word = lambda: "".join(r.choice(list("abcdefghijklmnoprstuvw"), r.integers(3, 9)))
    pick = lambda *x: x[r.integers(len(x))]
    kind = int(r.integers(-1, 4))
    if kind == 0:
        at, dot = pick("@", "@", "@", " @ "), pick(".", ".", ".", " . ")
        return 0, f"{word()}{pick('', '.' + d(2), '_' + word())}{at}{word()}{pick('', d(1))}{dot}{pick('example' + dot, '')}{pick('com', 'org', 'net', 'de')}"
    if kind == 1:
        return 1, pick(".", ".", "[.]").join(str(n) for n in r.integers(0, 256, 4))
    if kind == 2:
        n = int(r.choice([13, 15, 16, 16, 16, 19]))
        body = str(r.integers(3, 7)) + d(n - 2)
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        return 2, pick("", "", "-", " ", ".", "/").join(digits[i : i + 4] for i in range(0, n, 4))
    if kind == 3:
        a, b, c = d(3), d(3), d(4)
        return 3, pick(f"+{r.integers(1, 99)} ({a}) {b}-{c}", f"+{r.integers(1, 99)}{a}{b}{c}", f"+{r.integers(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}")
    return -1, pick(d(r.integers(1, 9)), f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", f"v{d(1)}.{d(1)}.{d(2)}", f"${d(3)}.{d(2)}", "".join(r.choice(list("0123456789abcdef"), int(r.integers(12, 40)))), f"@{word()}", f"{word()}{d(2)}")


def labelled_windows(texts: list[str], n: int = SAMPLE_WINDOWS, forms: int = FORMS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Windows of symbols and their tags: of ``texts`` with the spans of the patterns, up to ``n``; and those of ``forms`` written forms."""
    r = np.random.default_rng(seed)

    def tagged(text: str, spans) -> tuple[np.ndarray, np.ndarray]:
        c, y = codes(text), np.zeros(len(text), np.int32)
        for a, k, b in spans:
            if not y[a:b].any():
                y[a:b] = 2 + 2 * k
                y[a] = 1 + 2 * k
        ks = zones(text)
        at = ks[:, None] * STEP - STEP // 2 + np.arange(WINDOW)
        return window_codes(c, ks), np.where((at >= 0) & (at < len(c)), y[np.clip(at, 0, len(c) - 1)], 0)

    real = [tagged(t, base_spans(t)) for t in texts if t and _TRIGGER.search(t)]
    plain = " ".join(t[:400] for t in texts[:200] if t) or "lorem ipsum dolor sit amet " * 20
    made = []
    for _ in range(forms):
        kind, form = written_form(r)
        a = int(r.integers(0, max(1, len(plain) - 200)))
        before, after = _TRIGGER.sub("x", plain[a : a + int(r.integers(0, 60))]), _TRIGGER.sub("x", plain[a + 100 : a + 160])
        left, right = (str(r.choice([" ", " ", "\n", " (", ", "])), str(r.choice([" ", " ", ".", ", ", ")", "\n"])))
        text = before + left + form + right + after
        start = len(before) + len(left)
        made.append(tagged(text, [(start, kind, start + len(form))] if kind >= 0 else []))
    xs, ys = (np.concatenate([p[i] for p in real] or [np.zeros((0, WINDOW), np.int32)]) for i in (0, 1))
    if len(xs) > n:
        # all windows with spans first, so far as the bound allows
        order = np.lexsort((r.random(len(xs)), ~ys.any(axis=1)))[: n]
        spans = ys[order].any(axis=1)
        if spans.sum() > 2 * n // 3:
            order = np.concatenate([order[spans][: 2 * n // 3], r.permutation(np.flatnonzero(~ys.any(axis=1)))[: n // 3]])
        xs, ys = xs[order], ys[order]
    mx, my = (np.concatenate([p[i] for p in made]) for i in (0, 1))
    return np.concatenate([xs, mx]), np.concatenate([ys, my])


def _accept(kind: int, s: str) -> bool:
    digits = _NOT_DIGIT.sub("", s)
    if kind == 0:
        return s.count("@") == 1 and s[0] != "@" and "." in s.split("@")[1] and s[-1].isalnum() and not _NOT_DIGIT.sub("", s) == s
    if kind == 1:
        parts = _NOT_DIGIT.split(s)
        return len(parts) == 4 and all(p and len(p) < 4 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits) and 2 * len(digits) > len(s)
    return 9 <= len(digits) <= 15 and len(digits) < len(s) <= 2 * len(digits) and not any(c.isalpha() for c in s)


def read_spans(text: str, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the spans that ``tags`` (one for each character) mark; blank ends are cut off."""
    out, at = [], np.flatnonzero(tags)
    for run in np.split(at, np.flatnonzero((np.diff(at) > 1) | ((tags[at[1:]] + 1) // 2 != (tags[at[:-1]] + 1) // 2) | (tags[at[1:]] % 2 == 1)) + 1) if len(at) else []:
        a, b = int(run[0]), int(run[-1]) + 1
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, int(tags[run[0]] + 1) // 2 - 1, b))
    return out


#: How much a character's scores in a window count, by its distance from the edges.
_EDGE = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW))


def _stretches(ks: np.ndarray, e: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """The overlapping scores ``e`` (windows, WINDOW, TAGS) of a text of ``n`` characters as one: for each run of neighbouring windows ``ks`` where it starts, and the scores of its characters."""
    out = []
    for run in np.split(np.arange(len(ks)), np.flatnonzero(np.diff(ks) > 1) + 1):
        first, size = int(ks[run[0]]) * STEP - STEP // 2, len(run) * STEP + WINDOW - STEP
        sums, weight = np.zeros((size, TAGS), e.dtype), np.zeros(size, e.dtype)
        for shift in (0, 1):  # windows of one parity lie side by side, those of the other overlap them
            some = run[shift::2]
            at = shift * STEP
            sums[at : at + len(some) * WINDOW] += (e[some] * _EDGE[:, None].astype(e.dtype)).reshape(-1, TAGS)
            weight[at : at + len(some) * WINDOW] += np.tile(_EDGE, len(some))
        low, high = max(0, first + STEP // 2), min(n, first + size - STEP // 2)
        out.append((low, sums[low - first : high - first] / weight[low - first : high - first, None]))
    return out


def tag_texts(tagger: Tagger, texts: list[str]):
    """For each text that has windows to score, its index and a tag for each of its characters."""
    queue: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush():
        e = tagger.window_scores(np.concatenate([w for _, _, w in queue]))
        at, placed = 0, []
        for i, ks, w in queue:
            placed += [(i, start, s) for start, s in _stretches(ks, e[at : at + len(w)], len(texts[i]))]
            at += len(w)
        found: dict[int, np.ndarray] = {i: np.zeros(len(texts[i]), np.int64) for i, _, _ in queue}
        for (i, start, s), tags in zip(placed, tagger.paths([s for _, _, s in placed]), strict=True):
            found[i][start : start + len(s)] = tags
        yield from found.items()

    n = 0
    for i, text in enumerate(texts):
        if len(ks := zones(text)):
            queue.append((i, ks, window_codes(codes(text), ks)))
            n += len(ks)
        if n >= BATCH:
            yield from flush()
            queue, n = [], 0
    if queue:
        yield from flush()


def all_spans(tagger: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """For each text its pattern spans and all spans, both (start, kind, end) by start, then kind."""
    out = []
    for t in texts:
        base = base_spans(t)
        out.append((base, list(base)))
    for i, tags in tag_texts(tagger, texts):
        base, spans = out[i]
        for a, k, b in read_spans(texts[i], tags):
            if _accept(k, texts[i][a:b]) and all(b <= x or y <= a for x, _, y in base):
                spans.append((a, k, b))
        spans.sort()
    return out


def fit(docs: DataFrame) -> Tagger:
    """A network trained on the bounded sample of ``docs`` (doc_id, text) that the module's docstring names."""
    usable = docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= MAX_SAMPLE_CHARS))
    picked = bounded_sample(usable, SAMPLE_DOCS)
    x, y = labelled_windows([r.text for r in picked.collect()])
    tagger = Tagger()
    tagger.fit(x, y)
    return tagger


def find_spans(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """``docs`` with spans: an array of (kind, start, end, base), by start, then kind; base marks those of the patterns."""
    kept = [c for c in docs.columns if c != "spans"]
    at, packed = kept.index("text"), pickle.dumps({k: v.astype(np.float32) for k, v in tagger.p.items()})
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        found = all_spans(Tagger(pickle.loads(packed)), [t or "" for t in b.column(at).to_pylist()])
        rows = [[{"kind": KINDS[k], "start": x, "end": y, "base": (x, k, y) in base} for x, k, y in spans] for base, spans in ((set(p), q) for p, q in found)]
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(rows, kind)], [*kept, "spans"])

    return map_batches(docs.select(kept), f, f"{columns_ddl(docs.select(kept))}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 10 over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, fit(docs)).drop("text")
    base = F.filter("spans", lambda s: s.base)
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    of_kind = lambda k: F.filter("spans", lambda s: s.base & (s.kind == k))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
