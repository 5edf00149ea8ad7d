"""Small document tables for brute force: nulls, empty and long texts, copies, near copies, ties, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("size", T.StringType()), ("h", T.LongType()))])


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeéü", k=r.randint(1, 7))) for _ in range(300)]
    say = lambda k: " ".join(r.choices(vocabulary, k=k))
    out: list[str | None] = [None, "", " \n\t", "one", "Two words", "a a a a a a a a"]
    passage, line = say(70), say(9)
    for i in range(n):
        t = say(r.randint(1, 160))
        if i % 5 == 0:
            t = f"{line}\n{t}"
        if i % 7 == 0:
            t = f"{t[: len(t) // 2]} {passage} {t[len(t) // 2 :]}"
        out.append(t)
    out += [out[10], out[10], out[12] + " x", out[20].replace("a", "A"), passage, passage + " " + passage, "ab " * 400, "x" * 700, say(3000), "ß" * 250]
    return out


def documents(spark, seed: int = 1):
    ts = texts(seed)
    rows = [(i * 3 % 101, t, "en" if i % 2 else None, None if i % 11 == 0 else f"s{i % 4}", len(t or ""), "clash", i) for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), [(r[0], r[1], r[3]) for r in rows]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
