import hashlib
import math
import statistics
import struct
import zlib

import numpy as np
import pytest

from corpusloom.llm import media
from tests.llm.small import documents, empty


@pytest.mark.parametrize("channels", [None, 2, 3, 4])
@pytest.mark.parametrize("row_filter", [None, *range(5)])
def test_round_trip(row_filter, channels):
    r = np.random.default_rng(row_filter or 9)
    for h, w in ((1, 1), (7, 5), (40, 33)):
        p = r.integers(0, 256, (h, w) if channels is None else (h, w, channels), dtype=np.uint8)
        assert (media.decode_png(media.encode_png(p, row_filter)).reshape(p.shape) == p).all()


def test_broken_media_is_told(spark):
    good = media.encode_png(np.zeros((4, 4), np.uint8))
    bad = [None, b"", good[:20], good[:-6], good[:30] + bytes([good[30] ^ 1]) + good[31:], b"x" + good[1:]]
    df = spark.createDataFrame([(i, m) for i, m in enumerate([good, *bad])], "id long, media binary")
    got = {r.id: r for r in media.describe_images(df.selectExpr("*", "'clash' AS feature")).collect()}
    assert got[0].error is None and got[0].payload_bytes == 16
    assert all(got[i].error and got[i].payload_bytes is None for i in range(1, 1 + len(bad)))


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(w, h, raw, head=None):
    return media.SIGNATURE + chunk(b"IHDR", head or struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_wrong_headers_and_sizes(spark):
    bad = [png(0, 3, b"\0\0\0"), png(3, 0, b""), png(4, 1, bytes(5), head=b"short"), png(4, 1, bytes(4)), png(4, 1, bytes(10_000_000)), png(1 << 31, 1 << 31, bytes(5)), png(4, 1, b"\x07abcd"), media.SIGNATURE + chunk(b"IEND", b"")]
    got = media.describe_images(spark.createDataFrame(list(enumerate(bad)), "id long, media binary")).collect()
    assert len(got) == len(bad) and all(r.error and r.payload_bytes is None for r in got)


def plain_feature(payload):
    """The hash by its definition, without numpy: averages of 32 x 32 boxes, a cosine transform, the median."""
    h, w = len(payload) // 64, 64

    def box(n, k):
        a, b = n * k / 32, n * (k + 1) / 32
        return {i: min(i + 1, b) - max(i, a) for i in range(int(a), min(n, int(b) + 1)) if min(i + 1, b) > max(i, a)}

    small = [[sum(payload[y * w + x] * p * q for y, p in box(h, i).items() for x, q in box(w, j).items()) * 32 * 32 / h / w for j in range(32)] for i in range(32)]
    cos = lambda k, x: math.cos(math.pi * (2 * x + 1) * k / 64)
    low = [round(sum(small[y][x] * cos(u, y) * cos(v, x) for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = statistics.median(low[1:])
    return "".join(f"{int(''.join(str(int(x > middle)) for x in low[k : k + 8]), 2):02x}" for k in range(0, 64, 8))


def test_query_by_brute_force(spark):
    """Rows are unfiltered, and the features are those of the definition; coefficients next to the median may fall either way."""
    d = "/root/testdata/sf0.001"
    out = media.op6_media_columns(spark, d)
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string")]
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    kinds = set()
    for r in out.collect():
        p = media.payload_of(texts[r.doc_id])
        stored = media.encode_png(np.frombuffer(p, np.uint8).reshape(-1, 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        kinds |= set(zlib.decompress(stored[41:-16])[::65])
        if r.doc_id < 12:
            assert (int(r.feature, 16) ^ int(plain_feature(p), 16)).bit_count() <= 2
    assert kinds == {0, 1, 2}


def test_texts(spark):
    df, rows = documents(spark)
    got = media.describe_images(media.text_images(df)).collect()
    want = []
    for i, t, _ in rows:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by.values())
    assert media.describe_images(media.text_images(empty(spark))).count() == 0


def test_like_images_have_near_hashes():
    a = np.kron(np.random.default_rng(2).integers(0, 256, (8, 8)), np.ones((10, 8))).astype(np.uint8)
    b = np.clip(a.astype(int) + np.random.default_rng(0).integers(-6, 7, a.shape), 0, 255).astype(np.uint8)
    c = np.random.default_rng(1).integers(0, 256, a.shape, dtype=np.uint8)
    near, far = (int(media.dct_hash(a), 16) ^ int(media.dct_hash(o), 16) for o in (b, c))
    assert near.bit_count() < 12 < far.bit_count()
