"""Media columns: lossless PNG images in binary columns, their chunks tested by checksum, rows unfiltered in numpy, and a hash of their low-frequency cosine-transform coefficients.

Each document is one image of its own, so nothing is shuffled and a task holds one Arrow batch (its bytes are bounded). A row of an image is filtered by what it is: unfiltering undoes runs of rows of one kind.

Defined results: a null text counts as empty; an empty text is one row of zero bytes; equal texts give equal values; repeated rows stay; an empty table gives an empty result; other columns are ignored, in ``describe_images`` kept unless a new one has the name. ``describe_images`` gives a row with ``error`` set, not a failure, for null or broken media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import columns_ddl, map_batches, table, texts_of

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by PNG colour type (8 bits each): grey, RGB, grey + alpha, RGBA.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
WIDTH = 64
SIDE, LOW = 32, 8
#: A picture of more bytes is told as broken, whatever its header says; the largest text that a row can hold is below.
MAX_BYTES = 1 << 32


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _predict(kind: int, left, up, corner):
    """What a PNG filter subtracts from a sample (int16 arrays of one shape)."""
    if kind == 1:
        return left
    if kind == 2:
        return up
    if kind == 3:
        return (left + up) >> 1
    d_left, d_up, d_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
    return np.where((d_left <= d_up) & (d_left <= d_corner), left, np.where(d_up <= d_corner, up, corner))


def _filtered(p: np.ndarray, kind: int) -> np.ndarray:
    """All rows of ``p`` with one filter."""
    if kind == 0:
        return p
    out = p.copy()
    if kind == 1:
        out[:, 1:] -= p[:, :-1]
    elif kind == 2:
        out[1:] -= p[:-1]
    else:
        wide = np.zeros((p.shape[0] + 1, p.shape[1] + 1, p.shape[2]), np.int16)
        wide[1:, 1:] = p
        out[:] = (p - _predict(kind, wide[1:, :-1], wide[:-1, 1:], wide[:-1, :-1])) & 255
    return out


def _cost(rows: np.ndarray) -> np.ndarray:
    """For each row the sum of its filtered samples, taken as signed: what small differences make small."""
    return np.abs(rows.view(np.int8).astype(np.int16)).sum(axis=(1, 2), dtype=np.int64)


def encode_png(pixels: np.ndarray, row_filter: int | None = None, level: int = 6) -> bytes:
    """``pixels`` (height x width, or x channels, uint8) as a PNG. Every row gets ``row_filter`` (0 none, 1 left, 2 up, 3 average, 4 Paeth); without one, each row gets that of the first three which makes its differences smallest, as PNG's standard advises."""
    p = np.ascontiguousarray(pixels[:, :, None] if pixels.ndim == 2 else pixels)
    h, w, c = p.shape
    raw = np.empty((h, 1 + w * c), np.uint8)
    if row_filter is not None:
        raw[:, 0], raw[:, 1:] = row_filter, _filtered(p, row_filter).reshape(h, -1)
    else:
        raw[:, 0], raw[:, 1:], best = 0, p.reshape(h, -1), _cost(p)
        for kind in (1, 2):
            rows = _filtered(p, kind)
            cost = _cost(rows)
            better = cost < best
            raw[better, 0], raw[better, 1:], best[better] = kind, rows[better].reshape(-1, w * c), cost[better]
    colour = {n: k for k, n in CHANNELS.items()}[c]
    head = struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """rows: height x width x channels, filtered. A run of rows of one kind 0, 1 or 2 is undone at once, other rows sample by sample."""
    h, w, c = rows.shape
    out, above = np.empty_like(rows), np.zeros((w, c), np.uint8)
    starts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), h], strict=True):
        kind = int(kinds[a])
        if kind == 0:
            out[a:b] = rows[a:b]
        elif kind == 1:
            np.cumsum(rows[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            np.cumsum(rows[a:b], axis=0, dtype=np.uint8, out=out[a:b])
            out[a:b] += above
        elif kind in (3, 4):
            for y in range(a, b):
                left, corner, up = np.zeros(c, np.int16), np.zeros(c, np.int16), above.astype(np.int16)
                for x in range(w):
                    left = (rows[y, x] + _predict(kind, left, up[x], corner)) & 255
                    out[y, x], corner = left, up[x]
                above = out[y]
        else:
            raise ValueError(f"row filter {kind}")
        above = out[b - 1]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The pixels of an 8-bit PNG without interlace, height x width x channels. ValueError where a checksum, a length or the format is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, head, ended = 8, [], None, False
    while not ended:
        if at + 12 > len(data):
            raise ValueError("cut short")
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            if n != 13:
                raise ValueError("header of a wrong length")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended, at = kind == b"IEND", at + 12 + n
    if head is None or head[2] != 8 or head[3] not in CHANNELS or any(head[4:]):
        raise ValueError("unsupported format")
    w, h, c = head[0], head[1], CHANNELS[head[3]]
    size = h * (1 + w * c)
    if not w or not h or size > MAX_BYTES:
        raise ValueError("no or too many samples")
    try:
        # no more is unpacked than the header tells
        unpack = zlib.decompressobj()
        raw = unpack.decompress(b"".join(packed), size + 1)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != size or not unpack.eof:
        raise ValueError("wrong length")
    a = np.frombuffer(raw, np.uint8).reshape(h, 1 + w * c)
    return _unfilter(a[:, 0], a[:, 1:].reshape(h, w, c))


def _shrink(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with axis 0 averaged into ``n`` bins of equal width. Whole rows between the bins' edges are summed as they are, so that nothing of the array's size is made."""
    x = np.linspace(0, a.shape[0], n + 1)
    lo = np.minimum(x.astype(np.int64), a.shape[0] - 1)
    whole = np.array([a[i:j].sum(axis=0, dtype=np.float64) for i, j in zip(lo[:-1], lo[1:], strict=True)])
    edge = (x - lo)[:, None] * a[lo]
    return (whole + np.diff(edge, axis=0)) * (n / a.shape[0])


_k = np.arange(SIDE)
_COS = np.cos(np.pi * (2 * _k[None, :] + 1) * _k[:LOW, None] / (2 * SIDE))


def dct_hash(pixels: np.ndarray) -> str:
    """64 bits as hex: which of the 8 x 8 lowest cosine coefficients of the image, averaged to 32 x 32 grey samples, exceed their median."""
    # rows first, then channels, then columns: all three are averages
    flat = _shrink(pixels.reshape(pixels.shape[0], -1), SIDE)
    grey = flat.reshape(SIDE, pixels.shape[1], -1).mean(axis=2)
    small = _shrink(grey.T, SIDE).T
    low = np.round(_COS @ small @ _COS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def payload_of(text: bytes) -> bytes:
    """``text`` with zero bytes up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % WIDTH or (0 if text else WIDTH))


def text_images(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a grey PNG, 64 samples wide."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(b.column(1))
        media = [encode_png(np.frombuffer(payload_of(t), np.uint8).reshape(-1, WIDTH)) for t in texts]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), f, "doc_id long, n_bytes long, media binary")


def describe_images(df: DataFrame, media: str = "media") -> DataFrame:
    """The columns of ``df`` but ``media``, and what its stored bytes hold when read back: payload bytes, SHA-256 and CRC-32 of its last 64 samples, those of the stored form, the cosine hash, and ``error``."""
    new = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "error": pa.string()}
    kept = [c for c in df.columns if c != media and c not in new]

    def describe(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6 + ("null",)
        stored = (len(data), hashlib.sha256(data).hexdigest())
        try:
            pixels = decode_png(data)
        except ValueError as e:
            return (None, None, None, *stored, None, str(e))
        raw = pixels.tobytes()
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]), *stored, dct_hash(pixels), None

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        found = list(zip(*map(describe, b.column(len(kept)).to_pylist()), strict=True))
        return pa.RecordBatch.from_arrays([b.column(i) for i in range(len(kept))] + [pa.array(x, t) for x, t in zip(found, new.values(), strict=True)], [*kept, *new])

    ddl = [columns_ddl(df.select(kept))] * bool(kept) + [f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in new.items()]
    return map_batches(df.select(*kept, df[media].cast("binary")), f, ", ".join(ddl))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 6 over all documents."""
    return describe_images(text_images(table(spark, sf_dir, "documents"))).drop("error")
