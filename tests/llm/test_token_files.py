import random
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from corpusloom.llm import token_files as tf
from tests.llm.small import SCHEMA, documents, empty, texts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|EndOfText|> <|ENDOFTEXT|>a A<|startoftext|>B<|StartOfText|>", "Été, ÉTÉ! ÿ) Þing*** straße. a's, x'S; o're? é́, a<| A<|endoftext|>, İ, ŒŸ; it's. é, e,́ a̸ ≠ a≠", "<|endoftext|> a<|startoftext|>b <|endof text|>", "it's we'll 'S 12 34x", "é ́ ẛ̣ ΑΣ Σ ΟΔΟΣ.", "a b c\u0085d\x1ce\x00f", "İstanbul ǅ 漢字かな 😀👍🏽‍", "ﬁ Å 가가", "Ab" * 900, "\t\n  x  \r\n"]


TOKENIZER = Tokenizer.from_file(PATH)


def whole(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def test_words_give_the_ids_of_whole_texts():
    r = random.Random(3)
    mixed = ["".join(r.choices("aA é́'sS9<|>endoftxt\n\t ßΣ…", k=80)) for _ in range(300)]
    ts = [*texts(), *ODD, *mixed]
    encoder, tokenizer = tf.WordEncoder(open(PATH, encoding="utf-8").read()), TOKENIZER
    for _ in range(2):  # the second time from kept words
        flat, counts = encoder.encode(pa.array(ts))
        for t, ids in zip(ts, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
            assert ids.tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    flat, counts = encoder.encode(pa.array([], pa.string()))
    assert len(flat) == len(counts) == 0


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(tf, "KEPT_WORDS", 50)
    encoder = tf.WordEncoder(open(PATH, encoding="utf-8").read())
    for k in range(20):
        flat, counts = encoder.encode(pa.array([f"w{k} x{i}" for i in range(40)]))
        assert flat[: counts[0]].tolist() == whole(f"w{k} x0")
        assert len(encoder.kept) <= 50 + 82 and len(encoder.earlier) <= 50 + 82
    encoder.encode(pa.array(['long' * 50 + ' LONG,' * 9 + 'long' * 99 + '!']))
    assert max(map(len, encoder.kept)) <= 5 + tf.KEPT_CHARS


@pytest.mark.parametrize("length,rows", [(7, 3), (2048, 64)])
def test_files(spark, tmp_path, length, rows):
    ts = texts() + ODD
    data = [(None if i % 13 == 5 else i * 7 % 50, t, "l", "s", 1, "clash", 5) for i, t in enumerate(ts)]
    data += data[:4]
    df = spark.createDataFrame(data, SCHEMA).withColumnsRenamed({"size": "base", "h": "_tie"}).repartition(5)
    folder = f"file://{tmp_path}"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several shards of so few rows
    manifest = tf.write_ids(df, folder, PATH, length, rows)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, np.int64(np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))))
    want, start, stream = [], 0, []
    for d, t, *_ in order:
        ids = whole(t)
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start, stream = start + len(ids), stream + ids
    assert sorted(map(tuple, tf.read_documents(manifest, folder).collect()), key=lambda r: r[1]) == want
    # every sequence by its number, without a copy, and the mask
    shards, got = sorted(manifest.collect(), key=lambda r: r.base), []
    assert len(shards) > 1 and sum(s.n_docs for s in shards) == len(data)
    for s in shards:
        shard = tf.Shard(folder, s.shard)
        before = pa.total_allocated_bytes()
        n = -(-s.n_ids // length)
        for k in random.Random(1).sample(range(n), n):
            ids, mask = shard.sequence(k)
            assert ids.dtype == np.uint16 and len(ids) == length and not ids.flags.owndata and not ids.flags.writeable
            mask = mask.to_numpy(zero_copy_only=False)
            used = min(length, s.n_ids - k * length)
            assert mask[:used].all() and not mask[used:].any() and not ids[used:].any()
            assert ids[:used].tolist() == stream[s.base + k * length : s.base + k * length + used]
        assert pa.total_allocated_bytes() - before < 10_000


def test_lost_attempts_leave_nothing_that_counts(spark, tmp_path):
    """Files that no manifest names, as those of lost tasks, aren't read."""
    df, rows = documents(spark)
    writer = tf.ShardWriter(f"file://{tmp_path}", np.uint16)
    writer.append(pa.array([1]), np.array([5, 2], np.uint16), np.array([2]))
    writer.close()
    manifest = tf.write_ids(df, f"file://{tmp_path}", PATH)
    assert tf.read_documents(manifest, f"file://{tmp_path}").count() == len(rows)


def test_empty(spark, tmp_path):
    assert tf.read_documents(tf.write_ids(empty(spark), f"file://{tmp_path}", PATH), f"file://{tmp_path}").count() == 0
    assert urlparse(f"file://{tmp_path}").scheme == "file"


def test_query(spark):
    got = tf.op12_token_files(spark, "/root/testdata/sf0.001").collect()
    docs = sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect(), key=lambda r: r.doc_id)
    start, tokenizer = 0, TOKENIZER
    for r, d in zip(sorted(got), docs, strict=True):
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
