"""Token ids in Arrow files: record batches of fixed-size lists, so that each sequence of ids and its mask is found by arithmetic and read without a copy.

Documents are dealt to ranges of doc_id (ties by the text's hash) and sorted within them. Each range becomes a shard: one Arrow file of sequences (ids as unsigned integers of 16 bits, or 32 where the vocabulary needs them; mask, a bit each, true for an id and false for padding; ``length`` each; only the last sequence is padded) and one Arrow file with the place of each document. All batches of a shard but the last hold the same number of sequences, ``rows``, hence id k lies in batch k // (rows * length). What a task keeps is one batch of texts and one of sequences.

A task writes files of a name of its own and returns it; the manifest, which Spark commits, names the files of the attempts that counted, so lost executors and repeated or speculative tasks leave at most files that nothing refers to. The manifest has one row for each shard and the number of ids before it.

Encoding: the tokenizer's patterns never cross ASCII white space, so a text's ids are those of its words, one after the other. Each batch encodes its different words once, and a worker keeps those of earlier batches (a bounded number, those used last). This holds for the tokenizer that the query names, and a test compares it with whole texts; another must end its tokens alike.

``folder`` is a path or URI that the executors share and that pyarrow's file systems open (local or mounted paths, hdfs, s3, gs).

Defined results: a null or empty text gives the end id alone; null doc_ids come first; rows that share a doc_id follow by the hash of their texts, repeated rows one after another, each written; a text longer than a batch's bound is one batch of its own; an empty table writes no shard; other columns are ignored, whatever their names; words of special tokens are what the tokenizer makes of them in running text.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import bound_batches, materialize, shared_dir, table

LENGTH, ROWS, END_ID = 2048, 64, 2
#: Words that a worker keeps the ids of before it forgets those that weren't used since it did so last, and their longest.
KEPT_WORDS, KEPT_CHARS = 500_000, 64
#: A word of these letters and then these marks has the ids of both: the tokenizer ends a token between them, and no mark changes a letter before it.
_LETTERS = "".join(chr(c) for c in range(0x41, 0x100) if chr(c).isalpha() and c not in (0xAA, 0xB5, 0xBA))
_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")
MANIFEST = "shard string, n_docs long, n_ids long, first_id long, first_tie long"

_IDS = lambda dtype, length: pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
_PLACES = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])


def id_type(n: int) -> type:
    """Unsigned integers for a vocabulary of ``n`` ids."""
    return np.uint16 if n <= 1 << 16 else np.uint32


class WordEncoder:
    """Ids of texts by their words. ``definition``: the tokenizer's file."""

    def __init__(self, definition: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        self.end = np.array([end_id], self.dtype).tobytes()
        self.kept, self.earlier = {}, {}

    def _find(self, words: list[str]) -> list[str]:
        """The words that aren't kept; those kept earlier are kept again."""
        new = []
        for w in words:
            if w not in self.kept:
                ids = self.earlier.get(w)
                if ids is None:
                    new.append(w)
                else:
                    self.kept[w] = ids
        return new

    def _ids(self, words: pa.DictionaryArray) -> pa.Array:
        """The ids of each different word, as bytes."""
        known = words.dictionary.to_pylist()
        if len(self.kept) > KEPT_WORDS:
            self.kept, self.earlier = {}, self.kept
        new = self._find(known)
        made = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        ends = np.cumsum(np.fromiter(map(len, made), np.int64, len(made))) * np.dtype(self.dtype).itemsize
        flat = np.fromiter(chain.from_iterable(made), self.dtype, ends[-1] // np.dtype(self.dtype).itemsize if new else 0).tobytes()
        self.kept.update(zip(new, map(flat.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist())), strict=True))
        ids = pa.array(list(map(self.kept.__getitem__, known)), pa.large_binary())
        for w in new:
            if len(w) > KEPT_CHARS:
                del self.kept[w]
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` in one array, each with the end id, and the number of each."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        words = lists.flatten()
        # small letters, but for what may hold the name of a special token
        special = pc.match_substring(words, "<|")
        words = pc.if_else(special, words, pc.ascii_lower(words))
        letters, marks = pc.ascii_rtrim(words, _MARKS), pc.utf8_ltrim(words, _LETTERS)
        parted = pc.and_not(pc.equal(pc.add(pc.binary_length(letters), pc.binary_length(marks)), pc.binary_length(words)), special)
        letters, marks = pc.if_else(parted, letters, words).dictionary_encode(), pc.if_else(parted, marks, "").dictionary_encode()
        ids = pa.concat_arrays([self._ids(letters), self._ids(marks), pa.array([self.end], pa.large_binary())])
        # each word's letters and marks, and the end after each text
        pairs = np.stack([letters.indices.to_numpy(), marks.indices.to_numpy() + len(letters.dictionary)], 1).ravel()
        ends = 2 * np.cumsum(np.diff(lists.offsets.to_numpy()))
        taken = ids.take(pa.array(np.insert(pairs, ends, len(ids) - 1)))
        upto = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1][ends + np.arange(1, len(ends) + 1)] // np.dtype(self.dtype).itemsize
        flat = np.frombuffer(taken.buffers()[2] or b"", self.dtype)[: upto[-1] if len(upto) else 0]
        return flat, np.diff(upto, prepend=0)


class ShardWriter:
    """Appends documents to the two files of one shard."""

    def __init__(self, folder: str, dtype: type, length: int = LENGTH, rows: int = ROWS):
        files, at = fs.FileSystem.from_uri(folder)
        self.shard, self.length, self.block, self.schema = uuid.uuid4().hex, length, rows * length, _IDS(dtype, length)
        self.sinks = [files.open_output_stream(f"{at}/{self.shard}.{kind}.arrow") for kind in ("ids", "places")]
        self.ids, self.places = (pa.ipc.new_file(s, schema) for s, schema in zip(self.sinks, (self.schema, _PLACES), strict=True))
        self.rest, self.held, self.n_docs, self.n_ids = [], 0, 0, 0

    def append(self, doc_ids: pa.Array, flat: np.ndarray, counts: np.ndarray) -> None:
        first = self.n_ids + np.cumsum(counts) - counts
        self.places.write_batch(pa.record_batch([doc_ids, pa.array(first), pa.array(counts)], schema=_PLACES))
        self.n_docs, self.n_ids, self.held = self.n_docs + len(counts), self.n_ids + len(flat), self.held + len(flat)
        self.rest.append(flat)
        if self.held >= self.block:
            flat = np.concatenate(self.rest)
            whole = len(flat) // self.block * self.block
            for k in range(0, whole, self.block):
                self._write(flat[k : k + self.block], np.ones(self.block, bool))
            self.rest, self.held = [flat[whole:].copy()], len(flat) - whole

    def _write(self, ids: np.ndarray, mask: np.ndarray) -> None:
        self.ids.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)], schema=self.schema))

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.rest)
            pad = -len(flat) % self.length
            self._write(np.pad(flat, (0, pad)), np.pad(np.ones(len(flat), bool), (0, pad)))
        for x in (self.ids, self.places, *self.sinks):
            x.close()


class Shard:
    """Random access to a shard; local files are mapped into memory and nothing is copied."""

    def __init__(self, folder: str, shard: str):
        self.files, self.at = fs.FileSystem.from_uri(folder)
        self.shard = shard
        self.reader = self._open("ids")
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows  # a shard has at least one document, and that an end id
        self.held: tuple[int, pa.RecordBatch] | None = None

    def _open(self, kind: str) -> pa.ipc.RecordBatchFileReader:
        path = f"{self.at}/{self.shard}.{kind}.arrow"
        return pa.ipc.open_file(pa.memory_map(path) if isinstance(self.files, fs.LocalFileSystem) else self.files.open_input_file(path))

    def _batch(self, k: int) -> pa.RecordBatch:
        if not self.held or self.held[0] != k:
            self.held = k, self.reader.get_batch(k)
        return self.held[1]

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask (bits) of the ``k``-th sequence, views of the file."""
        batch, at = self._batch(k // self.rows), k % self.rows * self.length
        return batch.column("ids").values.slice(at, self.length).to_numpy(zero_copy_only=True), batch.column("mask").values.slice(at, self.length)

    def ids(self, first: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``first`` on, in views of one batch each."""
        block = self.rows * self.length
        while n > 0:
            part = self._batch(first // block).column("ids").values.to_numpy(zero_copy_only=True)[first % block : first % block + n]
            yield part
            first, n = first + len(part), n - len(part)

    def places(self) -> Iterator[pa.RecordBatch]:
        """The documents in order: doc_id, first, n."""
        reader = self._open("places")
        yield from map(reader.get_batch, range(reader.num_record_batches))


_ENCODERS: dict[str, WordEncoder] = {}


def write_ids(docs: DataFrame, folder: str, tokenizer: str, length: int = LENGTH, rows: int = ROWS, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) below ``folder`` in ascending doc_id order and gives the manifest (shard, n_docs, n_ids, base: ids of all shards before it), written too. ``tokenizer``: the path of a tokenizer file on the driver; the file's text is sent to the workers."""
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    files, at = fs.FileSystem.from_uri(folder)
    files.create_dir(at, recursive=True)
    key = hashlib.md5(f"{tokenizer}:{end_id}".encode()).hexdigest() + uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = WordEncoder(shared.value, end_id)
        encoder, writer, least = _ENCODERS[key], None, None
        for b in batches:
            if b.num_rows:
                if writer is None:
                    writer, least = ShardWriter(folder, encoder.dtype, length, rows), (b.column(0)[0].as_py(), b.column(1)[0].as_py())
                writer.append(b.column(0), *encoder.encode(b.column(2)))
        if writer:
            writer.close()
            yield pa.record_batch([pa.array([x]) if x is not None else pa.array([x], pa.int64()) for x in (writer.shard, writer.n_docs, writer.n_ids, *least)], names=["shard", "n_docs", "n_ids", "first_id", "first_tie"])

    bound_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_tie"), "text")
    shards = materialize(keyed.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").mapInArrow(write, MANIFEST))
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_tie").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return materialize(shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))))


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents in the files of ``manifest``, a task for each shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(folder, name)
                for places in shard.places():
                    sums = []
                    for first, n in zip(places.column("first").to_pylist(), places.column("n").to_pylist(), strict=True):
                        crc = 0
                        for part in shard.ids(first, n):
                            crc = zlib.crc32(part.astype("<u4"), crc)
                        sums.append(crc)
                    start = pc.add(places.column("first"), base)
                    yield pa.record_batch([places.column("doc_id"), start, places.column("n"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("shard", "base").repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 12 over all documents: written as Arrow files in the shared folder and read back."""
    import public_tokenizers

    folder = shared_dir(spark)
    return read_documents(write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json")), folder)
