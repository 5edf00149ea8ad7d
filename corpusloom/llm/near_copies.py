"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8, or whose SimHash differs by at most two bits (operator 4), grouped into components.

Candidates come from exact prefix filtering, so no similar pair is missed. Under any fixed order of all shingles, two sets of similarity s share one of their first ``n - ceil(s * n) + 1`` shingles. Here a shingle comes first if few sets hold it, so that a passage that many documents share stands among the first only where a document is hardly anything else. A shingle of one set alone meets nothing, so that most sets have no candidates at all.

Before that, sets without any similar one are told by narrower rows. In the order of their hashes alone, the first common shingles of two similar sets lie in the heads of both, for which a set sends three tenths of its shingles: a set that finds fewer of its head's in the heads of others is left out, and only the rest send all of theirs. Texts that a step needs again are picked by a bitmap of a fixed size, so that they aren't shuffled; what it lets through beyond them changes no result.

Shingles that a bounded sample of the sets shows to be in many of them come last in the order, without a count, and their rows are dealt by set too, so that no task gets a shared passage whole; a run of equal shingles is read in pieces. The sample decides where rows go and in which order they stand, never which pairs are found. Each task sends equal sets once.

Sets that share a shingle are first held against two of them, one picked in eight ways by the shingle's hash, and the one with the least that no other set has, so that a large group costs some ten pairs a member. Only sets that share a shingle, are then still in different components and have enough behind the shingle in their orders to be similar are listed as pairs. Every candidate is verified by its whole set.

Equal sets are one node, named by a 64-bit hash. Defined results are those of ``simhash.drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import simhash
from corpusloom.llm.common import bound_batches, map_batches, materialize, texts_of

SHINGLE, SEED, WAYS = 5, 42, 8
#: Sets in the sample for frequent shingles, how many of them make one frequent, the most that are listed, and over how many tasks its rows are dealt.
SAMPLE, FREQUENT, LISTED, SALTS = 4000, 40, 200_000, 64
#: Sets a task remembers as sent, and rows of one shingle that it holds at once (2 or more).
REMEMBERED, HELD = 200_000, 200_000
#: Bits of the map by which texts are picked (a power of two, a multiple of 32,768); it goes through the driver.
PICKED = 1 << 26
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join([xxhash.xxh64_digest(w, SEED) for w in words]), ">u8").astype(np.uint64)
    size = min(SHINGLE, len(words))
    x = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        x = x * _MULTIPLIER + h[k : k + len(x)]
    return np.unique(_mix(x))


def key_of(x: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(x.tobytes(), SEED) - (1 << 63)


def prefix_length(n):
    """How many of the first of ``n`` shingles two sets of similarity 0.8 can't both lack."""
    return n - (4 * n + 4) // 5 + 1


def head_length(n):
    """How many of its ``n`` shingles a set sends before all: the first ``n // 10 + 1`` that it has in common with a similar set are among them."""
    return prefix_length(n) + n // 10


def least_met(n):
    """How many shingles of a head surely lie in the head of a similar set, which may be smaller by a fifth."""
    return F.floor((4 * n + 4) / 50) + 1


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, key, n) of every document: SimHash, name and size of its set."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(b.column(1))
        fp = np.frombuffer(b"".join(map(simhash.fingerprint, texts)), ">u8").astype(np.uint64).view(np.int64)
        sets = list(map(shingles, texts))
        made = [pa.array(fp), pa.array([key_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64())]
        return pa.RecordBatch.from_arrays([b.column(0), *made], ["doc_id", "fp", "key", "n"])

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), f, "doc_id long, fp long, key long, n long")


def _bit():
    """Where a doc_id stands in a map of ``PICKED`` bits."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(PICKED))


def _picked(keys: DataFrame, winners: DataFrame) -> np.ndarray:
    """A map of ``PICKED`` bits, in bytes, of the doc_ids that the winners (key, doc_id) of ``keys`` (key) have."""
    at = winners.join(keys, "key", "left_semi").select((_bit() + 1).alias("_bit"))
    rows = at.groupBy(F.bitmap_bucket_number("_bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("bits")).collect()
    bits = np.zeros(PICKED // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r.bits), np.uint8)
        bits[(r.k - 1) * len(part) :][: len(part)] = part
    return bits


def _is_in(x: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in ``listed``, which is in order."""
    return listed[np.minimum(np.searchsorted(listed, x), len(listed) - 1)] == x if len(listed) else np.zeros(len(x), bool)


def _sets(docs: DataFrame, picked: np.ndarray | None = None, heads_but: np.ndarray | None = None) -> DataFrame:
    """(key, x): the set of every document, or of every one that ``picked`` lets through; a task sends one that it remembers once. With ``heads_but``, only the set's head, for which these shingles come last."""
    bound_batches(docs.sparkSession)

    def head(x: np.ndarray) -> np.ndarray:
        last = _is_in(x.view(np.int64), heads_but)
        return np.concatenate([x[~last], x[last]])[: head_length(len(x))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for b in batches:
            texts = b.column(1)
            if picked is not None:
                at = b.column(0).to_numpy()
                texts = texts.filter(pa.array((picked[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            made = {}
            for x in map(shingles, texts_of(texts)):
                if (key := key_of(x)) not in sent and key not in made:
                    made[key] = x if heads_but is None else head(x)
            sent = (sent if len(sent) < REMEMBERED else set()) | made.keys()
            flat = np.concatenate([np.empty(0, np.uint64), *made.values()]).view(np.int64)
            at = np.cumsum([0, *map(len, made.values())]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["key", "x"])

    return docs.select(_bit().alias("at"), F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, x array<long>")


def frequent_shingles(docs: DataFrame, winners: DataFrame) -> np.ndarray:
    """The shingles, in order, that at least ``FREQUENT`` of about ``SAMPLE`` different sets hold: at most ``LISTED``, those in most of them."""
    total = max(winners.count(), 1)
    keys = winners.select("key").filter(F.pmod(F.xxhash64("key"), F.lit(1 << 31)) < min(1 << 31, int((1 << 31) * SAMPLE / total) + 1))
    sets = _sets(docs, _picked(keys, winners)).join(keys, "key", "left_semi").dropDuplicates(["key"])
    held = sets.select(F.explode("x").alias("x")).groupBy("x").count().filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "x").limit(LISTED)
    return np.sort(np.array([r.x for r in held.select("x").collect()], np.int64))


def _shared(sets: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(key, x, df, star) of ``sets`` (key, x) for every x that several sets hold: how many hold it (``HELD`` stands for more, the greatest number for a frequent one) and the set that the others of x are held against. A frequent x has a star for each of its parts, and a set that is alone in its part is its own."""
    often = np.int64((1 << 63) - 1)

    def dealt(b: pa.RecordBatch) -> pa.RecordBatch:
        x, size = b.column(1).values.to_numpy(), b.column(1).value_lengths().to_numpy()
        key = np.repeat(b.column(0).to_numpy(), size)
        salt = np.zeros(len(x), np.int32)
        if len(frequent) and len(x):
            found = _is_in(x, frequent)
            salt[found] = 1 + _mix(key[found].view(np.uint64)) % np.uint64(SALTS)
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(key), pa.array(salt)], ["x", "key", "salt"])

    def told(x: np.ndarray, key: np.ndarray, salt: np.ndarray, df_: int | None = None, star_: int | None = None) -> tuple[pa.RecordBatch, int]:
        """Rows of whole runs; or, with ``df_``, of a piece of one, to which an earlier piece has given ``star_``. Also the last run's star."""
        new = np.r_[True, (x[1:] != x[:-1]) | (key[1:] != key[:-1])]
        x, key, salt = x[new], key[new], salt[new]
        starts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (salt[1:] != salt[:-1])])
        size = np.diff(np.r_[starts, len(x)])
        way = _mix(key.view(np.uint64) + (x.view(np.uint64) >> np.uint64(3)) % np.uint64(WAYS) * _MULTIPLIER)
        star = key[np.lexsort((way, np.repeat(starts, size)))][starts]  # runs stay where they are; the least way comes first
        df, star = np.repeat(size if df_ is None else np.full(len(size), df_), size), np.repeat(star, size) if star_ is None else np.full(len(x), star_)
        df = np.where(salt > 0, often, np.minimum(df, HELD))
        rows = [pa.array(c[df > 1]) for c in (key, x, df, star)]
        return pa.RecordBatch.from_arrays(rows, ["key", "x", "df", "star"]), int(star[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, star, end = None, None, None  # rows of the last run, which may go on; if a piece of it was given out: its star, its last row
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(c).to_numpy() for c in ("x", "key", "salt")]
            if held is not None:
                rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
            if end is not None:
                mine = int(((rows[0] == end[0]) & (rows[2] == end[2])).sum())
                if mine == len(rows[0]) <= HELD:
                    held = rows
                    continue
                fresh = rows[1][:mine] != end[1]  # copies of the last row are left out
                if fresh.any():
                    yield told(*(c[:mine][fresh] for c in rows), HELD, star)[0]
                if mine == len(rows[0]):
                    held, end = None, [c[-1] for c in rows]
                    continue
                rows, star, end = [c[mine:] for c in rows], None, None
            changes = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[2] != rows[2][-1]))
            cut = int(changes[-1]) + 1 if len(changes) else 0
            if cut:
                yield told(*(c[:cut] for c in rows))[0]
            held = [c[cut:] for c in rows]
            if len(held[0]) > HELD:
                piece, star = told(*held, HELD)
                yield piece
                held, end = None, [c[-1] for c in held]
        if held is not None:
            fresh = np.ones(len(held[0]), bool) if end is None else held[1] != end[1]
            if fresh.any():
                yield told(*(c[fresh] for c in held), None if end is None else HELD, star)[0]

    rows = map_batches(sets, dealt, "x long, key long, salt int")
    return rows.repartition("x", "salt").sortWithinPartitions("x", "salt", "key").mapInArrow(run, "key long, x long, df long, star long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ``sets`` (key, x) have a similarity of at least 0.8."""
    left, right = sets.select(F.col("key").alias("a"), F.col("x").alias("xa")), sets.select(F.col("key").alias("b"), F.col("x").alias("xb"))
    both = F.size(F.array_intersect("xa", "xb"))
    return pairs.join(left, "a").join(right, "b").filter(9 * both >= 4 * (F.size("xa") + F.size("xb"))).select("a", "b")


def similar_links(docs: DataFrame, sized: DataFrame, winners: DataFrame) -> DataFrame:
    """(a, b): links between keys that connect exactly those that chains of similarity 0.8 connect. ``sized``: (key, n); ``winners``: (key, doc_id), a document of each."""
    frequent = frequent_shingles(docs, winners)
    met = _shared(_sets(docs, heads_but=frequent), frequent).groupBy("key").agg(F.count("*").alias("met"))
    meeting = materialize(met.join(sized, "key").filter(F.col("met") >= least_met(F.col("n"))).select("key"))
    shared = _shared(_sets(docs, _picked(meeting, winners)), frequent)
    by_key = shared.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "x", "star"))).alias("xs")).join(sized, "key")
    alone = F.col("n") - F.size("xs")
    taken = F.greatest(F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1 - alone, F.lit(0)).cast("int")
    told = by_key.select("key", "n", (alone / F.greatest("n", F.lit(1))).alias("lone"), alone.alias("alone"), F.posexplode(F.slice("xs", F.lit(1), taken)).alias("i", "s"))
    prefix = materialize(told.select("key", "n", "lone", "s.x", "s.star", (F.col("alone") + F.col("i")).alias("at")))
    # beside the star, the set with the least that no other has: of edited copies that is what they were made from
    central = prefix.groupBy("x").agg(F.min(F.struct("lone", "key"))["key"].alias("central"))
    stars = prefix.select("key", "star").union(prefix.join(central, "x").select("key", "central"))
    size = sized.select(F.col("key").alias("star"), F.col("n").alias("m"))
    near = lambda a, b: 5 * F.least(a, b) >= 4 * F.greatest(a, b)
    pairs = stars.filter("key <> star").select(F.least("key", "star").alias("a"), F.greatest("key", "star").alias("b")).distinct()
    pairs = pairs.join(sized.select(F.col("key").alias("a"), F.col("n").alias("na")), "a").join(size.withColumnRenamed("star", "b"), "b").filter(near("na", "m")).select("a", "b")
    pairs = materialize(pairs)
    wanted = prefix.select("key").union(prefix.select("star")).distinct()
    sets = materialize(_sets(docs, _picked(wanted, winners)).join(wanted, "key", "left_semi").dropDuplicates(["key"]))
    found = materialize(_verified(pairs, sets))
    # what the stars left apart
    roots = simhash.components(found)
    placed = materialize(prefix.select("key", "n", "x", "at").join(roots, prefix.key == roots.node, "left").select("key", "n", "x", "at", F.coalesce("root", "key").alias("root")))
    split = placed.groupBy("x").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("x")
    rows = placed.join(split, "x")
    one, two = (rows.select("x", *[F.col(c).alias(f"{c[0]}{k}") for c in ("key", "n", "at", "root")]) for k in (1, 2))
    # at the first shingle that two sets share, no more than what follows it in both can be common
    enough = 9 * F.least(F.col("n1") - F.col("a1"), F.col("n2") - F.col("a2")) >= 4 * (F.col("n1") + F.col("n2"))
    rest = one.join(two, (one.x == two.x) & (F.col("k1") < F.col("k2")) & (F.col("r1") != F.col("r2")) & near("n1", "n2") & enough)
    rest = rest.select(F.col("k1").alias("a"), F.col("k2").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    return found.union(materialize(_verified(rest, sets)))


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, key, component_id, root) for every document; component_id is the smallest doc_id within reach, root the smallest key."""
    by_doc = materialize(signatures(docs))
    sized = materialize(by_doc.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("n").alias("n")))
    low = materialize(by_doc.groupBy("fp").agg(F.min("key").alias("low")))
    equal = by_doc.select("fp", "key").distinct().join(low, "fp").filter("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b"))
    bits = simhash.ball_links(low.select("fp"))
    bits = bits.join(low.select(F.col("fp").alias("a"), F.col("low").alias("la")), "a").join(low.select(F.col("fp").alias("b"), F.col("low").alias("lb")), "b").select("la", "lb")
    similar = similar_links(docs, sized.select("key", "n"), sized.select("key", F.col("first").alias("doc_id")))
    named = simhash.named_components(sized.select("key", "first"), "key", simhash.components(equal.union(bits).union(similar)))
    return by_doc.join(named, "key").select("doc_id", "key", "component_id", "root")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without those that aren't the first of their component."""
    return simhash.keep_first(docs, near_copy_groups(docs).withColumnRenamed("key", "node"), lambda t: key_of(shingles(t)))
