"""Sharding by a permutation-filled lookup table: each shard has an order of preference over the slots of a prime-sized table, and the shards take turns, each claiming its next free slot. A row's key hashes to a slot; the broadcast table gives its shard in constant time, and few rows move when a shard comes or goes.

The table's size is a parameter (at most ``MAX_SLOTS``), never the data's, so the broadcast is bounded. Placement is a map over rows: no shuffle, whatever key is hot.

Defined results: a null key is placed as the text ``""``; equal keys get equal shards; repeated rows stay; an empty table gives an empty result; an input column named ``slot`` or ``shard`` is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

SLOTS, MAX_SLOTS, SHARDS = 65_537, 1 << 20, 64


def _number(text: str, part: int) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[8 * part : 8 * part + 8], "big")


def lookup_table(shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> list[int]:
    """The index of the shard that owns each slot. ``weights``: turns that a shard takes in each round (1 by default)."""
    if not shards or len(set(shards)) != len(shards) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError("shards must be distinct, at least one, and no more than the slots")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime, so that each step visits every slot")
    turns = list(weights or [1] * len(shards))
    if len(turns) != len(shards) or min(turns) < 0 or not any(turns):
        raise ValueError("a weight is wanted for each shard, and one above 0")
    at = [_number(s, 0) % slots for s in shards]
    step = [_number(s, 1) % (slots - 1) + 1 for s in shards]
    owner, left = [-1] * slots, slots
    while True:
        for k, n in enumerate(turns):
            for _ in range(n):
                while owner[at[k]] >= 0:
                    at[k] = (at[k] + step[k]) % slots
                owner[at[k]] = k
                left -= 1
                if not left:
                    return owner


def slot_of(key: str, slots: int = SLOTS):
    """The slot of a key column: the first 15 hexadecimal digits of its MD5, modulo the number of slots."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots))


def place(df: DataFrame, key: str = "doc_id", shards: Sequence[str] | int = SHARDS, slots: int = SLOTS, weights: Sequence[int] | None = None) -> DataFrame:
    """``df`` with slot (long) and shard (string)."""
    names = [f"shard-{k:05d}" for k in range(shards)] if isinstance(shards, int) else list(shards)
    owner = lookup_table(names, slots, weights)
    owners = df.sparkSession.createDataFrame([(i, names[k]) for i, k in enumerate(owner)], "slot long, shard string")
    return df.drop("slot", "shard").withColumn("slot", slot_of(key, slots)).join(F.broadcast(owners), "slot").select(*[df[c] for c in df.columns if c not in ("slot", "shard")], "slot", "shard")


def write_shards(df: DataFrame, path: str, salts: int = 4) -> None:
    """Writes ``df``, which ``place`` has returned, as a folder for each shard. ``salts`` tasks write each shard, so that none holds a whole one."""
    df.withColumn("_salt", F.pmod(F.col("slot"), F.lit(salts))).repartition("shard", "_salt").drop("_salt").write.partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot and shard of every document."""
    return place(table(spark, sf_dir, "documents").select("doc_id"))


def oracle_sql(shards: int = SHARDS, slots: int = SLOTS) -> str:
    """Placement in SQL: the key's slot, and its shard in the lookup table, which stands there as the list of its owners."""
    owners = ", ".join(map(str, lookup_table([f"shard-{k:05d}" for k in range(shards)], slots)))
    return f"""WITH s AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {slots} AS slot FROM documents), t AS (SELECT [{owners}] AS owners)
SELECT doc_id, slot, format('shard-{{:05d}}', owners[slot + 1]) AS shard FROM s, t"""
