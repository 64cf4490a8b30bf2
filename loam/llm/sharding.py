"""Sharding by a permutation-filled lookup table.

Each shard walks its own permutation of a prime-sized table's slots; shards take turns, each claiming the
first slot on its walk that is still free.  All shards own equally many slots, give or take one, and a
changed number of shards moves few keys.  A key is placed by one table lookup.

Defined results: keys are the decimal form of doc_id; null ids share the key 'null'; repeated ids share a
slot; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARDS = 256
SLOTS = 65_537


def _number(name: str) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not is_prime(slots):
        raise ValueError("the number of slots must be prime")
    if not 0 < len(shards) <= slots:
        raise ValueError("there must be a shard, and no more shards than slots")
    place = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table = [-1] * slots
    filled = 0
    while True:
        for i in range(len(shards)):
            while table[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % slots
            table[place[i]] = i
            filled += 1
            if filled == slots:
                return table


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def place_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """doc_id, slot, shard.  The broadcast table has one row a slot, however many documents there are."""
    spark = docs.sparkSession
    table = spark.createDataFrame(list(enumerate(lookup_table(shard_names(shards), slots))), "slot long, shard long")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    slot = F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("long")
    return docs.select("doc_id", slot.alias("slot")).join(F.broadcast(table), "slot").select("doc_id", "slot", "shard")


def _sql() -> str:
    table = ", ".join(map(str, lookup_table(shard_names())))
    return f"""
WITH p AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents),
t AS (SELECT unnest(range(0, {SLOTS})) AS slot, unnest([{table}]) AS shard)
SELECT doc_id, slot::BIGINT AS slot, shard::BIGINT AS shard FROM p JOIN t USING (slot)"""


PLACEMENT_SQL = _sql()
