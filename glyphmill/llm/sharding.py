"""Sharding by a permutation-filled lookup table, in DataFrame expressions only.

Each shard has a preference order over the slots of a prime-sized table: slot
(offset + j * skip) mod size for j = 0, 1, ..., a permutation because size is prime. Shards take turns
(a shard of weight w takes w of them a round) claiming the first free slot of their order until the
table is full. A key lives in the shard that owns slot hash(key) mod size, found by a broadcast join of
one lookup: the table has ``size`` rows whatever the number of keys. Adding or removing a shard moves
few keys beyond those it gains or gives up.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots; prime, and about a hundred a shard or more keeps the shares within a few per cent.
TABLE_SIZE = 65_537
#: The table is broadcast, so its size is bounded.
MAX_TABLE_SIZE = 4_000_037


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """Offset and skip of a shard's permutation of the slots."""
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1


def lookup_table(shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """Index into ``shards`` of the owner of each slot. Weights are turns in a round, 1 by default."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not _is_prime(size) or not len(shards) <= size <= MAX_TABLE_SIZE:
        raise ValueError(f"size must be a prime from the number of shards to {MAX_TABLE_SIZE}")
    turns = [(weights or {}).get(s, 1) for s in shards]
    if min(turns) < 0 or max(turns) == 0:
        raise ValueError("weights must not be negative, and one must be positive")
    orders = [preference(s, size) for s in shards]
    at = [offset for offset, _ in orders]
    owner, free = [-1] * size, size
    while free:
        for i, (_, skip) in enumerate(orders):
            for _ in range(min(turns[i], free)):
                while owner[at[i]] >= 0:
                    at[i] = (at[i] + skip) % size
                owner[at[i]] = i
                free -= 1
    return owner


def lookup_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """(slot, shard): the table as one literal that Spark unfolds."""
    owners = ",".join(map(str, lookup_table(shards, size, weights)))
    names = F.array(*map(F.lit, shards)) if len(shards) <= 200 else F.split(F.lit("\x00".join(shards)), "\x00")
    return (
        spark.range(1, numPartitions=1)
        .select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"), names.alias("names"))
        .select(F.col("slot").cast("long").alias("slot"), F.element_at("names", F.col("owner").cast("int") + 1).alias("shard"))
    )


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """hash(key) mod size: the first 32 bits of the MD5 of the key as text; a null key has slot 0."""
    head = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.when(key.isNull(), F.lit(0).cast("long")).otherwise(head % size)


def place(rows: DataFrame, key_col: str, shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """rows with columns slot and shard added.

    A null key goes to slot 0, an empty one is hashed as such; equal keys share a shard, so repeated
    rows stay together. Columns of the input named slot or shard are replaced. Rows are never moved:
    a hot key costs nothing here, and its rows are one shard's by definition (key by a finer column
    to spread them). An empty table gives an empty result.
    """
    rows = rows.drop("slot", "shard").withColumn("slot", slot_of(F.col(key_col), size))
    return rows.join(F.broadcast(lookup_frame(rows.sparkSession, shards, size, weights)), "slot", "left")
