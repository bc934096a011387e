"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: slot (offset + j * skip) mod size
for j = 0, 1, ... Shards take turns, each claiming the first slot of its order that is still free, until the table is
full. A key then goes to the shard of the slot that its hash names. Every shard owns nearly the same number of slots,
and adding or removing a shard moves few keys besides its own.

The table depends on the shard names only and has a checked size, so it is broadcast; placement is one hash and one
lookup for each row, without a shuffle of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the production table, a prime, and the most that are ever broadcast.
TABLE_SIZE, MAX_TABLE_SIZE = 6553, 1_000_003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Index of the owning shard for each slot; the names are taken in sorted order, so their order does not matter."""
    if size < 2 or size > MAX_TABLE_SIZE or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError(f"the table size must be a prime of at most {MAX_TABLE_SIZE}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct names, at least one and no more than slots")
    names = sorted(shards)
    at = [_number(f"offset {name}") % size for name in names]
    skip = [_number(f"skip {name}") % (size - 1) + 1 for name in names]
    table, left = [-1] * size, size
    while left:
        for shard in range(len(names)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % size
            table[at[shard]] = shard
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key by the first 32 bits of the MD5 of its text; a null key counts as the empty text."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("long"), F.lit(size)).cast("int")


def lookup(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """The table as (slot, shard)."""
    names, text = sorted(shards), ",".join(map(str, fill_table(shards, size)))
    return (spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "owner"))
            .select("slot", F.element_at(F.array(*map(F.lit, names)), F.col("owner").cast("int") + 1).alias("shard")))


def assign(df: DataFrame, key_col: str, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """(key, ``slot`` int, ``shard`` string) of every row.

    Equal keys share a shard and repeated rows stay; a null key is placed as the empty text; an empty table gives no
    rows; other columns are left out, so none can clash.
    """
    placed = df.select(F.col(key_col), slot_of(F.col(key_col), size).alias("slot"))
    return placed.join(F.broadcast(lookup(df.sparkSession, shards, size)), "slot").select(key_col, "slot", "shard")
