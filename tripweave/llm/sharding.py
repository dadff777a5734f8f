"""Placement by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: a
start and a stride.  The shards take turns, each claiming the first slot of its order that
is still free, so the slots are shared out evenly, and when a shard comes or goes few other
slots change hands.  A row's key is hashed to a slot; the broadcast table names the shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime; far more slots than shards keep the shares even.
SLOTS = 65_537


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that holds it; depends on the shard names alone."""
    if not 0 < len(shards) <= slots or len(set(shards)) != len(shards):
        raise ValueError("shards need different names and at least one slot each")
    if any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime")
    at = [_number(s, "start") % slots for s in shards]
    stride = [_number(s, "stride") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    table = [-1] * slots
    left = slots
    while True:
        for shard in range(len(shards)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + stride[shard]) % slots
            table[at[shard]] = shard
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 48 bits of the MD5 of the key as text.  A null key has a slot too."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("\0null")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % slots).cast("int")


def lookup_table(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """The filled table as rows (slot, shard); its size is the parameter ``slots``."""
    text = ",".join(map(str, fill_table(shards, slots)))
    names = F.array(*(F.lit(s) for s in shards))
    return (
        spark.range(1)
        .select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "_held"))
        .select("slot", F.get(names, F.col("_held").cast("int")).alias("shard"))
    )


def place(
    docs: DataFrame, shards: Sequence[str], key: str = "doc_id", slots: int = SLOTS, out: str = "shard"
) -> DataFrame:
    """``docs`` with the column ``out``, the shard of each row; nothing is shuffled.

    Equal keys meet in one shard, rows without a key as well; texts are not looked at.  A
    column that has the name ``out`` already is replaced.  An empty table stays empty.
    """
    names = [c for c in docs.columns if c != out]
    table = lookup_table(docs.sparkSession, shards, slots)
    # slots rows of two short columns, whatever the input: safe to broadcast.
    return (
        docs.select(*names, slot_of(F.col(key), slots).alias("_shard_slot"))
        .join(F.broadcast(table.withColumnsRenamed({"slot": "_shard_slot", "shard": out})), "_shard_slot")
        .select(*names, out)
    )


def write_shards(docs: DataFrame, path: str, shards: Sequence[str], key: str = "doc_id") -> None:
    """Write one folder per shard.  Each task writes the rows it has, so a shard that a hot key
    makes large is many files and never one task."""
    place(docs, shards, key).write.partitionBy("shard").parquet(path)
