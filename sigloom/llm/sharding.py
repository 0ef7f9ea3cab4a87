"""Placement of documents on shards by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own (an offset and
a step from its name).  Shards take turns; at its turn a shard claims the first slot it
prefers that is still free.  Shares differ by one slot at most, and when a shard goes, few
slots of the others move.  The table is a constant of a few kilobytes, whatever the data:
it is broadcast, and a document's place is one hash and one lookup.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A prime of at least a hundred slots a shard.
SLOTS = 5003
SHARDS = tuple(f"shard-{k:02d}" for k in range(48))
#: Slots that a table may have, so that its broadcast stays within a few megabytes.
MOST_SLOTS = 1 << 18
#: Bytes of a shard's file, about; of a row, where a table's size is unknown.
FILE_BYTES, ROW_BYTES = 256 << 20, 4 << 10


def preference(name: str, slots: int) -> tuple[int, int]:
    """Offset and step of a shard's walk over the slots."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:15], 16) % slots, int(digest[15:30], 16) % (slots - 1) + 1


def fill(shards: tuple[str, ...], slots: int = SLOTS) -> list[int]:
    """The shard number of every slot."""
    if not shards or slots > MOST_SLOTS or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("a table has at least one shard and a prime number of slots")
    walks = [preference(s, slots) for s in shards]
    at, table = [0] * len(shards), [-1] * slots
    for turn in range(slots):
        k = turn % len(shards)
        offset, step = walks[k]
        while table[(offset + at[k] * step) % slots] >= 0:
            at[k] += 1
        table[(offset + at[k] * step) % slots] = k
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key; a null key has the empty string's."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots))


def place(rows: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``rows`` with slot and shard (columns of these names are replaced).

    Equal keys share a shard; nulls go where the empty string goes.  An empty table gives an
    empty result.  Rows are not moved.
    """
    spark = rows.sparkSession
    one = spark.range(1).select(F.from_json(F.lit(json.dumps(fill(shards, slots))), "array<int>").alias("t"))
    names = F.array(*[F.lit(s) for s in shards])
    table = one.select(F.posexplode("t").alias("table_slot", "number")).select(F.col("table_slot").cast("long"), F.element_at(names, F.col("number") + 1).alias("shard"))
    kept = rows.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return kept.join(F.broadcast(table), F.col("slot") == F.col("table_slot")).drop("table_slot")


def write_shards(rows: DataFrame, path: str, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, file_bytes: int = FILE_BYTES) -> None:
    """Writes the rows by shard; a shard's rows are dealt over as many tasks and files as its share of the table's size asks for.

    The size is the optimizer's, which for files is theirs.  Rows are dealt by all they
    hold, so that a key that many rows share isn't one task's.
    """
    placed = place(rows, key, shards)
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # an unknown size is a number beyond all tables: then the rows are counted
    size = size if size < 1 << 60 else rows.count() * ROW_BYTES
    files = max(1, -(-size // (len(shards) * file_bytes)))
    held = [F.col(f"`{f.name}`") for f in rows.schema.fields if not isinstance(f.dataType, T.MapType)]
    deal = F.pmod(F.xxhash64(*held), F.lit(files))
    placed.withColumn("_deal", deal).repartition(len(shards) * files, "shard", "_deal").drop("slot", "_deal").write.partitionBy("shard").parquet(path)
