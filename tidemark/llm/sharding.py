"""Sharding by a lookup table that the shards fill by turns.

Each shard has a permutation of the slots of a prime-sized table (an offset and a step from its
name's hash).  By turns each shard claims the first free slot in its order until the table is full,
so all own equally many slots (one more or less), and a shard that comes or goes moves few slots.
A document's key is hashed to a slot.  The table has a fixed size, whatever the input, and is
broadcast.

Cases: the key is the document id as text; without an id the text; without both the empty text.
Rows of one id go to one shard, repeated rows too.  Very long texts are hashed whole where they are the key.  No rows give
no rows, no shards is an error.  All input columns are kept; slot and shard get underscores in front where names are taken.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name

#: A prime, some hundred times the number of shards.
TABLE_SIZE = 65537
SHARDS = 128


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard (by its place in the list) of each slot."""
    if not shards:
        raise ValueError("no shards")
    at = [_number(f"offset {s}") % size for s in shards]
    step = [_number(f"step {s}") % (size - 1) + 1 for s in shards]
    table = [-1] * size
    left = size
    while left:
        for number in range(len(shards)):
            slot = at[number]
            while table[slot] >= 0:
                slot = (slot + step[number]) % size
            table[slot] = number
            at[number] = (slot + step[number]) % size
            left -= 1
            if not left:
                break
    return table


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The first 15 hex digits of the key's MD5, modulo the table's size."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long") % size


def with_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str | None = "text", shards: int = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """docs with slot and shard (underscores in front if the names are taken)."""
    slot, shard = free_name(docs, "slot"), free_name(docs, "shard")
    rows = list(enumerate(lookup_table(shard_names(shards), size)))
    table = docs.sparkSession.createDataFrame(rows, f"{slot} long, {shard} int")
    key = F.col(id_col).cast("string")
    key = F.coalesce(key, F.col(text_col), F.lit("")) if text_col else F.coalesce(key, F.lit(""))
    return docs.withColumn(slot, slot_of(key, size)).join(F.broadcast(table), slot).select(*docs.columns, slot, shard)
