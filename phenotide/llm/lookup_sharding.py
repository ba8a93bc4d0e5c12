"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a table of prime size in an order of its own (an offset and a step of
its name's digest). The shards take turns claiming the next slot they prefer that is still free, so
that all get nearly the same number, and a changed list of shards moves few slots. A row's place is
one lookup of the hash of its key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime well over a hundred times the number of shards keeps their shares within a percent.
SLOTS = 16_381


def _digest(name: str, purpose: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{purpose}:{name}".encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The position, in shards, of the shard that owns each slot."""
    if not is_prime(slots) or not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("slots is a prime, and shards are distinct names, at least one and at most as many as slots")
    at = [_digest(x, "offset") % slots for x in shards]
    step = [_digest(x, "step") % (slots - 1) + 1 for x in shards]
    owner, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            left -= 1
            if not left:
                return owner


def slot_of(key, slots: int = SLOTS):
    """Column of a key's slot: the first 15 hex digits of the MD5 of its text, null being a text that no key has."""
    text = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(docs: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """Every row of docs with slot and shard, by its key; rows of a key stay together, null keys too.

    The table is broadcast: it has one small row per slot, whatever the number of documents, and
    documents are not shuffled. Columns called slot or shard are replaced.
    """
    owners = lookup_table(shards, slots)
    table = docs.sparkSession.createDataFrame([(i, shards[x]) for i, x in enumerate(owners)], "slot int, shard string")
    rows = docs.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return rows.join(F.broadcast(table), "slot").select(*rows.columns, "shard")


def write_shards(placed: DataFrame, path: str) -> None:
    """Placed rows as Parquet, a folder per shard."""
    placed.write.partitionBy("shard").parquet(path)
