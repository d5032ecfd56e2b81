"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table (an offset and a step from hashes of its name).
Shards take turns in claiming their next free slot, so each owns nearly the same number of slots, and few slots change
hands when a shard joins or leaves. The table has a fixed size, hence it is broadcast, and placing a key is one lookup.

Defined cases: a null key goes to the slot of the empty string's hash; equal keys go to one shard; an empty table
gives an empty result; other columns pass through, and where one is called slot or shard, in any case, the new column has
an underscore behind its name; long texts are not read unless they are the key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

#: Slots; a prime, so that every step visits all of them.
SLOTS = 65537


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The owner (index into shards) of every slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shard names must be distinct, and at least one and at most as many as slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    at = [_hash(s, "offset") % slots for s in shards]
    step = [_hash(s, "step") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            free -= 1
            if not free:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores behind it until no column has it; case does not tell columns apart."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """Adds slot int and shard string, under names that are free. The lookup table has ``slots`` rows whatever the data."""
    slot, shard = free_name("slot", df.columns), free_name("shard", df.columns)
    owner = df.sparkSession.createDataFrame([(i, shards[o]) for i, o in enumerate(fill(shards, slots))], f"{slot} int, {shard} string")
    placed = df.withColumn(slot, slot_of(F.col(quoted(key)), slots)).join(F.broadcast(owner), slot)
    return placed.select(*map(quoted, df.columns), slot, shard)


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, slots: int = SLOTS, files: int = 4) -> None:
    """One folder a shard; each shard's rows are dealt to ``files`` writers, so that none takes a whole hot shard."""
    placed = place(df, key, shards, slots)
    slot, shard = placed.columns[-2:]
    placed.repartition(len(shards) * files, shard, F.pmod(F.xxhash64(slot), F.lit(files))).write.partitionBy(shard).parquet(path)
