"""Operator 4: sharding by a permutation-filled lookup table (native).

Each shard has a preference order over the slots of a table of prime size:
``(offset + j * skip) mod size`` for j = 0, 1, ...; offset and skip come from a
hash of its name.  Shards take turns and claim their next free slot until the
table is full, a shard of weight w taking w turns a round.  A key's slot is its
hash modulo the size, and the slot's owner is its shard, so placement is one
lookup, shares differ by a slot or so, and when a shard leaves or joins few
keys of the others move.

The table's size is a parameter (a prime over 100 slots a shard by default),
whatever the input; it reaches the tasks as an array in the plan.  Placement
is a projection: nothing is shuffled, so hot keys need no care.

Defined results: a null key is placed by the hash of the empty text; equal keys
share a shard; an empty table gives an empty table; columns of the input that
are named like the added ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 16
SLOTS_PER_SHARD = 100


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def table_size(shards: int, per_shard: int = SLOTS_PER_SHARD) -> int:
    """The least prime above ``shards * per_shard``."""
    n = shards * per_shard + 1
    while not is_prime(n):
        n += 1
    return n


def number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def lookup_table(shards: Sequence[str] | Mapping[str, int], size: int | None = None) -> list[int]:
    """Slot -> index of the shard that owns it; a mapping gives weights (turns a round)."""
    names = list(shards)
    turns = [shards[n] if isinstance(shards, Mapping) else 1 for n in names]
    if len(set(names)) != len(names) or not names or min(turns) < 0 or not any(turns):
        raise ValueError("shards need distinct names, and one of them a positive weight")
    size = size or table_size(sum(turns))
    if not is_prime(size):
        raise ValueError("the table's size must be a prime")
    offset = [number(f"offset:{n}") % size for n in names]
    skip = [number(f"skip:{n}") % (size - 1) + 1 if size > 2 else 1 for n in names]
    owner, at, free = [-1] * size, [0] * len(names), size
    while free:
        for i, n in enumerate(turns):
            for _ in range(min(n, free)):
                while owner[slot := (offset[i] + at[i] * skip[i]) % size] >= 0:
                    at[i] += 1
                owner[slot] = i
                at[i] += 1
                free -= 1
    return owner


def key_slot(key: Column, size: int) -> Column:
    """Slot of a key: the first 15 hexadecimal digits of its MD5 modulo the size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(size))


def assign(df: DataFrame, key: str, shards: Sequence[str] | Mapping[str, int], size: int | None = None) -> DataFrame:
    """``df`` plus ``slot`` and ``shard`` (the index in ``shards``) of each row's key."""
    owner = lookup_table(shards, size)
    table = F.split(F.lit(",".join(map(str, owner))), ",").cast("array<int>")  # folded to one array by the optimizer
    return df.withColumn("slot", key_slot(F.col(key), len(owner))).withColumn("shard", F.get(table, F.col("slot").cast("int")))


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def oracle(n: int = SHARDS) -> str:
    """The placement of ``documents`` as SQL over the same table."""
    owner = lookup_table(shard_names(n))
    return (f"SELECT doc_id, slot, [{', '.join(map(str, owner))}][slot + 1] AS shard FROM (SELECT doc_id, "
            f"CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {len(owner)} AS BIGINT) AS slot FROM documents)")
