"""Sharding: permutation-filled lookup table (native).

Every shard has a permutation of the slots of a prime-sized table, drawn from
two hashes of its name (an offset and a step). The shards take turns claiming
the next free slot of their permutation until the table is full, so that the
shards' shares differ by at most one turn and few slots change owner when a
shard joins or leaves. A key goes to the owner of its hash modulo the size.

Scale: the table has ``size`` rows whatever the data, so it is broadcast; a
row's placement is one hash and one lookup, with no shuffle. Hot sources do
not matter since the key is hashed row by row.

Defined results: a null key goes to the slot of the empty string; equal keys
go to equal shards; clashing columns ``slot`` and ``shard`` are replaced;
an empty input gives an empty result. A shard of weight w takes w turns at a
time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], size: int = SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """The owner (position in ``shards``) of each slot; ``size`` is a prime.

    Bounded work on the driver: ``size`` claims, whatever the data.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be non-empty and distinct")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime")
    turns = [(weights or {}).get(s, 1) for s in shards]
    if min(turns) < 1:
        raise ValueError("weights must be positive")
    at = [_number("offset " + s) % size for s in shards]
    step = [_number("step " + s) % (size - 1) + 1 for s in shards]
    owner, left = [-1] * size, size
    while left:
        for i, n in enumerate(turns):
            for _ in range(min(n, left)):
                while owner[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % size
                owner[at[i]] = i
                left -= 1
    return owner


def slot_of(key: Column, size: int = SIZE) -> Column:
    """The slot of a key: 60 bits of its MD5 modulo ``size``."""
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(size)).cast("int")


def lookup_table(spark, shards: list[str], size: int = SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """(slot, shard), one row for each of the ``size`` slots."""
    owners = F.split(F.lit(",".join(map(str, fill(shards, size, weights)))), ",")
    names = F.split(F.lit("\n".join(shards)), "\n")
    slots = spark.range(0, size, 1, 1).select(F.col("id").cast("int").alias("slot"))
    return slots.select("slot", F.get(names, F.get(owners, F.col("slot")).cast("int")).alias("shard"))


def place(df: DataFrame, key: str, shards: list[str], size: int = SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` of its column ``key``."""
    placed = df.withColumn("slot", slot_of(df[key], size))
    owners = F.broadcast(lookup_table(df.sparkSession, shards, size, weights))  # exactly ``size`` rows
    kept = [c for c in placed.columns if c.lower() not in ("slot", "shard")]
    return placed.select(*kept, "slot").join(owners, "slot").select(*kept, "slot", "shard")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    from provgraph.llm.common import table

    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", list(SHARDS))


def oracle() -> str:
    """The placement in SQL; the owners are filled here by the plain rule."""


    def preference(s: str):
        offset, step = (int(hashlib.md5(f"{w} {s}".encode()).hexdigest()[:15], 16) for w in ("offset", "step"))
        return ((offset + j * (step % (SIZE - 1) + 1)) % SIZE for j in range(SIZE))

    prefs = [preference(s) for s in SHARDS]
    owner: dict[int, str] = {}
    while len(owner) < SIZE:
        for s, pref in zip(SHARDS, prefs):
            if len(owner) < SIZE:
                owner[next(x for x in pref if x not in owner)] = s
    listed = ",".join(owner[i][6:] for i in range(SIZE))
    return f"""
WITH owners AS (SELECT string_split('{listed}', ',') AS o),
placed AS (SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) % {SIZE} AS slot FROM documents)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, 'shard-' || o[slot + 1] AS shard FROM placed, owners"""
