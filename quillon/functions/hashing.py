"""FNV-1a with 64 bits, as two 32-bit limbs in SQL (no overflow) and as plain Python on the driver."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset basis and prime of FNV-1a 64. Fixed values.
OFFSET, PRIME = 14695981039346656037, 1099511628211


def fnv1a64(data: bytes, state: int = OFFSET) -> int:
    for b in data:
        state = ((state ^ b) * PRIME) % 2**64
    return state


def fnv_limbs(text: Column) -> Column:
    """struct(hi, lo) of the UTF-8 bytes. The prime is 2**40 + 435."""
    raw = text.cast("binary")
    places = F.when(F.octet_length(raw) > 0, F.sequence(F.lit(1), F.octet_length(raw))).otherwise(F.array().cast("array<int>"))
    mask = F.lit(0xFFFFFFFF)

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long")
        x = h["lo"].bitwiseXOR(byte)
        low = x * 435
        high = h["hi"] * 435 + F.shiftrightunsigned(low, 32) + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(high.bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    start = F.struct(F.lit(OFFSET >> 32).cast("long").alias("hi"), F.lit(OFFSET & 0xFFFFFFFF).cast("long").alias("lo"))
    return F.aggregate(places, start, step)


def fnv_hex(text: Column) -> Column:
    h = fnv_limbs(text)
    return F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))


def shard_of(key: Column, num_shards: int) -> Column:
    """fnv1a64(key) modulo num_shards, as an int."""
    h = fnv_limbs(key)
    return ((h["hi"] * (2**32 % num_shards) + h["lo"]) % num_shards).cast("int")


def query_id(vector: list[float], text: str, topk: int, filters: dict[str, str]) -> str:
    """A stable id: the chained hash of text, topk and filters, mixed with that of the vector's bytes."""
    h = fnv1a64(text.encode())
    h = fnv1a64(str(topk).encode(), h)
    for name in ("tag", "source", "lang"):
        h = fnv1a64(filters.get(name, "").encode(), h)
    return f"{h ^ fnv1a64(struct.pack(f'<{len(vector)}f', *vector)):016x}"


def snapshot_id(contract_version: int, seed: int, points: int, deleted: int) -> str:
    h = OFFSET
    for x in (contract_version, seed, points, deleted):
        h = fnv1a64(struct.pack("<q", x), h)
    return f"{h:016x}"
