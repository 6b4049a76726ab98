"""Bit sets of hashed keys, small enough for a plan, to thin out a large side before a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 17          # bits of a set: 16 kB in the plan
PROBES = 2


def _slots(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(n)), F.lit(SLOTS)).cast("int") for n in range(PROBES)]


def bit_set(keys: DataFrame, key: str) -> list[int]:
    """SLOTS bits as longs, whatever the number of keys; null keys are left out."""
    slots = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*_slots(F.col(key)))).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits"))
    known = {r["word"]: r["bits"] for r in words.collect()}       # at most SLOTS / 64 rows
    return [known.get(k, 0) for k in range(SLOTS // 64)]


def may_hold(bits: list[int], key: Column) -> Column:
    """False only for keys that are not in the set; false for null."""
    words, found = F.lit(bits).cast("array<bigint>"), key.isNotNull()
    for slot in _slots(key):
        found = found & (F.getbit(F.get(words, F.shiftright(slot, 6)), slot.bitwiseAND(63)) == 1)
    return found
