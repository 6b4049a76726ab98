"""Words of many texts as positions and 64-bit hashes, in a few numpy passes over the bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.minhash import _BYTE, _Q, _SPACE, _mixed, _position_powers


def words_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the parts joined by line feeds, starts, ends, hashes of the words between white space)."""
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[data], prepend=True))     # a word starts, then ends, in turn
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _position_powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[:len(data)], dtype=np.uint64)])
        word = _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return data, starts, ends, word


def gram_hashes(word: np.ndarray, order: int, seed: np.ndarray) -> np.ndarray:
    """Hash of the `order` words from each position on (with the seed there); short by order - 1."""
    n = max(0, len(word) - order + 1)
    with np.errstate(over="ignore"):
        out = seed[:n] + word[:n]
        for k in range(1, order):
            out = out * _Q + word[k:k + n]
        return _mixed(out)


def taken_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, order: int) -> pa.Array:
    """The `order` words from each of `rows` on, joined by one space."""
    each = (rows[:, None] + np.arange(order)).ravel()
    begin, size = starts[each], ends[each] - starts[each] + 1      # and the byte after the word, which becomes a space
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    out = data[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)]
    out[offsets[1:] - 1] = 0x20
    last = np.zeros(len(out), dtype=bool)
    last[offsets[order::order] - 1] = True                         # no space after the last word
    bounds = offsets[::order] - np.arange(len(rows) + 1)
    return pa.Array.from_buffers(pa.string(), len(rows), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()),
                                                          pa.py_buffer(out[~last].tobytes())])


class Bits:
    """A bitmap of 64-bit hashes by their leading bits: never false for a hash that is in it."""

    def __init__(self, raw: bytes):
        self.raw = np.frombuffer(raw, dtype=np.uint8)
        self.shift = np.uint64(64 - (len(raw) * 8 - 1).bit_length())

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.raw[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def collected_bits(numbers: DataFrame, bits: int) -> bytes:
    """The bitmap of the numbers in column `bit` (from 1): 2**bits bits, whatever the table's size."""
    kept = numbers.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    raw = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for bucket, part in kept.collect():      # at most 2**bits / 32768 rows of 4 kB
        raw[(bucket - 1) * 4096:bucket * 4096] = np.frombuffer(bytes(part), dtype=np.uint8)
    return raw.tobytes()
