"""64-bit SimHash of a text (Charikar 2002) over character 4-grams."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 4
BLOCK_CHARS = 400_000   # texts are hashed in blocks of about this size
SLICE_GRAMS = 16_384    # grams whose bits are spread out at once
SLICE_TEXTS = 64        # texts of a batch that are Python strings at once
KNOWN_GRAMS = 1 << 16   # grams a process remembers
LANE_ROWS = 255         # rows that a byte can count


@cache
def _narrow_words() -> np.ndarray:
    return np.array([c.isalnum() or c == "_" for c in map(chr, range(1 << 16))])


def _is_word(codes: np.ndarray) -> np.ndarray:
    r"""Which characters `\w` matches."""
    inside = _narrow_words()[np.minimum(codes, 0xFFFF)]
    wide = np.flatnonzero(codes >= 1 << 16)
    inside[wide] = [chr(c).isalnum() for c in codes[wide].tolist()]
    return inside


def _word(gram: str) -> int:
    return int.from_bytes(hashlib.md5(gram.encode("utf-8", "surrogatepass")).digest()[8:], "big")


_known: dict[int, int] = {}     # words of grams met by this process


def _words(grams: np.ndarray, letters: np.ndarray | None) -> np.ndarray:
    """The word of every gram; `letters` are the codes of numbered characters."""
    if letters is not None:
        codes = letters[grams.astype(">u8").view(">u2").reshape(-1, GRAM)]
        return np.array([_word("".join(map(chr, row)).rstrip("\0")) for row in codes.tolist()], dtype=">u8")
    keys = grams.tolist()
    found = list(map(_known.get, keys))
    if None in found:
        if len(_known) > KNOWN_GRAMS:
            _known.clear()
        for i, key in enumerate(keys):
            if found[i] is None:
                gram = key.to_bytes(2 * GRAM, "big").decode("utf-16-be").rstrip("\0")
                found[i] = _known[key] = _word(gram)
    return np.array(found, dtype=">u8")


def _sums(rows: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the byte lanes of `rows` (eight to a word) over each run of `counts` rows.

    At most 255 rows are added in bytes, which cannot overflow; those sums are added as wide numbers.
    """
    parts = -(-counts // LANE_ROWS)
    ahead = np.cumsum(parts) - parts
    nth = np.arange(int(parts.sum())) - np.repeat(ahead, parts)
    lanes = np.add.reduceat(rows, np.repeat(starts, parts) + nth * LANE_ROWS, axis=0).view(np.uint8)
    return np.add.reduceat(lanes, ahead, axis=0, dtype=np.int64)


def _hash_block(texts: list[str]) -> np.ndarray:
    """SimHash of every text: the majority of each bit over all grams of its word characters."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = _is_word(codes)
    before = np.concatenate([[0], np.cumsum(inside)])
    ends = before[np.cumsum([len(t) for t in lowered])]
    codes = codes[inside]
    return _hash_bodies(codes, np.diff(ends, prepend=0))


def _hash_bodies(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    short = np.maximum(GRAM - sizes, 0)
    if short.any():                 # a body below one gram is filled up
        codes = np.insert(codes, np.repeat(np.cumsum(sizes), short), 0)
        sizes = sizes + short
    letters = None
    if codes.max() >= 1 << 16:      # wide characters are numbered, zero being no letter of a text
        letters, codes = np.unique(codes, return_inverse=True)
        if len(letters) > 1 << 16:
            half = len(sizes) // 2
            if not half:
                return _hash_wide("".join(map(chr, letters[codes])))
            at = int(sizes[:half].sum())
            codes = letters[codes]
            return np.concatenate([_hash_bodies(codes[:at], sizes[:half]), _hash_bodies(codes[at:], sizes[half:])])
    codes = codes.astype(np.uint64)
    counts = sizes - GRAM + 1
    ends = np.cumsum(sizes)
    keys = np.zeros(len(codes) - GRAM + 1, dtype=np.uint64)
    for k in range(GRAM):
        keys = (keys << np.uint64(16)) | codes[k:len(codes) - GRAM + 1 + k]
    inside = np.ones(len(keys), dtype=bool)
    for k in range(1, GRAM):
        inside[ends[:-1] - k] = False
    use, grams = pd.factorize(keys[inside])
    words = _words(grams, letters)
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
    starts = np.cumsum(counts) - counts
    ones = np.empty((len(sizes), 64), dtype=np.int64)
    low = 0
    while low < len(sizes):        # as many texts at once as fill a slice, one at least
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + SLICE_GRAMS)))
        begin, end = starts[low], starts[high - 1] + counts[high - 1]
        ones[low:high] = _ones(bits, use[begin:end], starts[low:high] - begin, counts[low:high])
        low = high
    return np.packbits(ones * 2 > counts[:, None], axis=1).view(">i8").ravel().astype(np.int64)


def _ones(bits: np.ndarray, use: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if len(counts) > 1 or len(use) <= SLICE_GRAMS:
        return _sums(bits[use], starts, counts)
    total = np.zeros((1, 64), dtype=np.int64)
    for i in range(0, len(use), SLICE_GRAMS):
        part = use[i:i + SLICE_GRAMS]
        total += _sums(bits[part], np.array([0]), np.array([len(part)]))
    return total


def _hash_wide(body: str) -> np.ndarray:
    """A text with more distinct characters than a packed gram key can hold."""
    uses = Counter(body[i:i + GRAM] for i in range(len(body) - GRAM + 1))
    words = np.array([_word(g.rstrip("\0")) for g in uses], dtype=">u8")
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1)
    weights = np.fromiter(uses.values(), dtype=np.int64)
    ones = (bits * weights[:, None]).sum(axis=0)
    return np.packbits(ones * 2 > weights.sum()).view(">i8").astype(np.int64)


def hash_texts(texts: Iterable[str | None], n: int | None = None) -> np.ndarray:
    """SimHash of each of `n` texts (all of a list); 0 where there is no text."""
    hashes = np.zeros(len(texts) if n is None else n, dtype=np.int64)
    block, where, size = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        block.append(text)
        where.append(i)
        size += len(block[-1]) + GRAM
        if size >= BLOCK_CHARS:
            hashes[where] = _hash_block(block)
            block, where, size = [], [], 0
    if block:
        hashes[where] = _hash_block(block)
    return hashes


def _strings(texts: pa.Array) -> Iterator[str | None]:
    """The texts of a batch, of which only a few at a time are Python strings."""
    for at in range(0, len(texts), SLICE_TEXTS):
        yield from texts.slice(at, SLICE_TEXTS).to_pylist()


@F.arrow_udf(T.LongType())
def _simhash(texts: pa.Array) -> pa.Array:
    return pa.array(hash_texts(_strings(texts), len(texts)))


def simhash64(text: Column) -> Column:
    """Signed 64-bit SimHash; 0 for an empty text."""
    return _simhash(text)
