"""Watch and block rules matched on source names and texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.arrays import unfold
from tidewire.runtime import cut

GRAM = 3
SLOT_BITS = 16           # the filter of wanted pieces has 1 << SLOT_BITS bits
ABSENT = (1 << 21) - 1   # stands for a character that a piece lacks; no code point is as large
MIX = np.uint64(0x9E3779B97F4A7C15)
BLOCK_CHARS = 400_000    # texts are searched in blocks of about this size
SLICE_TEXTS = 64         # texts of a batch that are Python strings at once
SALTS = 16               # portions of the texts that meet one piece


def _pattern_pieces(pattern: Column) -> Column:
    """Distinct pieces of GRAM characters; a shorter pattern is one piece."""
    places = F.sequence(F.lit(1), F.greatest(F.length(pattern) - (GRAM - 1), F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substring(pattern, i, F.lit(GRAM))))


def _text_pieces(text: Column) -> Column:
    """Distinct pieces of one to GRAM characters in built-in functions, to compare `_text_keys` with.

    The padding lets a piece begin at the last character; shorter pieces are the
    beginnings of the distinct long ones.
    """
    padded = F.concat(text, F.lit("\0" * (GRAM - 1)))
    long = F.array_distinct(F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(long, lambda x: F.array(*[F.left(x, F.lit(n)) for n in range(1, GRAM + 1)]))))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each followed by one ABSENT, and where the texts begin."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    codes = np.frombuffer((" ".join(texts) + " " * GRAM).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    codes[ends - 1] = ABSENT
    codes[ends[-1]:] = ABSENT
    return codes, ends - sizes


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys * MIX) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _text_keys(texts: list[str], wanted: np.ndarray) -> list[np.ndarray]:
    """Distinct keys of the pieces of one to GRAM characters of each text that `wanted` may hold.

    A key is the code points of a piece, ABSENT for each that it lacks.
    """
    codes, starts = _codes(texts)
    n = len(codes) - GRAM
    at, keys = [], []
    for size in range(1, GRAM + 1):
        key = np.full(n, (1 << 21 * (GRAM - size)) - 1, dtype=np.uint64)
        for k in range(size):
            key |= codes[k:n + k] << np.uint64(21 * (GRAM - 1 - k))
        hit = np.flatnonzero(wanted[_slots(key)])
        for k in range(size):       # no piece reaches beyond its text
            hit = hit[codes[hit + k] != ABSENT]
        at.append(hit)
        keys.append(key[hit])
    place, keys = np.searchsorted(starts, np.concatenate(at), side="right") - 1, np.concatenate(keys).view(np.int64)
    order = np.lexsort((keys, place))
    place, keys = place[order], keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (keys[1:] != keys[:-1])
    place, keys = place[new], keys[new]
    return np.split(keys, np.searchsorted(place, np.arange(1, len(texts))))


def piece_key(piece: str) -> int:
    """The key of one piece."""
    key = 0
    for code in [*map(ord, piece), *[ABSENT] * (GRAM - len(piece))]:
        key = key << 21 | code
    return key


@F.arrow_udf(T.LongType())
def _piece_key(pieces: pa.Array) -> pa.Array:
    return pa.array([piece_key(p) for p in pieces.to_pylist()], pa.int64())


@F.arrow_udf(T.ShortType())
def _slot(keys: pa.Array) -> pa.Array:
    return pa.array((_slots(keys.to_numpy(zero_copy_only=False).view(np.uint64)) - (1 << SLOT_BITS - 1)).astype(np.int16))


def _wanted_keys(wanted: np.ndarray):
    """Expression of the wanted keys in a text."""
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def keys(texts: pa.Array) -> pa.Array:
        found: list[np.ndarray] = []
        block, size = [], 0
        for at in range(0, len(texts), SLICE_TEXTS):
            for text in texts.slice(at, SLICE_TEXTS).to_pylist():
                block.append(text)
                size += len(text) + 1
                if size >= BLOCK_CHARS:
                    found += _text_keys(block, wanted)
                    block, size = [], 0
        if block:
            found += _text_keys(block, wanted)
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))

    return keys


def _bit_set(pieces: DataFrame) -> np.ndarray:
    """One truth value a slot, whatever the number of pieces."""
    wanted = np.zeros(1 << SLOT_BITS, dtype=bool)
    slots = pieces.select(_slot(F.col("gram")).alias("slot")).distinct().collect()     # at most 1 << SLOT_BITS rows
    wanted[[r["slot"] + (1 << SLOT_BITS - 1) for r in slots]] = True
    return wanted


def _posted(texts: DataFrame, key: str, pieces: DataFrame) -> DataFrame:
    """(key, gram) of the pieces of every text that may be among `pieces`."""
    return unfold(texts, [key], _wanted_keys(_bit_set(pieces))(F.col("_t")), "_at", "gram").drop("_at")


def rule_hits(articles: DataFrame, rules: DataFrame, key: str, field: str) -> DataFrame:
    """(key, columns of the rule) for every enabled rule whose pattern is in `field`.

    A text that holds a pattern holds each of its pieces of GRAM characters. Texts are
    read twice: the first pass only counts the pieces that patterns have, the second
    gives out the rarest piece of each pattern, and what that finds is checked. Pieces
    are whole numbers, found in arrays of code points; a bit set of fixed size keeps
    other pieces from becoming rows. Texts meet a piece in
    portions, so a common piece whose pattern has no other is not one group. One path
    for any number of rules and any length of pattern and text.
    """
    live = rules.where("is_enabled AND pattern <> ''").withColumn("pattern", F.lower("pattern")).withColumn(
        "priority", F.coalesce("priority", F.lit(0)))
    pieces = live.select("pattern").distinct().select("pattern", F.explode(_pattern_pieces(F.col("pattern"))).alias("gram"))
    wanted = cut(pieces.withColumn("gram", _piece_key(F.col("gram"))))
    texts = articles.select(key, F.lower(F.coalesce(F.col(field), F.lit(""))).alias("_t"))
    uses = _posted(texts, key, wanted).groupBy("gram").agg(F.count("*").alias("uses"))
    complete = wanted.join(uses, "gram", "left").groupBy("pattern").agg(
        F.min_by("gram", F.struct("uses", "gram")).alias("gram"), F.count("*").alias("n"), F.count("uses").alias("found"))
    rarest = cut(complete.where("n = found").select("pattern", "gram"))     # a piece that no text holds rules its pattern out
    dealt = rarest.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = _posted(texts, key, rarest).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    found = (met.join(dealt, ["gram", "_salt"]).join(texts, key)
             .where(F.contains(F.col("_t"), F.col("pattern"))).select(key, "pattern").distinct())
    return found.join(live, "pattern").drop("pattern", "is_enabled")


def apply_rules(articles: DataFrame, watch: DataFrame, block: DataFrame, key: str, text: str,
                source: str) -> DataFrame:
    """Hide blocked articles and give watched ones the highest priority that matches."""
    rules = watch.select("rule_id", "type", "pattern", "is_enabled", "priority", F.lit(False).alias("_block")).union(
        block.select("rule_id", "type", "pattern", "is_enabled", F.lit(0), F.lit(True)))
    hits = rule_hits(articles, rules.where("type = 'keyword'"), key, text).unionByName(
        rule_hits(articles, rules.where("type = 'source'"), key, source))
    verdict = hits.groupBy(key).agg(F.bool_or("_block").alias("_hide"), F.max(F.when(~F.col("_block"), F.col("priority"))).alias("watch_priority"))
    return (articles.join(verdict, key, "left").where(~F.coalesce("_hide", F.lit(False))).drop("_hide")
            .withColumn("pinned", F.col("watch_priority").isNotNull())
            .withColumn("watch_priority", F.coalesce("watch_priority", F.lit(0))))
