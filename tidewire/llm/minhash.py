"""Near-duplicate groups by b-bit MinHash, band candidates and full-set confirmation.

1. Every text becomes the set of its five-word shingles (64-bit hashes). 128 minima
   give 32 band keys of four minima each; two bits of each mixed minimum are packed
   into four longs. Equal sets are one class with its smallest doc_id as representative,
   so copies never meet in a pair.
2. Representatives that share a band key are candidates. In each bucket all are paired
   with the smallest one (a star, so a bucket of m gives m - 1 pairs). A pair's
   similarity is estimated from the bit counts of the packed signatures, corrected for
   chance agreement; pairs far below the threshold go, the rest is confirmed on the
   full sets, and confirmed links join classes into components.
3. Buckets that still hold several components are searched again: every pair across
   components is estimated, in blocks of bounded size, and confirmed if it may link.
   Pairs inside one component cannot change the result. Here the estimate is a finer one,
   from a bit of 4096 mixed minima, so few pairs that do not link need their texts.

The kept bits are those of a mixed value, seeded per hash: the low bits of a * x + b depend
on the low bits of x alone, so those of different minima would agree in all hashes at once.

At the threshold of 0.75 a pair misses all 32 bands with probability 5e-6; the margins
below it are over five standard deviations of either estimate.

Null and empty texts have no shingles and are linked with nothing; so are rows without
a doc_id. Repeated rows are classed together and each returned. Ties cannot occur: the
representative is the smallest doc_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.catalog import query, table
from tidewire.llm.common import all_pairs_sql, documents_like, map_rows
from tidewire.runtime import cut

WORDS = 5
PERCENT = 75             # least similarity, in hundredths
BANDS, ROWS = 32, 4
MARGIN = 0.25            # an estimate may lie so far below the threshold
FINE_BITS, FINE_MARGIN = 4096, 0.055
BLOCK = 1024             # representatives of a bucket compared at a time
SLICE_BYTES = 1 << 22

_HASHES = BANDS * ROWS
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_A = _rng.integers(0, 1 << 32, _HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, _HASHES, dtype=np.uint32)
_FINE_A = _rng.integers(0, 1 << 32, FINE_BITS, dtype=np.uint32) | np.uint32(1)
_FINE_B = _rng.integers(0, 1 << 32, FINE_BITS, dtype=np.uint32)
_SEED, _FINE_SEED = (_rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (_HASHES, FINE_BITS))
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _position_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for positions below n."""
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _tables:
        _tables.clear()
        _tables[size] = _powers(int(_P), size), _powers(pow(int(_P), -1, 1 << 64), size)
    return _tables[size]


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of `words` words of each text."""
    out: list[np.ndarray] = []
    held, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        held.append(raw)
        size += len(raw)
        if size >= SLICE_BYTES:
            out += _shingle_slice(held, words)
            held, size = [], 0
    return out + _shingle_slice(held, words)


def _shingle_slice(raws: list[bytes], words: int) -> list[np.ndarray]:
    if not raws:
        return []
    data = np.frombuffer(b" ".join(raws) + b" ", dtype=np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))     # a word starts, then ends, in turn
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _position_powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[:len(data)], dtype=np.uint64)])
        word = _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        shingle = word[:len(word) - words + 1].copy() if len(word) >= words else word[:0]
        for k in range(1, words):
            shingle = shingle * _Q + word[k:len(word) - words + 1 + k] if len(shingle) else shingle
        shingle = _mixed(shingle)
        first = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raws]))
        out = []
        for a, b in zip(first.tolist(), first[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(shingle[a:b - words + 1]))
            elif b > a:
                whole = np.uint64(b - a)
                for w in word[a:b]:
                    whole = whole * _Q + w
                out.append(_mixed(np.array([whole])))
            else:
                out.append(word[:0])
    return out


def minima(sets: list[np.ndarray], a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """(sets, hashes) smallest values; every set must have a member."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), len(a)), dtype=np.uint32)
    value = np.empty_like(x)
    for k in range(len(a)):
        np.multiply(x, a[k], out=value)
        value += b[k]
        out[:, k] = np.minimum.reduceat(value, starts)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """(sets, bands) keys; equal only where all minima of the band are."""
    each = low.reshape(len(low), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), each.shape[:2])
        for k in range(ROWS):
            key = _mixed(key * _Q + each[:, :, k])
    return key.view(np.int64)


def _bits(low: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    """The highest `n` bits of the minima, mixed with a seed per hash."""
    x = low ^ seed
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x >>= np.uint32(32 - n)
    return x


def packed(low: np.ndarray) -> np.ndarray:
    """(sets, 4) longs with two bits of all minima."""
    bits = _bits(low, _SEED, 2).astype(np.uint64).reshape(len(low), 4, 32)
    return np.bitwise_or.reduce(bits << (2 * np.arange(32, dtype=np.uint64)), axis=2).view(np.int64)


def _portions(sets: list[np.ndarray], most: int):
    """Runs (start, end) of sets that hold about `most` members at the most."""
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= most):
            size += len(sets[to])
            to += 1
        yield at, to
        at = to


def fine(texts: DataFrame) -> DataFrame:
    """doc_id, fine: a bit of many minima, packed; for texts with words."""
    def run(doc_id, text):
        sets, out = shingle_sets(text), []
        for at, to in _portions(sets, 1 << 16):
            low = minima(sets[at:to], _FINE_A, _FINE_B)
            for start in range(0, len(low), 256):
                bits = _bits(low[start:start + 256], _FINE_SEED, 1).astype(np.uint8)
                out += [row.tobytes() for row in np.packbits(bits, axis=1)]
        return {"doc_id": doc_id, "fine": out}
    return map_rows(texts, ["doc_id", "text"], run, "doc_id bigint, fine binary")


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key, bands, s0..s3; sketches are null for empty sets."""
    def run(doc_id, text):
        sets = shingle_sets(text)
        full = [i for i, s in enumerate(sets) if len(s)]
        out = {"doc_id": doc_id, "n_shingles": [len(s) for s in sets],
               "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
               "bands": [None] * len(sets), **{f"s{k}": [None] * len(sets) for k in range(4)}}
        for at, to in _portions([sets[i] for i in full], SLICE_BYTES // 8):
            low = minima([sets[i] for i in full[at:to]])
            keys, signature = band_keys(low).tolist(), packed(low).tolist()
            for i, k, s in zip(full[at:to], keys, signature):
                out["bands"][i] = k
                for n in range(4):
                    out[f"s{n}"][i] = s[n]
        return out
    return map_rows(docs.select(*documents_like()), ["doc_id", "text"], run,
                    "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>,"
                    " s0 bigint, s1 bigint, s2 bigint, s3 bigint")


_FIVES = 0x5555555555555555


def estimate(a: str, b: str) -> Column:
    """Similarity from the share of agreeing bits, corrected for agreement by chance."""
    differing = F.lit(0)
    for k in range(4):
        x = F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))
        differing = differing + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_FIVES)))
    return (1 - differing / float(_HASHES) - 0.25) / 0.75


def _least_estimate() -> float:
    return PERCENT / 100 - MARGIN


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    def run(batches):
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in ("text_a", "text_b"))
            known: dict[str, np.ndarray] = {}
            fresh = list(dict.fromkeys(left + right))
            known.update(zip(fresh, shingle_sets(fresh)))
            keep = [linked(known[x], known[y]) for x, y in zip(left, right)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of the links (a, b).

    Each round hooks every node to its smallest neighbour, follows those hooks four
    steps, and contracts the links; rounds are logarithmic in practice and end when no
    link is left between different nodes.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    labels = cut(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
                 .withColumn("component", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        hooks = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to"))
        hooks = cut(hooks)
        for _ in range(2):
            nxt = hooks.select(F.col("u").alias("to"), F.col("to").alias("further"))
            hooks = hooks.join(nxt, "to").select("u", F.col("further").alias("to"))
        hooks = cut(hooks)
        labels = cut(labels.join(hooks.withColumnRenamed("u", "component"), "component", "left")
                     .select("node", F.coalesce("to", "component").alias("component")))
        moved = (edges.join(hooks, "u").select("v", F.col("to").alias("x"))
                 .join(hooks.withColumnRenamed("u", "v"), "v").select("x", F.col("to").alias("y")).where("x <> y"))
        edges = cut(moved.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    return labels


def _across(members: DataFrame) -> DataFrame:
    """Pairs (a, b) across components of a bucket whose estimate may reach the threshold.

    members: key, doc_id, component, fine, bands, size (of the bucket). Buckets are cut
    into blocks; every pair of blocks is one group of bounded size, compared in numpy. A
    pair that shares several buckets is given out in the first of them.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    spread = members.withColumn("block", own).select(
        "*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "doc_id", "component", "fine", "bands")

    def compare(rows: dict[str, np.ndarray], i: int, j: int):
        left, right = np.flatnonzero(rows["block"] == i), np.flatnonzero(rows["block"] == j)
        signature = np.frombuffer(b"".join(rows["fine"]), dtype=np.uint64).reshape(len(rows["fine"]), -1)
        bands = np.stack(rows["bands"])
        for start in range(0, len(left), 64):
            part = left[start:start + 64]
            differing = np.bitwise_count(signature[part][:, None] ^ signature[right][None]).sum(axis=2)
            good = 1 - 2 * differing / FINE_BITS >= PERCENT / 100 - FINE_MARGIN
            good &= rows["component"][part][:, None] != rows["component"][right][None]
            good &= (rows["doc_id"][part][:, None] > rows["doc_id"][right][None]) | (i != j)
            p, q = (index[side] for index, side in zip((part, right), np.nonzero(good)))
            shared = bands[p] == bands[q]
            first = bands[p, shared.argmax(axis=1)] == rows["key"][0] if len(p) else np.zeros(0, dtype=bool)
            yield rows["doc_id"][p[first]], rows["doc_id"][q[first]]

    names = ["key", "i", "j", "block", "doc_id", "component", "fine", "bands"]

    def run(batches):
        def emit(held):
            rows = {n: np.concatenate([h[n] for h in held]) for n in names}
            for a, b in compare(rows, rows["i"][0], rows["j"][0]):
                yield pa.RecordBatch.from_pydict({"a": a, "b": b})

        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            rows = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            change = np.flatnonzero((np.diff(rows["key"]) != 0) | (np.diff(rows["i"]) != 0) | (np.diff(rows["j"]) != 0)) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows]):
                part = {n: rows[n][a:b] for n in names}
                if held and any(held[0][n][0] != part[n][0] for n in ("key", "i", "j")):
                    yield from emit(held)
                    held = []
                held.append(part)
        if held:
            yield from emit(held)

    return (spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .mapInArrow(run, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs`."""
    sketches = cut(sketched(docs))
    keyed = sketches.where("set_key is not null and doc_id is not null")
    classes = cut(keyed.groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    reps = keyed.join(classes, (keyed["set_key"] == classes["set_key"]) & (keyed["doc_id"] == classes["rep"])).select(
        "doc_id", "bands", "s0", "s1", "s2", "s3").dropDuplicates(["doc_id"])
    reps = cut(reps)

    posted = reps.select(F.explode("bands").alias("key"), "doc_id")
    buckets = posted.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    members = cut(posted.join(buckets, "key"))
    signatures = reps.select("doc_id", "s0", "s1", "s2", "s3")
    involved = members.select("doc_id").distinct()
    texts = cut(docs.select(*documents_like()).join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id"]))

    star = members.where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    a, b = signatures.alias("x"), signatures.alias("y")
    star = (star.join(a, F.col("a") == F.col("x.doc_id")).join(b, F.col("b") == F.col("y.doc_id"))
            .where(estimate("x", "y") >= _least_estimate()).select("a", "b"))
    links = cut(_confirmed(star, texts))
    joined = components(links)

    labelled = members.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", "size", F.coalesce("component", "doc_id").alias("component"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(
        "low <> high").select("key")
    open_members = cut(labelled.join(mixed, "key"))
    finer = cut(fine(texts.join(open_members.select("doc_id").distinct(), "doc_id", "left_semi")))
    open_members = open_members.join(finer, "doc_id").join(reps.select("doc_id", "bands"), "doc_id")
    more = cut(_confirmed(cut(_across(open_members)), texts))
    if not more.isEmpty():
        joined = components(links.union(more))

    rep_of = classes.join(joined, classes["rep"] == joined["node"], "left").select(
        "set_key", F.coalesce("component", "rep").alias("component_id"))
    found = sketches.select("doc_id", "n_shingles", "set_key").join(rep_of, "set_key", "left")
    has_id = F.col("doc_id").isNotNull()
    component = F.when(has_id, F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


@query("op3_minhash", all_pairs_sql(WORDS, PERCENT, "doc_id, n_shingles, component_id, doc_id = component_id AS kept"))
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
