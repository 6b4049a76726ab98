"""Packing token sequences into windows by non-negative least squares.

A document's ids (its text and one end id) are cut into full windows and one rest
shorter than a window. The histogram of the rests (one count per length, so its size
is fixed by the window) is all that reaches the driver. There, shallow combinations
of two or three lengths that fill a window exactly are enumerated, and repeat counts
x >= 0 with A x close to the histogram are found by an active-set solver, whose
solutions use no more combinations than there are lengths. Counts are rounded down
to what is available, a greedy pass reuses combinations on what is left, and the last
rests are strung together and cut at window borders; the end of that string is cut
into powers of two, which need no padding.

Positions come from per-task counters plus one small table of offsets per task, so
no task sees more than its own rows, however often one length occurs. Every piece
carries the crc of its ids, taken while they are at hand; only rests that are cut
again are read back.

A null or empty text is one end id. Repeated rows are packed each. An empty table
gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.llm import words
from tidewire.llm.catalog import query, table
from tidewire.llm.common import documents_like
from tidewire.runtime import cut

WINDOW = 1024
END_ID = 0

ROWS = ("part int, at bigint, doc_id bigint, doc_tokens bigint, full_before bigint, full_crcs array<bigint>,"
        " length int, nth bigint, rest_crc bigint, rest binary")
PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
          " sequence_id bigint, offset bigint")


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def tokenised(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per document: counts, crcs of its full windows, its rest, and the task's running counts."""
    schema = _arrow(ROWS)

    def run(batches):
        part, at, full = TaskContext.get().partitionId(), 0, 0
        nth = np.zeros(window, dtype=np.int64)
        encoder = words.word_tokenizer(path, lower=False)
        for batch in batches:
            out = {name: [] for name in schema.names}
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(),
                                   encoder.encode([t or "" for t in batch.column("text").to_pylist()])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                whole, length = divmod(len(ids), window)
                rest = ids[whole * window:]
                for name, value in zip(schema.names, (
                        part, at, doc_id, len(ids), full,
                        [zlib.crc32(ids[i * window:(i + 1) * window].tobytes()) for i in range(whole)],
                        length, int(nth[length]), zlib.crc32(rest.tobytes()), rest.tobytes())):
                    out[name].append(value)
                at, full = at + 1, full + whole
                nth[length] += 1
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return docs.select(*documents_like()).mapInArrow(run, ROWS)


# ---- combinations and their counts ------------------------------------------------------------------------------

def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of two or three of the given lengths that add up to the window; a missing third is 0."""
    have = np.zeros(window + 1, dtype=bool)
    have[lengths] = True
    first = np.sort(lengths)
    pairs = [(i, window - i, 0) for i in first if 2 * i <= window and have[window - i]]
    triples = []
    for i in first[3 * first <= window]:
        j = first[(first >= i) & (2 * first <= window - i)]
        j = j[have[window - i - j]]
        triples.append(np.stack([np.full(len(j), i), j, window - i - j], axis=1))
    return np.concatenate([np.array(pairs, dtype=np.int64).reshape(-1, 3), *triples]).astype(np.int64)


def _columns(items: np.ndarray, height: int) -> np.ndarray:
    dense = np.zeros((height, len(items)))
    for k in range(items.shape[1]):
        np.add.at(dense, (items[:, k], np.arange(len(items))), 1.0)
    dense[0] = 0.0
    return dense


def non_negative_least_squares(items: np.ndarray, target: np.ndarray, rounds: int = 80, block: int = 24) -> np.ndarray:
    """x >= 0 with least |A x - target|; column j of A counts the lengths in items[j].

    Active-set method: columns with the steepest descent join the passive set in
    small blocks, and the unconstrained solution is pulled back to x >= 0 until it is
    feasible. It starts from the pairs, which do not overlap, and ends when four blocks
    together have not brought the misfit down by a hundredth.
    """
    x = np.zeros(len(items))
    misfits: list[float] = []
    if not len(items):
        return x
    passive = np.flatnonzero(items[:, 2] == 0)
    x[passive] = 1e-9
    for _ in range(rounds):
        while len(passive):
            a = _columns(items[passive], len(target))
            new = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(passive)), a.T @ target)
            if (new > 0).all():
                x[:] = 0
                x[passive] = new
                break
            low = new <= 0
            pull = (x[passive][low] / np.maximum(x[passive][low] - new[low], 1e-300)).min()
            x[passive] += pull * (new - x[passive])
            drop = low & (x[passive] <= 1e-8)
            if not drop.any():
                drop = low & (new == new[low].min())
            x[passive[drop]] = 0
            passive = passive[~drop]
        missing = target - (np.bincount(items.ravel(), weights=np.repeat(x, 3), minlength=len(target)))
        missing[0] = 0
        misfits.append(float(missing @ missing))
        if len(misfits) > 4 and misfits[-1] > 0.99 * misfits[-5]:
            break
        gain = missing[items].sum(axis=1)
        gain[passive] = 0
        order = np.argsort(-gain, kind="stable")[:block * 8]
        taken, used = [], set()
        for j in order:
            if gain[j] <= 0.5 or len(taken) == block:
                break
            if not used & set(items[j].tolist()) - {0}:
                taken.append(j)
                used |= set(items[j].tolist())
        if not taken:
            break
        passive = np.concatenate([passive, np.array(taken)])
    return x


def repeat_counts(histogram: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, how often each is used); never more of a length than there are rests of it."""
    lengths = np.flatnonzero(histogram[:window])
    items = combinations(lengths[lengths > 0], window)
    left = histogram[:window].astype(np.int64).copy()
    counts = np.floor(non_negative_least_squares(items, left.astype(float)) + 1e-6).astype(np.int64)

    def use(j: int, wanted: int) -> int:
        need: dict[int, int] = {}
        for length in items[j]:
            if length:
                need[int(length)] = need.get(int(length), 0) + 1
        n = int(min([wanted] + [left[length] // k for length, k in need.items()]))
        for length, k in need.items():
            left[length] -= k * n
        return n

    used = np.zeros(len(items), dtype=np.int64)
    for j in np.argsort(-counts, kind="stable"):
        if counts[j] == 0:
            break
        used[j] = use(j, counts[j])
    for j in np.flatnonzero((left[items] > 0).sum(axis=1) == (items > 0).sum(axis=1)):   # greedy pass on what is left
        used[j] += use(j, int(left.max()))
    kept = np.flatnonzero(used)
    return items[kept], used[kept]


class Slots:
    """Which sequence and offset the n-th rest of a length gets; beyond `taken` it is left over."""

    def __init__(self, items: np.ndarray, counts: np.ndarray, window: int):
        first = np.concatenate([[0], np.cumsum(counts)])
        self.sequences = int(first[-1])
        self.taken = np.zeros(window + 1, dtype=np.int64)
        keys, sequence, offset = [], [], []
        for item, n, base in zip(items, counts, first):
            at = 0
            for length in item:
                if length:
                    keys.append((int(length) << 40) + int(self.taken[length]))
                    sequence.append(int(base))
                    offset.append(at)
                    self.taken[length] += n
                    at += int(length)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.sequence = np.array(sequence, dtype=np.int64)[order]
        self.offset = np.array(offset, dtype=np.int64)[order]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of rests with rank < taken[length]."""
        key = (length.astype(np.int64) << 40) + rank
        at = np.searchsorted(self.keys, key, side="right") - 1
        return self.sequence[at] + key - self.keys[at], self.offset[at]


def tail_borders(total: int, window: int) -> list[int]:
    """Ends of the sequences that the last, unfilled window is cut into: powers of two."""
    borders, at = [], total - total % window
    for bit in reversed(range(max(1, window.bit_length()))):
        if (total % window) >> bit & 1:
            at += 1 << bit
            borders.append(at)
    return borders


# ---- the operator -----------------------------------------------------------------------------------------------

def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = cut(tokenised(docs, path, window, end_id))
    groups = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(groups.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    histogram = np.zeros(window + 1, dtype=np.int64)
    for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect():      # at most `window` rows
        histogram[r["length"]] = r["n"]
    histogram[0] = 0
    slots = Slots(*repeat_counts(histogram, window), window)

    tasks = rows.groupBy("part").agg(F.max(F.col("full_before") + F.size("full_crcs")).alias("full"))
    in_order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)    # one row per task of the scan
    tasks = cut(tasks.withColumn("full_offset", F.coalesce(F.sum("full").over(in_order), F.lit(0))))
    full = tasks.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]

    placed = (rows.drop("rest", "at").join(offsets.select("part", "length", "before"), ["part", "length"])
              .join(tasks.select("part", "full_offset"), "part"))
    taken = F.array(*[F.lit(int(n)) for n in slots.taken])
    whole = _placed_pieces(placed, slots, full, window)
    rest = rows.where("length > 0").join(
        offsets.select("part", "length", "before").where(F.col("before") + F.col("n") > F.get(taken, F.col("length"))),
        ["part", "length"]).where(F.col("before") + F.col("nth") >= F.get(taken, F.col("length")))
    left = int((histogram * np.arange(window + 1)).sum() - (slots.taken * np.arange(window + 1)).sum())
    return whole.unionByName(_strung_pieces(rest, left, full + slots.sequences, window))


def _placed_pieces(placed: DataFrame, slots: Slots, full: int, window: int) -> DataFrame:
    """Full windows and the rests that a combination takes."""
    schema = _arrow(PIECES)
    columns = ["doc_id", "doc_tokens", "full_crcs", "full_before", "full_offset", "length", "nth", "before", "rest_crc"]

    def run(batches):
        for batch in batches:
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in columns if n not in ("full_crcs", "doc_id")}
            crcs = batch.column("full_crcs")
            whole = np.diff(crcs.offsets.to_numpy())
            of = np.repeat(np.arange(batch.num_rows), whole)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(whole) - whole, whole)
            first = c["full_before"] + c["full_offset"]
            rank = c["nth"] + c["before"]
            fits = np.flatnonzero((c["length"] > 0) & (rank < slots.taken[c["length"]]))
            sequence, offset = slots.place(c["length"][fits], rank[fits])
            rows = np.concatenate([of, fits])
            ends = crcs.offsets.to_numpy()
            made = [batch.column("doc_id").take(pa.array(rows)),
                    np.concatenate([nth * window, whole[fits] * window]),
                    np.concatenate([np.full(len(of), window), c["length"][fits]]),
                    np.concatenate([crcs.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]], c["rest_crc"][fits]]),
                    c["doc_tokens"][rows],
                    np.concatenate([first[of] + nth, full + sequence]),
                    np.concatenate([np.zeros(len(of)), offset])]
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v, pa.Array) else pa.array(v.astype(np.int64)) for v in made], schema=schema)

    return placed.select(*columns).mapInArrow(run, PIECES)


def _strung_pieces(rest: DataFrame, total: int, first_sequence: int, window: int) -> DataFrame:
    """Left-over rests in one string, cut at window borders and, at its end, into powers of two."""
    schema = _arrow(PIECES)
    full_windows = total // window
    tail = tail_borders(total, window)

    def sequence_at(position: int) -> tuple[int, int, int]:
        """(sequence, its first position, its end) of a position in the string."""
        if position < full_windows * window:
            n = position // window
            return n, n * window, (n + 1) * window
        start = full_windows * window
        for k, end in enumerate(tail):
            if position < end:
                return full_windows + k, start, end
            start = end
        raise ValueError("position beyond the string")

    def run(batches):
        for batch in batches:
            out = {name: [] for name in schema.names}
            for row in batch.to_pylist():
                ids, at, done = row["rest"], row["string_at"], 0
                while done < row["length"]:
                    sequence, start, end = sequence_at(at + done)
                    n = min(row["length"] - done, end - at - done)
                    for name, value in zip(schema.names, (
                            row["doc_id"], row["doc_tokens"] - row["length"] + done, n,
                            zlib.crc32(ids[4 * done:4 * (done + n)]), row["doc_tokens"],
                            first_sequence + sequence, at + done - start)):
                        out[name].append(value)
                    done += n
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    within = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    kept = cut(rest.select("part", "at", "doc_id", "doc_tokens", "length", "rest"))
    tasks = kept.groupBy("part").agg(F.sum("length").alias("size"))
    in_order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("part", F.coalesce(F.sum("size").over(in_order), F.lit(0)).alias("part_at"))
    local = kept.withColumn("local_at", F.coalesce(F.sum("length").over(within), F.lit(0)))
    strung = local.join(tasks, "part").withColumn("string_at", F.col("part_at") + F.col("local_at"))
    return strung.select("doc_id", "doc_tokens", "length", "rest", "string_at").mapInArrow(run, PIECES)


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), words.vocabulary("byte_bpe_50k.json"))
