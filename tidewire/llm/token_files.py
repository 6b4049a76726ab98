"""Token files: ids of documents, coded by context mixing and a range coder, whole ids at a time.

Three models predict the next id: order 2 names the id that it expects after the last two
ids, order 1 the one after the last id, both from a table of guesses with a confidence of 0 to 3
that follows the block; order 0 gives every id its share of the file. The prediction is their
mixture: the weights of the two guesses are chosen by their confidences and by whether they
agree, and fitted to the success of the models in the file. The mixture drives a carry-less
range coder that gives up 16 bits at a time. Blocks of a fixed number of ids start from empty guesses, so
any block decodes on its own with the head of its file; each has a checksum of its ids. The
blocks of a file run side by side, one numpy lane each.

File format (little endian):
  magic "TKF2", u32 documents, u32 blocks, u64 ids, u32 bytes of the head
  per document: u8 has a doc_id, i64 doc_id, u64 ids
  per block:    u32 ids, u32 bytes, u32 crc32 of the ids as u32
  the head, packed by zlib, low bytes before high bytes: u16 weights of order 2, then of order 1,
  in 4096ths, for each of 32 contexts; the distinct ids as u16 steps; their shares in 65536ths, less one, as u16
  the coded blocks, one after the other
Files are kept as rows of a table (part, file, content), because only Spark can write
to every store; a file holds whole documents, and (part, file) order is doc_id order.

Null texts count as empty: they hold the end id alone. Rows with a null doc_id come
first. Repeated rows are stored each. An empty table gives no file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

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

MAGIC = b"TKF2"
END_ID = 1
BLOCK_IDS = 4096
FILE_IDS = 1 << 22       # a file is closed once it holds so many ids
LANES = 1024             # blocks that run side by side; bounds the memory of the guesses

_SLOT_BITS = 12
_CONTEXTS = 32           # confidence of order 2, of order 1, and whether they agree
_MIX_BITS, _SHARE_BITS = 12, 16
_WORD, _TOP, _BOTTOM, _MASK = 46, 1 << 46, 1 << 30, (1 << 62) - 1


def _slots(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Places of the guesses of order 2 and order 1 in a block's tables, which follow each other."""
    mask = (1 << _SLOT_BITS) - 1
    slots = np.empty((2, *last.shape), dtype=np.int64)
    two, one = slots
    np.multiply(before, 1664525, out=two)
    two += np.multiply(last, 69069, out=one)
    two >>= 7
    np.multiply(last, 40503, out=one)
    one >>= 5
    slots &= mask
    one += mask + 1
    return slots


class _Lanes:
    """Guesses of blocks that run side by side: id * 4 + confidence. Encoder and decoder share every step."""

    def __init__(self, lanes: int):
        self.guesses = np.zeros(lanes << (_SLOT_BITS + 1), dtype=np.int32)
        self.first = np.arange(lanes, dtype=np.int64) << (_SLOT_BITS + 1)

    def seen(self, slots: np.ndarray) -> np.ndarray:
        """Guesses of order 2 and order 1 (2, n) of the first n lanes."""
        self.at = slots + self.first[:slots.shape[1]]
        self.now = self.guesses.take(self.at)
        return self.now

    def learn(self, ids: np.ndarray) -> None:
        """A right guess gains confidence, a wrong one loses it or is replaced."""
        now, fresh = self.now, ids << 2
        made, right = now - 1, (now ^ fresh) < 4
        np.copyto(made, fresh, where=(now & 3) == 0)
        np.copyto(made, np.minimum(now + 1, fresh + 3), where=right)
        self.guesses[self.at] = made


def _context(seen: np.ndarray) -> np.ndarray:
    sure = seen & 3
    context = sure[0] << 2
    context += sure[1]
    return np.add(context, 16, out=context, where=(seen[0] ^ seen[1]) < 4)


class _Head:
    """What a file says of all its blocks: weights by context and shares of its ids."""

    def __init__(self, weights: np.ndarray, ids: np.ndarray, shares: np.ndarray):
        self.weights, self.ids, self.shares = weights.astype(np.int64), ids.astype(np.int64), shares.astype(np.int64)

    @classmethod
    def of(cls, ids: np.ndarray, counts: np.ndarray, hits: np.ndarray) -> _Head:
        """From the uses of each id and, by context, how often order 2, order 1 and neither was right."""
        if len(ids) and ids[-1] > 0xFFFF:
            raise ValueError("ids of 65536 and more need a wider code")
        shares = counts * ((1 << _SHARE_BITS) - len(ids)) // max(1, counts.sum()) + 1
        if len(ids):
            shares[np.argmax(shares)] += (1 << _SHARE_BITS) - shares.sum()
        total = (1 << _MIX_BITS) - 64        # order 0 keeps a little everywhere
        weights = hits[:2] * total // np.maximum(1, hits.sum(axis=0))
        return cls(np.maximum(weights, hits[:2] > 0), ids, shares)

    def intervals(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and share of each id, and at last of no id: the whole range, where a guess was right."""
        whole = 1 << _SHARE_BITS
        return np.append(np.cumsum(self.shares) - self.shares, 0), np.append(self.shares, whole)

    def to_bytes(self) -> bytes:
        numbers = np.concatenate([self.weights.ravel(), np.diff(self.ids, prepend=0), self.shares - 1]).astype("<u2")
        return zlib.compress(numbers.view(np.uint8).reshape(-1, 2).T.tobytes())

    @classmethod
    def read(cls, packed: bytes) -> _Head:
        try:
            numbers = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(2, -1).T.astype(np.int64) @ [1, 256]
        except zlib.error as fault:
            raise ValueError("the head of the file is damaged") from fault
        deltas, shares = numbers[2 * _CONTEXTS:].reshape(2, -1)
        return cls(numbers[:2 * _CONTEXTS].reshape(2, -1), np.cumsum(deltas), shares + 1)


def _settled(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Lanes whose top 16 bits will not change any more."""
    return np.flatnonzero((low ^ (low + span)) < _TOP)


def _short(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Lanes whose span is too small for the next id; it is cut where the top 16 bits could still change."""
    short = span < _BOTTOM
    if not short.any():
        return np.zeros(0, dtype=np.int64)
    lanes = np.flatnonzero(short)
    open_ = lanes[(low[lanes] ^ (low[lanes] + span[lanes])) >= _TOP]
    span[open_] = -low[open_] & (_BOTTOM - 1)
    return lanes


def _by_length(lengths: Sequence[int]) -> list[np.ndarray]:
    """Numbers of at most LANES blocks that run together, longest first, so that the lanes still running are the first ones."""
    return [at + np.argsort(-np.array(lengths[at:at + LANES]), kind="stable") for at in range(0, len(lengths), LANES)]


def _running(lengths: np.ndarray) -> np.ndarray:
    return np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")


def _side_by_side(blocks: Sequence[np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(blocks[i]) for i in order])
    ids = np.zeros((lengths[0], len(order)), dtype=np.int64)
    for lane, i in enumerate(order):
        ids[:lengths[lane], lane] = blocks[i]
    return ids, lengths


def encode_blocks(blocks: Sequence[np.ndarray]) -> tuple[_Head, list[bytes]]:
    """Code blocks of ids below 65536."""
    everything = np.concatenate([np.zeros(0, dtype=np.uint32), *blocks])
    distinct, counts = np.unique(everything, return_counts=True)
    hits, runs = np.zeros((3, _CONTEXTS), dtype=np.int64), []
    for order in _by_length([len(b) for b in blocks]):
        ids, lengths = _side_by_side(blocks, order)
        model, running = _Lanes(len(order)), _running(lengths)
        last = np.vstack([np.zeros((1, len(order)), dtype=np.int64), ids])
        kinds, contexts = np.zeros(ids.shape, dtype=np.uint8), np.zeros(ids.shape, dtype=np.uint8)
        for at in range(0, len(ids), 64):
            here = range(at, min(at + 64, len(ids)))
            seen, now = np.zeros((2, len(here), len(order)), dtype=np.int32), ids[here].astype(np.int32)
            slots = _slots(last[here], last[[max(0, t - 1) for t in here]])
            for t, n in enumerate(running[here].tolist()):
                seen[:, t, :n] = model.seen(slots[:, t, :n])
                model.learn(now[t, :n])
            two, one = (seen >> 2) == now
            kinds[at:at + 64], contexts[at:at + 64] = np.where(two, 0, np.where(one, 1, 2)), _context(seen)
        used = np.arange(len(order)) < running[:, None]
        hits += np.bincount(kinds[used].astype(np.int64) * _CONTEXTS + contexts[used], minlength=3 * _CONTEXTS).reshape(3, -1)
        runs.append((order, ids, running, kinds, contexts))
    head, out = _Head.of(distinct.astype(np.int64), counts, hits), [b""] * len(blocks)
    place = np.zeros(1 << 16, dtype=np.int64)
    place[head.ids] = np.arange(len(head.ids))
    for order, ids, running, kinds, contexts in runs:
        for i, code in zip(order, _encode_lanes(head, place, ids, running, kinds, contexts)):
            out[i] = code
    return head, out


def _encode_lanes(head: _Head, place: np.ndarray, ids: np.ndarray, running: np.ndarray, kinds: np.ndarray,
                  contexts: np.ndarray) -> list[bytes]:
    lanes = ids.shape[1]
    low, span = np.zeros(lanes, dtype=np.int64), np.full(lanes, _MASK, dtype=np.int64)
    code, filled = np.zeros((lanes, 4 * len(ids) + 8), dtype="<u2"), np.zeros(lanes, dtype=np.int64)
    starts, shares = head.intervals()
    # bounds of the three kinds by context
    edges = np.concatenate([np.zeros((1, _CONTEXTS), dtype=np.int64), np.cumsum(head.weights, axis=0),
                            np.full((1, _CONTEXTS), 1 << _MIX_BITS)]).ravel()
    for t, n in enumerate(running.tolist()):
        lo, sp, kind = low[:n], span[:n], kinds[t, :n]
        at = kind * np.int64(_CONTEXTS) + contexts[t, :n]
        unit = sp >> _MIX_BITS
        start = edges.take(at)
        lo += unit * start
        sp[:] = unit * (edges.take(at + _CONTEXTS) - start)
        which = np.where(kind == 2, place.take(ids[t, :n]), len(head.ids))
        unit = sp >> _SHARE_BITS
        lo += unit * starts.take(which)
        sp[:] = unit * shares.take(which)
        ready = _settled(lo, sp)
        while True:
            top = lo[ready]
            code[ready, filled[ready]] = top >> _WORD
            filled[ready] += 1
            lo[ready] = (top << 16) & _MASK
            sp[ready] = (sp[ready] << 16) & _MASK
            ready = _short(lo, sp)
            if not len(ready):
                break
    tail = np.stack([(low >> shift) & 0xFFFF for shift in (46, 30, 14)] + [(low << 2) & 0xFFFF], axis=1).astype("<u2")
    return [code[lane, :filled[lane]].tobytes() + tail[lane].tobytes() for lane in range(lanes)]


def decode_blocks(head: _Head, codes: Sequence[bytes], lengths: Sequence[int]) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(codes)
    id_at = np.repeat(np.arange(len(head.ids)), head.shares)
    for order in _by_length(lengths):
        for i, ids in zip(order, _decode_lanes(head, id_at, [codes[i] for i in order], np.array([lengths[i] for i in order]))):
            out[i] = ids
    return out


def _decode_lanes(head: _Head, id_at: np.ndarray, codes: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
    lanes, running = len(codes), _running(lengths)
    width = max(len(c) for c in codes) // 2 + 8
    code = np.zeros((lanes, width), dtype="<u2")
    for lane, c in enumerate(codes):
        code[lane, :len(c) // 2] = np.frombuffer(c, dtype="<u2", count=len(c) // 2)
    ids = np.zeros((len(running), lanes), dtype=np.int64)
    model, low, span = _Lanes(lanes), np.zeros(lanes, dtype=np.int64), np.full(lanes, _MASK, dtype=np.int64)
    begin = code[:, :4].astype(np.int64)
    value = (begin[:, 0] << 46) | (begin[:, 1] << 30) | (begin[:, 2] << 14) | (begin[:, 3] >> 2)
    # a word of the code fills 16 bits of a value of 62, so two bits of it wait for the next one
    read = np.full(lanes, 4, dtype=np.int64)
    waiting = begin[:, 3] & 3
    (starts, shares), id_of = head.intervals(), np.append(head.ids, 0)
    ends = (starts + shares)[:-1]
    first, both = head.weights[0], head.weights.sum(axis=0)
    last = before = np.zeros(lanes, dtype=np.int64)
    for t, n in enumerate(running.tolist()):
        lo, sp, val = low[:n], span[:n], value[:n]
        seen = model.seen(_slots(last[:n], before[:n]))
        (two, one), context = seen.astype(np.int64) >> 2, _context(seen)
        unit = sp >> _MIX_BITS
        past, w, v = val - lo, unit * first.take(context), unit * both.take(context)
        is_two, rest = past < w, past >= v
        start = np.where(is_two, 0, np.where(rest, v, w))
        lo += start
        sp[:] = np.where(is_two, w, np.where(rest, unit << _MIX_BITS, v)) - start
        past -= start
        unit = sp >> _SHARE_BITS
        # a quotient of floats may be one off where the id changes
        which = id_at.take((past / unit).astype(np.int64), mode="clip")
        which -= past < unit * starts.take(which)
        which += past >= unit * ends.take(which, mode="clip")
        which = np.where(rest, which, len(head.ids))
        now = np.where(rest, id_of.take(which, mode="clip"), np.where(is_two, two, one))
        lo += unit * starts.take(which, mode="clip")
        sp[:] = unit * shares.take(which, mode="clip")
        ready = _settled(lo, sp)
        while True:
            word = code.take(ready * width + np.minimum(read.take(ready), width - 1)).astype(np.int64)
            val[ready] = ((val[ready] << 16) & _MASK) | (waiting[ready] << 14) | (word >> 2)
            waiting[ready] = word & 3
            read[ready] += 1
            lo[ready] = (lo[ready] << 16) & _MASK
            sp[ready] = (sp[ready] << 16) & _MASK
            ready = _short(lo, sp)
            if not len(ready):
                break
        model.learn(now.astype(np.int32))
        ids[t, :n] = now
        before, last = last[:n], now
    return [ids[:n, lane].astype(np.uint32) for lane, n in enumerate(lengths.tolist())]


def write_file(doc_ids: Sequence[int | None], ids: Sequence[np.ndarray], block_ids: int = BLOCK_IDS) -> bytes:
    """One file of whole documents."""
    stream = np.concatenate([np.zeros(0, dtype="<u4"), *ids]).astype("<u4")
    blocks = [stream[i:i + block_ids] for i in range(0, len(stream), block_ids)]
    mixture, codes = encode_blocks(blocks)
    packed = mixture.to_bytes()
    head = [MAGIC, struct.pack("<IIQI", len(doc_ids), len(blocks), len(stream), len(packed))]
    head += [struct.pack("<BqQ", d is not None, d or 0, len(i)) for d, i in zip(doc_ids, ids)]
    head += [struct.pack("<III", len(b), len(c), zlib.crc32(b.tobytes())) for b, c in zip(blocks, codes)]
    return b"".join([*head, packed, *codes])


def read_file(content: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """(doc_ids, ids of each); raises ValueError where a block's checksum does not hold."""
    if content[:4] != MAGIC:
        raise ValueError("not a token file")
    docs, count, total, packed = struct.unpack_from("<IIQI", content, 4)
    at = 24
    entries = list(struct.iter_unpack("<BqQ", content[at:at + 17 * docs]))
    at += 17 * docs
    heads = list(struct.iter_unpack("<III", content[at:at + 12 * count]))
    at += 12 * count
    mixture, codes = _Head.read(content[at:at + packed]), []
    at += packed
    for _, size, _ in heads:
        codes.append(content[at:at + size])
        at += size
    blocks = decode_blocks(mixture, codes, [h[0] for h in heads])
    for number, (block, (_, _, crc)) in enumerate(zip(blocks, heads)):
        if zlib.crc32(block.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {number} is damaged")
    stream = np.concatenate([np.zeros(0, dtype=np.uint32), *blocks]).astype("<u4")
    if len(stream) != total:
        raise ValueError("ids are missing")
    ends = np.cumsum([e[2] for e in entries]).astype(np.int64)
    return ([d if known else None for known, d, _ in entries],
            [stream[b - e[2]:b] for b, e in zip(ends.tolist(), entries)])


def write(docs: DataFrame, path: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Token files of `docs` in doc_id order, written to the shared folder: part, file, content."""
    fields = "part int, file int, n_ids bigint, content binary"

    def run(batches):
        encoder = words.word_tokenizer(path, lower=True)
        part, file, doc_ids, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close():
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "file": pa.array([file], pa.int32()),
                 "n_ids": pa.array([size], pa.int64()), "content": pa.array([write_file(doc_ids, ids)], pa.binary())})

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                doc_ids.append(doc_id)
                ids.append(np.append(encoder.encode([text])[0], np.uint32(end_id)))
                size += len(ids[-1])
                if size >= file_ids:
                    yield close()
                    file, doc_ids, ids, size = file + 1, [], [], 0
        if doc_ids:
            yield close()

    # a count of its own, so that adaptive execution does not merge the costliest step into a few tasks
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(*documents_like()).repartitionByRange(parts, "doc_id", "text")
               .sortWithinPartitions("doc_id", "text"))
    return cut(ordered.mapInArrow(run, fields))


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, ids = read_file(row["content"])
                sizes = np.array([len(i) for i in ids], dtype=np.int64)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]] * len(ids), pa.int32()),
                    "file": pa.array([row["file"]] * len(ids), pa.int32()),
                    "doc_id": pa.array(doc_ids, pa.int64()), "at": np.cumsum(sizes) - sizes, "n_tokens": sizes,
                    "ids_crc32": pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64())})

    in_part = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    in_order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)       # one row per task of the writer
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("part_at"))
    starts = (files.select("part", "file", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)).alias("file_at"))
              .join(parts, "part"))
    decoded = files.select("part", "file", "content").mapInArrow(
        run, "part int, file int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return decoded.join(starts, ["part", "file"]).select(
        "doc_id", (F.col("part_at") + F.col("file_at") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), words.vocabulary("word_bpe_49k.json")))
