"""Periodic runs of words: maximal pairs of the LCP-interval tree of every text.

A run of period p over words [s, e) is the pair of positions (s, s + p): both begin the same
e - s - p words, no more, and the words before them differ. So every run with at least
`LEAST_PERIODS` periods is a maximal pair whose length is at least `LEAST_PERIODS - 1` times
its distance, and every such pair is a run, with no need to extend it. Pairs at a multiple of
a run's smallest period have its start and end; the smallest distance counts.

1. A suffix array by doubling, from ranks of windows of `BASE` words: the shortest pair that
   can be a run is that long, so texts without a repeated window are done. All texts of a
   portion are sorted together; the ranks of all steps give the common prefixes.
2. The intervals of the tree are built bottom-up, each with its positions in order and the
   word to the left of a position as its class. When intervals merge, positions of the smaller
   one look for partners of another class in the larger one, within a third of the common
   prefix. All positions in that reach belong to one run, whose first one alone has another
   class than the rest, so the outermost position on either side decides and no list of a
   class has to be walked: a text of one repeated word takes no longer than any other.

Null and empty texts have no words and no runs; their texts are the empty one. A null id plants
no period. Very long texts are worked on alone and whole. Repeated rows are worked on each.
Ties of the longest run: smallest start, then period. An empty table gives no rows. Columns
other than `doc_id` and `text` are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.catalog import query, table
from tidewire.llm.common import documents_like, map_rows

LEAST_WORDS = 6
LEAST_PERIODS = 4
BASE = 5                 # words that any pair of a run has in common
SLICE_WORDS = 1 << 18    # texts are worked on in portions of about so many words

_WORD = re.compile(r"[^ \t-\r]+")


class _Suffixes:
    """Positions of repeated windows in suffix order, with the common prefixes of neighbours."""

    def __init__(self, codes: np.ndarray, room: np.ndarray):
        """codes: a number for each word; room: words from a position to the end of its text."""
        n = len(codes)
        self.codes, self.room = codes, room
        packed = np.zeros(n, dtype=np.int64)
        for k in range(BASE):           # word by word, so that the numbers stay small; 0 is the end of a text
            nxt = np.where(room > k, codes[np.minimum(np.arange(n) + k, n - 1)] + 1, 0)
            packed = np.unique(packed * (int(codes.max(initial=0)) + 2) + nxt, return_inverse=True)[1]
        every = np.argsort(packed, kind="stable")
        change = np.diff(packed[every], prepend=-1) != 0
        rank = np.empty(n, dtype=np.int64)      # place of the first of the equal ones, so that finer ranks fit between
        rank[every] = np.maximum.accumulate(np.where(change, np.arange(n), 0))
        self.levels = [rank]
        found = order = self._repeated(every, rank)
        while len(order):
            rank, width = self.levels[-1], BASE << (len(self.levels) - 1)
            after = np.minimum(np.arange(n) + width, n - 1)
            further = np.where(room > width, rank[after] + 1, 0)
            # within a group of equal rank the next window decides; groups keep their places
            order = order[np.lexsort((further[order], rank[order]))]
            change = np.zeros(len(order), dtype=bool)
            change[1:] = (rank[order[1:]] != rank[order[:-1]]) | (further[order[1:]] != further[order[:-1]])
            first = np.flatnonzero(np.diff(rank[order], prepend=-1))      # of each group
            group = np.repeat(first, np.diff(np.append(first, len(order))))
            place = np.maximum.accumulate(np.where(change, np.arange(len(order)), 0)) - group
            finer = rank * 1
            finer[order] += place
            self.levels.append(finer)
            order = self._repeated(order, finer)
        self.order = found[np.argsort(self.levels[-1][found])]
        self.common = self._prefixes(self.order[:-1], self.order[1:])

    @staticmethod
    def _repeated(order: np.ndarray, rank: np.ndarray) -> np.ndarray:
        same = rank[order[1:]] == rank[order[:-1]]
        return order[np.append(same, False) | np.append(False, same)] if len(order) else order

    def _prefixes(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the texts from i and from j on have in common; 0 where the first window differs."""
        n, length = len(self.codes), np.zeros(len(i), dtype=np.int64)
        limit = np.minimum(self.room[i], self.room[j])

        def match(values: np.ndarray, width: int):
            a, b = np.minimum(i + length, n - 1), np.minimum(j + length, n - 1)
            np.add(length, width, out=length, where=(length + width <= limit) & (values[a] == values[b]))

        for level in range(len(self.levels) - 1, -1, -1):
            match(self.levels[level], BASE << level)
        short = length < BASE
        for _ in range(BASE - 1):
            match(self.codes, 1)
        length[short] = 0
        return length


def _pairs(order: list[int], common: list[int], left: list[int]):
    """(start, distance, length) of the maximal pairs no further apart than a third of their length.

    left: the class of every position, the word before it.
    """
    reach = LEAST_PERIODS - 1

    def merged(length: int, a: list[int], b: list[int]) -> list[int]:
        """Pairs between two children of an interval go to `out`; the positions of both."""
        small, large = (a, b) if len(a) < len(b) else (b, a)
        far = length // reach
        for x in small:
            k = bisect_left(large, x - far)
            if k < len(large) and large[k] < x and left[large[k]] != left[x]:
                out.append((large[k], x - large[k], length))
            k = bisect_left(large, x)
            if k < len(large) and large[k] - x <= far and left[large[k]] != left[x]:
                out.append((x, large[k] - x, length))
        if len(small) * 8 > len(large):
            return sorted(large + small)
        for x in small:
            insort(large, x)
        return large

    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, list[int]]] = []      # open intervals: common words, positions
    for k, position in enumerate(order):
        below = common[k - 1] if k else 0
        held = [order[k - 1]] if k else []
        while stack and stack[-1][0] > below:
            length, positions = stack.pop()
            held = merged(length, positions, held)
        if below:
            if stack and stack[-1][0] == below:
                stack[-1] = (below, merged(below, stack[-1][1], held))
            else:
                stack.append((below, held))
    held = order[-1:]
    while stack:
        length, positions = stack.pop()
        held = merged(length, positions, held)
    return out


def runs_of(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text of words, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    code: dict[str, int] = {}
    codes = np.array([code.setdefault(w, len(code)) for t in texts for w in t], dtype=np.int64)
    if not len(codes):
        return out
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    of = np.repeat(np.arange(len(sizes)), sizes)
    # numbers of the text's own, so that windows of different texts never match
    suffixes = _Suffixes(np.unique(of * len(code) + codes, return_inverse=True)[1], first[1:][of] - np.arange(len(codes)))
    left = np.concatenate([[-1], codes[:-1]])
    left[first[:-1][sizes > 0]] = -1
    best: dict[tuple[int, int], int] = {}
    for start, period, length in _pairs(suffixes.order.tolist(), suffixes.common.tolist(), left.tolist()):
        if length + period >= LEAST_WORDS:
            key = (start, start + period + length)
            best[key] = min(period, best.get(key, period))
    for (start, end), period in sorted(best.items(), key=lambda x: (x[0][0], x[1])):
        text = int(of[start])
        out[text].append((start - int(first[text]), end - start, period))
    return out


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words with a period from some word on, for a tenth of the ids."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a:a + p]
    return words[:a] + (part * ((n - a) // len(part) + 1))[:n - a]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds after its first period."""
    drop, end = bytearray(len(words)), 0
    for start, length, period in runs:
        drop[start + period:start + length] = b"\x01" * (length - period)
    return [w for w, d in zip(words, drop) if not d]


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, runs (start, length, period; words), collapsed (text) of every row of `docs`."""
    def run(doc_id, text):
        out: dict[str, list] = {"doc_id": doc_id, "runs": [], "collapsed": []}
        held: list[list[str]] = []

        def close():
            for words, found in zip(held, runs_of(held)):
                out["runs"].append([dict(zip(("start", "length", "period"), r)) for r in found])
                out["collapsed"].append(" ".join(collapsed(words, found)))
            held.clear()

        size = 0
        for d, t in zip(doc_id, text):
            words = _WORD.findall(t or "")
            held.append(planted(words, d) if plant else words)
            size += len(words)
            if size >= SLICE_WORDS:
                close()
                size = 0
        close()
        return out
    return map_rows(docs.select(*documents_like()), ["doc_id", "text"], run,
                    "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


@query("op13_runs")
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its number of runs, the longest one, and digests of all runs and of the collapsed text."""
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True).selectExpr(
        "doc_id", "runs", "collapsed",
        "array_max(transform(runs, r -> struct(r.length, -r.start AS low, -r.period AS slow))) AS best").selectExpr(
        "doc_id", "CAST(size(runs) AS BIGINT) AS n_runs", "-best.low AS start", "best.length AS length", "-best.slow AS period",
        "1000 * best.length div -best.slow AS exponent_milli",
        "sha2(array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\\n'), ''), 256) AS runs_sha256",
        "sha2(collapsed, 256) AS collapsed_sha256")
