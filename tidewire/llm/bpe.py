"""Byte-pair encoding and decoding with forced boundaries.

A pair of neighbouring bytes that stands inside no vocabulary token can never
end up in one token, so the place between them is a certain cut: no merge crosses
it, and merges on one side do not see the other. Each pre-token is cut at all such
places, the fragments are encoded on their own (and remembered, because short
fragments repeat a lot), and their ids are concatenated.

Null texts count as empty; an empty text has no ids and decodes to the empty
string. Special tokens in a text get their own ids, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import re
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import words
from tidewire.llm.catalog import query, table
from tidewire.llm.common import documents_like, map_rows

MEMO_FRAGMENTS = 300_000
NO_MERGE = (1 << 40, 0)
LONG_FRAGMENT = 256      # characters from which a heap is faster than a scan


class ForcedBoundaryBpe:
    """Encoder and decoder for a vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self._specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[self.vocab[left], self.vocab[right]] = (rank, self.vocab[left + right])
        self.inside, self.final = self._pairs()
        library = Tokenizer.from_file(path)
        self._normalizer, self._split = library.normalizer, library.pre_tokenizer
        self._fragments: dict[tuple[str, bool], list[int]] = {}

    def _pairs(self) -> tuple[set[str], set[str]]:
        """Pairs inside a token; apart from them, those that only close a word."""
        inside, final = set(), set()
        for token in self.vocab:
            closing = bool(self.end) and token.endswith(self.end) and token != self.end
            body = token.removesuffix(self.end) if closing else token
            pairs = [body[i:i + 2] for i in range(len(body) - 1)]
            if closing and pairs:
                final.add(pairs.pop())
            inside.update(pairs)
        return inside, final

    def fragments(self, piece: str) -> list[str]:
        """The pre-token (in byte characters), cut at every pair that no token holds."""
        inside, last, start, out = self.inside, len(piece) - 2, 0, []
        for i in range(last + 1):
            known = self.final if self.end and i == last else inside
            if piece[i:i + 2] not in known:
                out.append(piece[start:i + 1])
                start = i + 1
        out.append(piece[start:])
        return out

    def _merge_all(self, fragment: str, closing: bool) -> list[int]:
        """Lowest rank first, leftmost first among equals."""
        vocab, find = self.vocab, self.merge.get
        ids = [vocab[c] for c in fragment]
        if closing and self.end:
            ids[-1] = vocab[fragment[-1] + self.end]
        if len(ids) > LONG_FRAGMENT:
            return self._merge_long(ids)
        steps = [find(p, NO_MERGE) for p in zip(ids, ids[1:])]
        while steps:
            best = min(steps)
            if best is NO_MERGE:
                break
            at = steps.index(best)
            ids[at:at + 2] = [best[1]]
            del steps[at]
            if at:
                steps[at - 1] = find((ids[at - 1], ids[at]), NO_MERGE)
            if at < len(steps):
                steps[at] = find((ids[at], ids[at + 1]), NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges from a heap over linked neighbours: n log n for a word without end."""
        n, find = len(ids), self.merge.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*step, at, ids[at], ids[at + 1]) for at in range(n - 1) if (step := find((ids[at], ids[at + 1])))]
        heapify(heap)
        while heap:
            _, made, at, left, right = heappop(heap)
            nxt = after[at]
            if ids[at] != left or nxt >= n or ids[nxt] != right:
                continue                     # one of the two has been merged already
            ids[at], ids[nxt], after[at] = made, -1, after[nxt]
            if after[at] < n:
                before[after[at]] = at
                if step := find((made, ids[after[at]])):
                    heappush(heap, (*step, at, made, ids[after[at]]))
            if before[at] >= 0 and (step := find((ids[before[at]], made))):
                heappush(heap, (*step, before[at], ids[before[at]], made))
        return [i for i in ids if i >= 0]

    def _piece(self, piece: str) -> list[int]:
        cut, known, ids = self.fragments(piece), self._fragments, []
        for at, fragment in enumerate(cut):
            key = (fragment, at == len(cut) - 1)
            got = known.get(key)
            if got is None:
                got = self._merge_all(*key)
                if len(known) < MEMO_FRAGMENTS:
                    known[key] = got
            ids += got
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self._specials.split(text) if self._specials else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                plain = self._normalizer.normalize_str(part) if self._normalizer else part
                for piece, _ in self._split.pre_tokenize_str(plain):
                    ids += self._piece(piece)
        return ids

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space: what the library does for a vocabulary without a decoder."""
        return " ".join([self.token[i] for i in ids])


class _Digests:
    """Counts and digests of ids and decoded text, from remembered chunks."""

    def __init__(self, path: str):
        self.bpe = ForcedBoundaryBpe(path)
        self.memo = words.ChunkMemo(lambda chunks: [self._of(c) for c in chunks], words.plain_lower_chunk)

    def _of(self, text: str) -> tuple[int, str, str]:
        ids = self.bpe.encode(text)
        return len(ids), " ".join(map(str, ids)), self.bpe.decode(ids)

    def __call__(self, text: str) -> tuple[int, str, str]:
        chunks = words.lower_chunks(text)
        parts = self.memo.values(chunks) if chunks is not None else None
        if parts is None:
            n, ids, decoded = self._of(text)
        else:
            parts = [p for p in parts if p[0]]
            n = sum([p[0] for p in parts])
            ids, decoded = " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_coders: dict[tuple[type, str], object] = {}


def _coder(kind: type, path: str):
    if (kind, path) not in _coders:
        _coders[kind, path] = kind(path)
    return _coders[kind, path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids."""
    def run(doc_id, text):
        bpe = _coder(ForcedBoundaryBpe, path)
        return {"doc_id": doc_id, "ids": [bpe.encode(t or "") for t in text]}
    return map_rows(docs.select(*documents_like()), ["doc_id", "text"], run, "doc_id bigint, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    def run(doc_id, ids):
        bpe = _coder(ForcedBoundaryBpe, path)
        return {"doc_id": doc_id, "text": [bpe.decode(x or []) for x in ids]}
    return map_rows(ids, ["doc_id", "ids"], run, "doc_id bigint, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode in one pass and keep only count and digests.

    For a vocabulary that drops white space (its chunks are independent).
    """
    def run(doc_id, text):
        made = [_coder(_Digests, path)(t or "") for t in text]
        return {"doc_id": doc_id, "n_tokens": [m[0] for m in made], "ids_sha256": [m[1] for m in made],
                "decoded_sha256": [m[2] for m in made]}
    return map_rows(docs.select(*documents_like()), ["doc_id", "text"], run,
                    "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), words.vocabulary("word_bpe_49k.json"))
