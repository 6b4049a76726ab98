"""Token ids of whole texts by the tokenizers library, one library call per distinct word.

A byte-pair tokenizer with a regex pre-tokenizer encodes every pre-token on its
own, and both public vocabularies start a new pre-token after white space, so
ids(text) is the concatenation of ids(chunk) over the white-space chunks, and
ids(chunk) that of its pre-tokens. Both repeat far more often than texts do; a task
asks the library's model once for each pre-token that it has not met yet. A chunk
counts only when all its characters are plain Latin, where the cuts and the lower case
are certain to be the library's. A text with any other chunk, or with odd white space,
goes to the library whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np

# Latin-1 and Latin Extended-A without controls and without I with dot: their own normal form, simple lower case.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-įı-ſ]+")
_EDGE = "\t\n\r\xa0"
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85")

# The pre-tokenizer patterns of the two public vocabularies, for plain Latin characters.
_LETTERS, _NUMBERS, _SPACE = "a-zA-ZªµºÀ-ÖØ-öø-įı-ſ", "0-9²³¹¼-¾", "\t\n\r \xa0"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_LOWER = re.compile(f"{_CONTRACTIONS}|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")
_SPACED = re.compile(f"{_CONTRACTIONS}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACE}{_LETTERS}{_NUMBERS}]+"
                     f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
# Byte-level vocabularies write a byte as itself if it is printable, else as the next character from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}

MEMO_WORDS = 400_000     # chunks a task remembers; later ones are asked for again, once per batch
FIRST = "\x00"           # marks a chunk that no space precedes


def plain_lower_chunk(chunk: str) -> bool:
    return _PLAIN.fullmatch(chunk) is not None and "<|" not in chunk


def plain_spaced_chunk(chunk: str) -> bool:
    chunk = chunk.removeprefix(FIRST)
    return (_PLAIN.fullmatch(chunk) is not None and "<|" not in chunk
            and chunk[0] not in _EDGE and chunk[-1] not in _EDGE)


def lower_chunks(text: str) -> list[str] | None:
    """Chunks for a vocabulary that drops white space."""
    return None if any(c in text for c in _ODD_SPACE) else text.split()


def spaced_chunks(text: str) -> list[str] | None:
    """Chunks for a vocabulary that joins one space to the word after it."""
    chunks = text.split(" ")
    chunks[0] = FIRST + chunks[0]
    return chunks


class ChunkMemo:
    """Values of chunks, asked for in batches; None where the whole text has to be looked at."""

    def __init__(self, make: Callable[[list[str]], list], ok: Callable[[str], bool]):
        self.make, self.ok, self.known = make, ok, {}

    def values(self, chunks: list[str]) -> list | None:
        known = self.known
        out = list(map(known.get, chunks))
        if None in out:
            fresh = list({c: None for c, v in zip(chunks, out) if v is None})
            if not all(map(self.ok, fresh)):
                return None
            made = dict(zip(fresh, self.make(fresh)))
            if len(known) < MEMO_WORDS:
                known.update(made)
            out = [made[c] if v is None else v for c, v in zip(chunks, out)]
        return out


class WordTokenizer:
    """encode(texts) -> one uint32 array per text, equal to the library's ids."""

    def __init__(self, path: str, lower: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.chunks = lower_chunks if lower else spaced_chunks
        self.memo = ChunkMemo(self._fresh, plain_lower_chunk if lower else plain_spaced_chunk)
        self.lower, self.pattern, self.model = lower, _LOWER if lower else _SPACED, self.library.model
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(_BYTES))
        ids = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        if len(self.pieces) < MEMO_WORDS:
            self.pieces[piece] = ids
        return ids

    def _fresh(self, chunks: list[str]) -> list[bytes]:
        known, ask, split, out = self.pieces, self._piece, self.pattern.findall, []
        for chunk in chunks:
            word = chunk.lower() if self.lower else chunk[1:] if chunk[0] == FIRST else " " + chunk
            out.append(b"".join([known[p] if p in known else ask(p) for p in split(word)]))
        return out

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            chunks = self.chunks(text)
            parts = self.memo.values(chunks) if chunks is not None else None
            if parts is None:
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4"))
            else:
                out.append(np.frombuffer(b"".join(parts), dtype="<u4"))
        return out


_open: dict[tuple[str, bool], WordTokenizer] = {}


def word_tokenizer(path: str, lower: bool) -> WordTokenizer:
    """One per Python worker and vocabulary."""
    if (path, lower) not in _open:
        _open[path, lower] = WordTokenizer(path, lower)
    return _open[path, lower]


def vocabulary(name: str) -> str:
    """Default place of a public vocabulary file; every operator takes a path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)
