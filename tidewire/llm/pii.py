"""Personal data: fixed base patterns plus a semi-Markov conditional random field.

The base patterns (email, ip, card, phone) are always reported. The field adds what
they cannot describe. It looks at windows around digits, at-signs and spelt-out signs
("(at)", "[.]", " dot "), scores whole candidate segments of bounded length by span
features (shape, digit groups, checks, neighbours) and a transition between segment types,
and one dynamic program picks boundaries and types together. It is trained here: the base patterns and key=value
secrets label windows of a bounded sample of texts, and a part of the labelled spans
is rewritten into variants that the patterns miss (no country code, dotted cards,
spelt-out addresses).

A null or empty text has no spans. Rows are independent, so repeated rows give
repeated results. Added spans never overlap base spans or each other. An empty
table, or one without any labelled window, adds nothing to the base spans.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.catalog import query, table
from tidewire.llm.common import documents_like, map_rows
from tidewire.runtime import cut

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
TYPES = ("other", *KINDS)
LONGEST = 14             # tokens of a segment
SIDE = 40                # characters a window shows on either side of a digit or at-sign
FEATURE_BITS = 16
SAMPLE_DOCS = 20_000     # texts the training windows come from
SAMPLE_WINDOWS = 4_000
NEVER = -1e9

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(reversed(digits)):
        n = int(d) * (1 + at % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield "email", start, free
        at = text.find("@", max(at + 1, free))


_FOUR_PARTS = re.compile(r"\.[0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of KINDS."""
    found = list(_emails(text)) if "@" in text else []
    if _ANY_DIGIT.search(text):
        if _FOUR_PARTS.search(text):
            found += [("ip", *m.span()) for m in _IP.finditer(text)
                      if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# ---- windows and segments ---------------------------------------------------------------------------------------

_HITS = re.compile(r"[0-9@]+|\((?i:at)\)|\[(?i:at)\]|\[\.\]|(?<= )(?i:dot)(?= )")
_TOKENS = re.compile(r"\w+|[^\w\s]")


def windows(text: str) -> list[tuple[int, int]]:
    """Places around digits, at-signs and spelt-out signs, cut at white space, merged when they touch."""
    out: list[list[int]] = []
    for m in _HITS.finditer(text):
        start, end = max(0, m.start() - SIDE), min(len(text), m.end() + SIDE)
        if out and start <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([start, end])
    snapped = []
    for start, end in out:
        if start and not text[start - 1].isspace():
            start = next((i + 1 for i in range(start, min(start + SIDE, end)) if text[i].isspace()), start)
        if end < len(text) and not text[end].isspace():
            end = next((i for i in range(end - 1, max(end - SIDE, start), -1) if text[i].isspace()), end)
        snapped.append((start, end))
    return snapped


def _token_class(token: str) -> str:
    if token.isdigit():
        return f"9{min(len(token), 17)}"
    if token.isalpha():
        return "a"
    return "m" if token[0].isalnum() else token


def _f(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << FEATURE_BITS) - 1)


_RUNS = re.compile(r"[0-9]+")
_LETTER_RUN = re.compile(r"[^\W\d_]+")


def _span_features(span: str, tokens: list[str], before: str, after: str) -> list[int]:
    runs = _RUNS.findall(span)
    digits = "".join(runs)
    shape = _RUNS.sub("9", _LETTER_RUN.sub("a", span))
    shape = re.sub("(?:a|9){3,}", "m", shape)[:24]
    features = [f"shape={shape}", f"n={min(len(digits), 20)}", f"runs={','.join(str(min(len(r), 20)) for r in runs[:6])}",
                f"shape+n={shape}|{min(len(digits), 20)}", f"before={before}", f"after={after}",
                f"tokens={len(tokens)}", f"first={_token_class(tokens[0])}", f"last={_token_class(tokens[-1])}"]
    if 13 <= len(digits) <= 19:
        features.append(f"luhn={luhn(digits)}|{len(runs)}")
    if len(runs) == 4:
        features.append(f"octets={all(len(r) <= 3 and int(r) <= 255 for r in runs)}|{shape}")
    if "@" in span:
        features.append(f"at={span.count('@')}|{'.' in span.split('@', 1)[1]}")
    if len(tokens) == 1 and len(span) >= 12:
        letters = len(span) - len(digits)
        features.append(f"mixed={min(len(span) // 4, 12)}|{letters > 0}|{len(digits) > 0}|{span.isupper()}")
    return [_f(x) for x in features]


@dataclass
class Window:
    """Tokens of a window and its candidate segments, as flat arrays."""
    bounds: Sequence         # (start, end) of every token
    place: np.ndarray        # (segments, 2): end token, length - 1
    entity: np.ndarray       # is the segment an entity
    sizes: np.ndarray        # its number of features
    features: np.ndarray     # of all segments in turn


def _spelt(lower: list[str], i: int) -> bool:
    """A word that may stand for a sign: `dot`, or `at` and a dot in brackets."""
    if lower[i] == "dot":
        return True
    return lower[i] in ("at", ".") and 0 < i < len(lower) - 1 and lower[i - 1] + lower[i + 1] in ("()", "[]")


def look(text: str, start: int, end: int) -> Window:
    bounds = [(m.start(), m.end()) for m in _TOKENS.finditer(text, start, end)]
    tokens = [text[a:b] for a, b in bounds]
    lower = [t.lower()[:12] for t in tokens]
    spelt = [_spelt(lower, i) for i in range(len(tokens))]
    evidence = [spelt[i] or any("0" <= c <= "9" or c == "@" for c in t) for i, t in enumerate(tokens)]
    seen = np.concatenate([[0], np.cumsum(evidence)]).astype(int).tolist()
    signs = np.concatenate([[0], np.cumsum(spelt)]).astype(int).tolist()
    place, entity, sizes, features = [], [], [], []
    for i in range(len(tokens)):
        before = (lower[i - 1] if i else "^") + ("_" if i and bounds[i - 1][1] < bounds[i][0] else "")
        place.append((i, 0))
        entity.append(False)
        sizes.append(2)
        features += (_f("other"), _f(f"other={_token_class(tokens[i])}"))
        if not (tokens[i][0].isalnum() or tokens[i] in "+("):
            continue
        for j in range(i, min(len(tokens), i + LONGEST)):
            if seen[j + 1] == seen[i] or not tokens[j][-1].isalnum():
                continue
            after = ("_" if j + 1 < len(tokens) and bounds[j][1] < bounds[j + 1][0] else "") + (
                _token_class(tokens[j + 1]) if j + 1 < len(tokens) else "$")
            made = _span_features(text[bounds[i][0]:bounds[j][1]], tokens[i:j + 1], before, after)
            if signs[j + 1] > signs[i]:
                words = ["*" if t.isalnum() and t not in ("at", "dot") else t for t in lower[i:j + 1]]
                made += [_f(f"spelt={' '.join(words)}"), _f(f"spelt ends={' '.join(words[:2])}|{' '.join(words[-2:])}"),
                         _f(f"signs={'at' in words}|{words.count('dot')}")]
            place.append((j, j - i))
            entity.append(True)
            sizes.append(len(made))
            features += made
    return Window(bounds, np.array(place, dtype=np.int32).reshape(-1, 2), np.array(entity, dtype=bool),
                  np.array(sizes, dtype=np.int32), np.array(features, dtype=np.uint16))


# ---- the field --------------------------------------------------------------------------------------------------

def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Batch:
    """Windows laid out together: scores of (window, end token, length, type) from feature weights."""

    def __init__(self, held: list[Window]):
        self.count = len(held)
        self.width = max(len(w.bounds) for w in held) + 1        # at least one padding token
        window = np.repeat(np.arange(len(held)), [len(w.sizes) for w in held])
        self.place = (window, *np.concatenate([w.place for w in held]).T.astype(np.int64))
        self.ids = np.concatenate([w.features for w in held])
        self.entity = np.concatenate([w.entity for w in held])
        sizes = np.concatenate([w.sizes for w in held])
        self.of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.starts = np.cumsum(sizes) - sizes
        self.pads = [(b, t) for b, w in enumerate(held) for t in range(len(w.bounds), self.width)]

    def scores(self, weights: np.ndarray) -> np.ndarray:
        s = np.full((self.count, self.width, LONGEST, len(TYPES)), NEVER)
        if len(self.ids):
            each = np.add.reduceat(weights[self.ids], self.starts, axis=0)     # every segment has features
            each[self.entity, 0] = NEVER
            each[~self.entity, 1:] = NEVER
            np.maximum.at(s, self.place, each)       # a one-token segment is a candidate both ways
        b, t = np.array(self.pads).T
        s[b, t, 0, 0] = 0.0
        return s


def _forward(s: np.ndarray, trans: np.ndarray, best: bool):
    count, width = s.shape[:2]
    alpha = np.full((count, width + 1, len(TYPES)), NEVER)
    alpha[:, 0, 0] = 0.0
    entry = np.full_like(alpha, NEVER)
    back = np.zeros((count, width + 1, len(TYPES), 2), dtype=np.int64)
    source = np.zeros((count, width + 1, len(TYPES)), dtype=np.int64)
    for t in range(width):
        through = alpha[:, t, :, None] + trans
        entry[:, t] = through.max(axis=1) if best else _lse(through, 1)
        source[:, t] = through.argmax(axis=1)
        lengths = min(LONGEST, t + 1)
        arriving = np.stack([entry[:, t - d] + s[:, t, d] for d in range(lengths)], axis=1)
        if best:
            alpha[:, t + 1] = arriving.max(axis=1)
            back[:, t + 1, :, 0] = arriving.argmax(axis=1)
            d = back[:, t + 1, :, 0]
            back[:, t + 1, :, 1] = np.take_along_axis(source, (t - d)[:, None, :].clip(0), axis=1)[:, 0]
        else:
            alpha[:, t + 1] = _lse(arriving, 1)
    return alpha, entry, back


def best_paths(batch: Batch, weights: np.ndarray, trans: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Entity segments (first token, last token, type) of the best labelling of each window."""
    alpha, _, back = _forward(batch.scores(weights), trans, best=True)
    out = []
    for b in range(batch.count):
        t, y, path = batch.width, int(alpha[b, batch.width].argmax()), []
        while t > 0:
            d, previous = (int(v) for v in back[b, t, y])
            if y:
                path.append((t - d - 1, t - 1, y))
            t, y = t - d - 1, previous
        out.append(path[::-1])
    return out


def _gradient(batch: Batch, gold: tuple[np.ndarray, np.ndarray], weights: np.ndarray, trans: np.ndarray):
    """Gold minus expected counts of features and transitions."""
    s = batch.scores(weights)
    alpha, entry, _ = _forward(s, trans, best=False)
    count, width = s.shape[:2]
    z = _lse(alpha[:, width], 1)[:, None]
    beta = np.full((count, width + 1, len(TYPES)), NEVER)
    beta[:, width] = 0.0
    expected_trans = np.zeros_like(trans)
    expected = np.zeros_like(s)
    for t in range(width - 1, -1, -1):
        lengths = min(LONGEST, width - t)
        leaving = np.stack([s[:, t + d, d] + beta[:, t + d + 1] for d in range(lengths)], axis=1)
        rest = _lse(leaving, 1)
        beta[:, t] = _lse(trans[None] + rest[:, None, :], 2)
        expected_trans += np.exp(np.minimum(alpha[:, t, :, None] + trans + rest[:, None, :] - z[:, :, None], 0)).sum(axis=0)
    for d in range(LONGEST):
        if d < width:
            expected[:, d:, d] = np.exp(np.minimum(entry[:, :width - d] + s[:, d:, d] + beta[:, d + 1:] - z[:, :, None], 0))
    mine = expected[batch.place]
    mine[batch.entity, 0] = 0.0
    mine[~batch.entity, 1:] = 0.0
    gold_segments, gold_trans = gold
    change = (gold_segments - mine)[batch.of]
    grad = np.stack([np.bincount(batch.ids, weights=change[:, y], minlength=len(weights)) for y in range(len(TYPES))], 1)
    return grad, gold_trans - expected_trans


@dataclass(frozen=True)
class Field:
    weights: np.ndarray
    trans: np.ndarray

    def added(self, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
        """Spans the field finds in each text, apart from those that touch a base span."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        held = sorted(((i, a, b) for i, text in enumerate(texts) for a, b in windows(text)), key=lambda w: w[2] - w[1])
        at = 0
        while at < len(held):
            size = max(1, min(256, 40_000 // (held[at][2] - held[at][1] + 1)))
            part = held[at:at + size]
            at += size
            seen = [look(texts[i], a, b) for i, a, b in part]
            for (i, _, _), window, path in zip(part, seen, best_paths(Batch(seen), self.weights, self.trans)):
                for first, last, y in path:
                    start, end = window.bounds[first][0], window.bounds[last][1]
                    if all(end <= s or e <= start for _, s, e in base[i]):
                        out[i].append((TYPES[y], start, end))
        return out

    def spans(self, texts: list[str | None]) -> list[tuple[list, list]]:
        """(base spans, all spans) of each text."""
        plain = [t or "" for t in texts]
        base = [base_spans(t) for t in plain]
        order = lambda s: (s[1], KINDS.index(s[0]))     # noqa: E731
        return [(b, sorted(b + a, key=order)) for b, a in zip(base, self.added(plain, base))]


# ---- training ---------------------------------------------------------------------------------------------------

_SECRETS = (re.compile(r"\b(?:password|passwd|token|secret|api_key|key)\s*[=:]\s*\"?(\w{12,})\b"), re.compile(r"\b(AKIA[0-9A-Z]{16})\b"))


def gold_spans(text: str) -> list[tuple[str, int, int]]:
    """Labels for training: base spans and keyed secrets, earlier kinds first, without overlap."""
    found = sorted(base_spans(text), key=lambda s: KINDS.index(s[0]))
    found += [("secret", *m.span(1)) for p in _SECRETS for m in p.finditer(text)]
    kept: list[tuple[str, int, int]] = []
    for span in found:
        if all(span[2] <= s or e <= span[1] for _, s, e in kept):
            kept.append(span)
    return sorted(kept, key=lambda s: s[1])


def variant(kind: str, span: str, pick: int) -> str:
    """Another way to write the same thing, which the base patterns miss."""
    digits = _digits(span)
    if kind == "phone" and len(digits) >= 10:
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"001 {a} {b} {c}")[pick % 4]
    if kind == "card":
        return ".".join(digits[i:i + 4] for i in range(0, len(digits), 4))
    if kind == "email":
        name, domain = span.split("@", 1)
        return (f"{name} at {domain.replace('.', ' dot ')}", f"{name}@{domain.replace('.', '[.]')}",
                f"{name} (at) {domain}")[pick % 3]
    if kind == "ip":
        return (span.replace(".", "[.]"), span.replace(".", "-"))[pick % 2]
    return span


# Ordinary numbers that stand where a labelled span stood: negatives for training.
PLAIN_NUMBERS = ("2024", "12.5", "10,000", "3.14.15", "345", "7", "1 200 300", "99", "1995-08-17", "18:30", "4.0", "2 of 10")


def _examples(texts: list[str]) -> list[tuple[str, list[tuple[str, int, int]]]]:
    out = []
    for n, text in enumerate(texts):
        gold = gold_spans(text)
        out.append((text, gold))
        if gold:
            made, shifted, end = "", [], 0
            for kind, a, b in gold:
                made += text[end:a]
                new = variant(kind, text[a:b], n)
                shifted.append((kind, len(made), len(made) + len(new)))
                made, end = made + new, b
            out.append((made + text[end:], shifted))
            plain, end = "", 0
            for at, (_, a, b) in enumerate(gold):
                plain += text[end:a] + PLAIN_NUMBERS[(n + at) % len(PLAIN_NUMBERS)]
                end = b
            out.append((plain + text[end:], []))
    return out


@dataclass
class Example:
    """A training window with the gold type of every segment (-1: not in the gold labelling) and its transitions."""
    window: Window
    kinds: np.ndarray
    moves: np.ndarray


def _example(text: str, gold: list[tuple[str, int, int]]) -> Example | None:
    """None for windows that are too long or whose gold spans are no candidate segments."""
    window = look(text, 0, len(text))
    if not window.bounds or len(window.bounds) > 80:
        return None
    first = {a: i for i, (a, _) in enumerate(window.bounds)}
    last = {b: i for i, (_, b) in enumerate(window.bounds)}
    placed = {(first.get(a), last.get(b)): TYPES.index(kind) for kind, a, b in gold}
    inside = {i for a, b in placed if a is not None and b is not None for i in range(a, b + 1)}
    kinds = np.full(len(window.entity), -1, dtype=np.int8)
    for at, ((end, length), entity) in enumerate(zip(window.place.tolist(), window.entity.tolist())):
        if entity:
            kinds[at] = placed.get((end - length, end), -1)
        elif end not in inside:
            kinds[at] = 0
    if (kinds > 0).sum() != len(placed):
        return None
    moves, t, previous = np.zeros((len(TYPES), len(TYPES)), dtype=np.int32), 0, 0
    at = {a: (b, kind) for (a, b), kind in placed.items()}
    while t < len(window.bounds):
        end, kind = at.get(t, (t, 0))
        moves[previous, kind] += 1
        t, previous = end + 1, kind
    moves[previous, 0] += 1                  # to the padding
    return Example(window, kinds, moves)


def _gold(part: list[Example], batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Gold type of every candidate segment as one-hot rows, and gold transition counts."""
    kinds = np.concatenate([e.kinds for e in part])
    rows = np.zeros((len(kinds), len(TYPES)))
    rows[np.flatnonzero(kinds >= 0), kinds[kinds >= 0]] = 1
    moves = np.sum([e.moves for e in part], axis=0).astype(float)
    moves[0, 0] += len(batch.pads) - len(part)
    return rows, moves


def train(examples: list[Example], epochs: int = 10, rate: float = 0.3, l2: float = 1e-4) -> Field:
    """Maximise the conditional likelihood of the labelled windows (AdaGrad, fixed order).

    Batches are laid out when they are used, so memory holds the flat windows and one batch.
    """
    weights = np.zeros((1 << FEATURE_BITS, len(TYPES)))
    trans = np.zeros((len(TYPES), len(TYPES)))
    if not any((e.kinds > 0).any() for e in examples):
        weights[_f("other"), 0] = 10.0       # nothing to learn from: everything is other
        return Field(weights, trans)
    order = sorted(examples, key=lambda e: len(e.window.bounds))
    parts = [order[at:at + 128] for at in range(0, len(order), 128)]
    squares, squares_t = np.full_like(weights, 1e-6), np.full_like(trans, 1e-6)
    for epoch in range(epochs):
        for part in (parts if epoch % 2 else parts[::-1]):
            batch = Batch([e.window for e in part])
            grad, grad_t = _gradient(batch, _gold(part, batch), weights, trans)
            grad -= l2 * weights
            squares += grad ** 2
            squares_t += grad_t ** 2
            weights += rate * grad / np.sqrt(squares)
            trans += rate * grad_t / np.sqrt(squares_t)
    return Field(weights, trans)


def examples(texts: list[str]) -> list[Example]:
    """Windows with their labels, and the variants of those that hold labelled spans."""
    return [e for text, gold in _examples(texts) if (e := _example(text, gold)) is not None]


_PACKED = "bounds binary, place binary, entity binary, sizes binary, features binary, kinds binary, moves binary"


def _packed(text):
    held = examples(text)
    return {"bounds": [np.array(e.window.bounds, dtype=np.int32).tobytes() for e in held],
            **{n: [getattr(e.window, n).tobytes() for e in held] for n in ("place", "entity", "sizes", "features")},
            "kinds": [e.kinds.tobytes() for e in held], "moves": [e.moves.tobytes() for e in held]}


def _unpacked(row) -> Example:
    array = lambda n, kind: np.frombuffer(bytes(row[n]), dtype=kind)      # noqa: E731
    window = Window(array("bounds", np.int32).reshape(-1, 2), array("place", np.int32).reshape(-1, 2),
                    array("entity", bool), array("sizes", np.int32), array("features", np.uint16))
    return Example(window, array("kinds", np.int8), array("moves", np.int32).reshape(len(TYPES), -1))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> Field:
    """Train on windows of a bounded sample of the texts."""
    share = min(1.0, sample_docs / max(1, docs.count()))

    def cut_out(doc_id, text):
        made = [(d or 0, t[a:b]) for d, t in zip(doc_id, text) if t for a, b in windows(t) if b - a <= 8 * SIDE]
        return {"doc_id": [m[0] for m in made], "text": [m[1] for m in made]}

    chosen = docs.select(*documents_like()).where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    found = map_rows(chosen, ["doc_id", "text"], cut_out, "doc_id bigint, text string")
    taken = cut(found.select("text").orderBy(F.xxhash64("text"), "text").limit(sample_windows))
    # features are made by the executors; the driver gets a few kB of flat arrays per window
    made = map_rows(taken.repartition(taken.sparkSession.sparkContext.defaultParallelism, "text"), ["text"], _packed, _PACKED)
    return train([_unpacked(row) for row in made.orderBy("features", "kinds", "bounds").toLocalIterator()])


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, base)."""
    def run(doc_id, text):
        made = []
        for base, everything in field.spans(text):
            known = set(base)
            made.append([{"kind": k, "start": a, "end": b, "base": (k, a, b) in known} for k, a, b in everything])
        return {"doc_id": doc_id, "spans": made}
    return map_rows(docs.select(*documents_like()), ["doc_id", "text"], run,
                    "doc_id bigint, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Replace each stretch covered by spans by the mark of its first span."""
    out, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redacted(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of `docs` with spans replaced by marks; n_chars follows the new text."""
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            made = [None if t is None else redact(t, spans) for t, (_, spans) in zip(texts, field.spans(texts))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(made, type=batch.schema.field(at).type))

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)).select(*docs.columns)


def digests(docs: DataFrame, field: Field) -> DataFrame:
    def line(spans):
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(doc_id, text):
        made = field.spans(text)
        counts = [{k: sum(s[0] == k for s in base) for k in BASE_KINDS} for base, _ in made]
        return {"doc_id": doc_id, **{f"n_{k}": [c[k] for c in counts] for k in BASE_KINDS},
                "base_sha256": [hashlib.sha256(line(b).encode()).hexdigest() for b, _ in made],
                "spans": [line(a) for _, a in made]}
    return map_rows(docs.select(*documents_like()), ["doc_id", "text"], run,
                    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint,"
                    " base_sha256 string, spans string")


@query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digests(docs, fit(docs))
