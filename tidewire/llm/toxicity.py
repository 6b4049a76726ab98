"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are presences of character 3- to 5-grams of the lower-cased text, hashed
into a fixed number of buckets. Per bucket the log ratio r of its document rates in
toxic and other training texts is taken; a logistic regression is fitted on
presence * r. Only buckets that tell the classes apart (likelihood-ratio statistic)
take part, so most n-grams of a long text count nothing.

The model is fitted on at most about `SAMPLE_DOCS` labelled texts, chosen by a hash
of doc_id; scoring reads every whole text. Null texts count as empty; an empty
text gets the base rate. Repeated rows are scored each. Without labels of both
classes the score is the smoothed base rate. Labels with a null key or mark are
ignored; a document labelled twice counts as toxic if one label says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.catalog import query, table
from tidewire.llm.common import documents_like, map_rows
from tidewire.runtime import cut

SAMPLE_DOCS = 20_000     # bound of the training sample
BITS = 20                # buckets: 2 ** BITS
SIZES = (3, 4, 5)
FEATURES = 8192
LEAST_DOCS = 5           # a bucket has to occur in so many sample texts
L2 = 2.0
THRESHOLD = 0.3
SLICE_CHARS = 250_000    # texts are taken together up to so many characters; about 130 bytes of memory each
SLICE_ROWS = 1_000       # and turned into Python strings so many at a time


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append((text or "").lower())
        size += len(held[-1])
        if size >= SLICE_CHARS:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def gram_buckets(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every distinct n-gram of every text; only wanted buckets if given."""
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), dtype=np.uint32)
    of = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    mixed = points * np.uint32(2654435761)
    mixed ^= mixed >> np.uint32(15)
    rolled, keys = mixed, []
    for n in range(2, max(SIZES) + 1):
        if len(points) < n:
            break
        rolled = rolled[:-1] * np.uint32(2246822519) + mixed[n - 1:]
        if n not in SIZES:
            continue
        bucket = ((rolled ^ (rolled >> np.uint32(13))) * np.uint32(3266489917)) >> np.uint32(32 - BITS)
        inside = of[:-(n - 1)] == of[n - 1:]
        if wanted is not None:
            inside &= wanted[bucket]
        keys.append((of[:-(n - 1)][inside] << BITS) | bucket[inside])
    distinct = np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
    return distinct >> BITS, distinct & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray
    weights: np.ndarray      # regression weight times log-count ratio
    intercept: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        dense = np.zeros(1 << BITS)
        dense[self.buckets] = self.weights
        wanted = dense != 0
        out = np.full(len(texts), self.intercept)
        for start, held in _slices(texts):
            of, bucket = gram_buckets(held, wanted)
            out[start:start + len(held)] += np.bincount(of, weights=dense[bucket], minlength=len(held))
        return 1.0 / (1.0 + np.exp(-np.clip(out, -500, 500)))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """text, toxic of the labelled texts that may be learnt from."""
    marks = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = min(1.0, sample / max(1, marks.count()))
    chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # the sample's size is bounded by the parameter, so its keys may be broadcast
    return docs.select(*documents_like()).join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _counts(sample: DataFrame) -> DataFrame:
    """bucket, toxic texts with it, other texts with it; bucket -1 counts the texts."""
    def run(batches):
        seen = np.zeros((2, 1 << BITS), dtype=np.int64)
        texts = np.zeros(2, dtype=np.int64)
        for batch in _small(batches):
            marks = np.array(batch.column("toxic").to_pylist(), dtype=np.int64) > 0
            for start, held in _slices(batch.column("text").to_pylist()):
                of, bucket = gram_buckets(held)
                mark = marks[start:start + len(held)]
                for side in (0, 1):
                    seen[side] += np.bincount(bucket[mark[of] == bool(side)], minlength=1 << BITS)
                    texts[side] += int((mark == bool(side)).sum())
        at = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_pydict({
            "bucket": np.append(at, -1), "toxic": np.append(seen[1, at], texts[1]),
            "other": np.append(seen[0, at], texts[0])})
    return (sample.mapInArrow(run, "bucket bigint, toxic bigint, other bigint")
            .groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")))


def _telling(counts: DataFrame, toxic: int, other: int, features: int) -> list:
    """The buckets with the largest likelihood-ratio statistic between class and presence."""
    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    a, b, n1, n0 = F.col("toxic"), F.col("other"), F.lit(float(toxic)), F.lit(float(other))
    rate = (a + b) / (n1 + n0)
    statistic = (part(a, rate * n1) + part(b, rate * n0)
                 + part(n1 - a, (1 - rate) * n1) + part(n0 - b, (1 - rate) * n0))
    return (counts.where((F.col("bucket") >= 0) & (a + b >= LEAST_DOCS) & (a + b < n1 + n0))
            .orderBy(statistic.desc(), "bucket").limit(features).collect())


def _rows(sample: DataFrame, buckets: np.ndarray) -> list:
    """Per sample text the slots of its chosen buckets, as bytes."""
    def run(text, toxic):
        slot = np.full(1 << BITS, -1, dtype=np.int32)
        slot[buckets] = np.arange(len(buckets))
        out = []
        for _, held in _slices(text):
            of, bucket = gram_buckets(held, slot >= 0)
            ends = np.searchsorted(of, np.arange(len(held)), side="right")
            out += [slot[bucket[a:b]].astype("<u2").tobytes() for a, b in zip([0, *ends[:-1]], ends)]
        return {"toxic": toxic, "slots": out}
    return map_rows(sample, ["text", "toxic"], run, "toxic int, slots binary").collect()


def _regression(slots: np.ndarray, starts: np.ndarray, toxic: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """L2 logistic regression on presence * ratio by accelerated gradient steps.

    Slots stay two bytes each; sums run over portions of the texts, so the driver holds little else.
    """
    n, sizes = len(toxic), np.diff(starts)
    portions = [(k, min(k + 1000, n)) for k in range(0, n, 1000)]

    def forward(w):
        each, out = w * ratio, np.zeros(n)
        for i, j in portions:
            of = np.repeat(np.arange(j - i), sizes[i:j])
            out[i:j] = np.bincount(of, weights=each[slots[starts[i]:starts[j]]], minlength=j - i)
        return out

    def backward(d):
        out = np.zeros(len(ratio))
        for i, j in portions:
            out += np.bincount(slots[starts[i]:starts[j]], weights=np.repeat(d[i:j], sizes[i:j]), minlength=len(ratio))
        return out * ratio

    v = np.ones(len(ratio)) / np.sqrt(len(ratio))
    for _ in range(12):      # largest curvature
        u = backward(forward(v))
        size = np.linalg.norm(u)
        if size == 0:
            break
        v = u / size
    step = 1.0 / (0.25 * (1.1 * np.linalg.norm(backward(forward(v))) + n) + L2)
    w = look = np.zeros(len(ratio))
    b = look_b = float(np.log((toxic.sum() + 1) / (n - toxic.sum() + 1)))
    t = 1.0
    for _ in range(200):
        d = 1 / (1 + np.exp(-np.clip(forward(look) + look_b, -60, 60))) - toxic
        new, new_b = look - step * (backward(d) + L2 * look), look_b - step * d.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_b = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, features: int = FEATURES) -> Model:
    texts = cut(training_sample(docs, labels, sample))
    counts = _counts(texts).persist()
    try:
        total = counts.where("bucket = -1").first()
        toxic, other = (total["toxic"], total["other"]) if total else (0, 0)
        chosen = _telling(counts, toxic, other, features) if toxic and other else []
    finally:
        counts.unpersist()
    if not chosen:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log((toxic + 1) / (other + 1))))
    buckets = np.array([r["bucket"] for r in chosen])
    a, b = np.array([r["toxic"] for r in chosen]), np.array([r["other"] for r in chosen])
    ratio = np.log((a + 1) / (toxic + 2)) - np.log((b + 1) / (other + 2))
    rows = _rows(texts, buckets)
    slots = np.frombuffer(b"".join(r["slots"] for r in rows), dtype="<u2")
    starts = np.cumsum([0] + [len(r["slots"]) // 2 for r in rows])
    marks = np.array([float(r["toxic"] > 0) for r in rows])
    del rows, chosen
    w, intercept = _regression(slots, starts, marks, ratio)
    return Model(buckets, w * ratio, intercept)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row of `docs`."""
    def run(doc_id, text):
        s = model.scores(text)
        return {"doc_id": doc_id, "score": s.tolist(), "predicted": (s >= threshold).astype(int).tolist()}
    return map_rows(docs.select(*documents_like()), ["doc_id", "text"], run,
                    "doc_id bigint, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, whose score is below the threshold."""
    def run(batches):
        for batch in _small(batches):
            keep = model.scores(batch.column("text").to_pylist()) < threshold
            yield batch.filter(pa.array(keep))
    return docs.mapInArrow(run, docs.schema)


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
