"""Phrase collocations from count streams in prefix and suffix order.

1. Counts, order by order: a task combines the phrases of a slice of text, Spark adds them
   up. A phrase of k words is counted only where both its parts of k - 1 words may be
   frequent; that is looked up in a bitmap of fixed size (`BITS`), whose false positives
   cost time and change nothing. What is left, every phrase of up to five words with at
   least `least` occurrences, is the count stream; it holds all parts of its phrases.
2. The stream is laid out twice, range-partitioned and sorted: in prefix order and in suffix
   order (words reversed). In prefix order the last phrase of k words above a row is that
   row's own beginning, so one pass in lockstep over the orders gives every left count;
   suffix order gives the right counts. A phrase has an extension as frequent as itself
   exactly if the next row is it: no other extension has occurrences left. Rows at the edge
   of a partition take what is open from a table of one row per partition.
3. Both layouts are merge-joined on the phrase; no count is looked up by hashing.

A hot word, phrase or language is never a group of one task: partitions are ranges of
(language, phrase) and counts are combined before every shuffle.

Null and empty texts hold no words; a null language is `und` and counts together with a
language of that name. Repeated rows and repeated ids count each time. Very long texts are
cut between words, with the words before the cut repeated, so that every phrase is counted
once. Ties: the smallest cut of a phrase, then score, count, phrase. An empty table gives
no rows. Only `text` and `lang` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.catalog import query, table
from tidewire.llm.grams import Bits, collected_bits, gram_hashes, taken_words, words_of
from tidewire.runtime import cut

MOST_WORDS = 5
LEAST = 100              # occurrences of a candidate
TOP = 2000               # phrases of a language
BITS = 26                # the filter of frequent phrases has 2**BITS bits
SLICE_BYTES = 1 << 22
NO_LANG = "und"

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TO = bytes.maketrans(bytes(range(65, 91)) + _BREAKS + b"\t", bytes(range(97, 123)) + b"\n" * len(_BREAKS) + b" ")
_SCHEMA = "lang string, phrase string, c bigint"


def slices(raw: bytes, order: int) -> Iterator[bytes]:
    """Portions of a normalised text, cut between words; the last words are repeated if no piece ends there."""
    at, before = 0, b""
    while len(raw) - at > SLICE_BYTES:
        end = raw.rfind(b"\n", at, at + SLICE_BYTES)
        if end < 0:
            ends = [e for e in (raw.find(c, at + SLICE_BYTES) for c in (b" ", b"\n")) if e >= 0]
            end = min(ends, default=len(raw))
        part = before + raw[at:end]
        yield part
        whole = end < len(raw) and raw[end] == 0x0A
        tail = b"" if whole or order == 1 else part[part.rfind(b"\n") + 1:]
        before = b"".join(w + b" " for w in tail.rsplit(None, order - 1)[-(order - 1):]) if tail else b""
        at = end + 1
    yield before + raw[at:]


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _counted(parts: list[bytes], langs: list[str], order: int, bits: Bits | None) -> pa.RecordBatch:
    """Combined counts of the phrases of `order` words in a few portions of text."""
    data, starts, ends, word = words_of(parts)
    first = np.cumsum([0] + [len(p) + 1 for p in parts])
    part = np.searchsorted(first, starts, side="right") - 1
    names = list(dict.fromkeys(langs))
    seeds = np.array([_lang_hash(n) for n in names], dtype=np.uint64)
    lang = np.array([names.index(x) for x in langs], dtype=np.int64)[part] if len(langs) else part
    piece = np.cumsum(data == 0x0A)[starts] if len(starts) else starts
    n = max(0, len(starts) - order + 1)
    good = piece[:n] == piece[len(starts) - n:] if n else np.zeros(0, bool)
    if bits is not None and n:
        shorter = bits.has(gram_hashes(word, order - 1, seeds[lang]))
        good &= shorter[:n] & shorter[1:n + 1]
    rows = np.flatnonzero(good)
    _, at, c = np.unique(gram_hashes(word, order, seeds[lang])[rows], return_index=True, return_counts=True)
    rows = rows[at]
    phrase = taken_words(data, starts, ends, rows, order)
    return pa.RecordBatch.from_arrays(
        [pa.array(names or [""], pa.string()).take(pa.array(lang[rows])), phrase, pa.array(c, pa.int64())], ["lang", "phrase", "c"])


def counts_of_order(docs: DataFrame, order: int, bits: bytes | None) -> DataFrame:
    """lang, phrase, f of the phrases of `order` words whose parts may be frequent."""
    known = docs.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def run(batches):
        have = Bits(known.value) if known is not None else None
        for batch in batches:
            parts, langs, size = [], [], 0
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                for part in slices((text or "").encode("utf-8", "surrogatepass").translate(_TO), order):
                    parts.append(part)
                    langs.append(lang)
                    size += len(part)
                    if size >= SLICE_BYTES:
                        yield _counted(parts, langs, order, have)
                        parts, langs, size = [], [], 0
            if parts:
                yield _counted(parts, langs, order, have)

    seen = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"),
                       F.col("text").cast("string").alias("text")).where("text <> ''")
    return seen.mapInArrow(run, _SCHEMA).groupBy("lang", "phrase").agg(F.sum("c").alias("f"))


def bitmap(stream: DataFrame, order: int) -> bytes:
    """The filter of the phrases in `stream`: 2**BITS bits, whatever the stream's size."""
    def run(batches):
        for batch in batches:
            lang, phrase = batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()
            if phrase:
                _, _, _, word = words_of([p.encode("utf-8", "surrogatepass") for p in phrase])
                seeds = np.array([_lang_hash(x) for x in lang], dtype=np.uint64)
                at = gram_hashes(word, order, np.repeat(seeds, order))[::order] >> np.uint64(64 - BITS)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64) + 1)], ["bit"])

    return collected_bits(stream.select("lang", "phrase").mapInArrow(run, "bit bigint"), BITS)


def count_stream(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, level, f of all frequent phrases; lang, n of all words)."""
    every = cut(counts_of_order(docs, 1, None))
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    levels = [every.where(F.col("f") >= least)]
    for order in range(2, most_words + 1):
        found = counts_of_order(docs, order, bitmap(levels[-1], order - 1))
        levels.append(cut(found.where(F.col("f") >= least)))
    stream = levels[0].withColumn("level", F.lit(1))
    for order, level in enumerate(levels[1:], 2):
        stream = stream.union(level.withColumn("level", F.lit(order)))
    return stream, totals


def _lockstep(stream: DataFrame, key: Column, name: str, most_words: int) -> DataFrame:
    """One pass over the stream in the order of `key`: counts of each row's beginnings, and whether it is extended.

    Adds `name` (array: count of the first word, of the first two, ...) and `{name}_full`
    (an extension at the end has the same count).
    """
    shorter = range(1, most_words)
    placed = cut(stream.withColumn("key", key).repartitionByRange("lang", "key").sortWithinPartitions("lang", "key")
                 .drop("key").withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    of_level = {k: F.when(F.col("level") == k, F.col("f")) for k in shorter}
    edges = placed.groupBy("part").agg(
        F.min_by(F.struct("level", "f"), "at").alias("head"),
        *[F.max_by(of_level[k], F.when(F.col("level") == k, F.col("at"))).alias(f"open{k}") for k in shorter])
    parts = Window.orderBy("part")          # one row per partition
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select("part", F.lead("head").over(parts).alias("following"),
                         *[F.last(f"open{k}", True).over(before).alias(f"open{k}") for k in shorter])
    inside = Window.partitionBy("part").orderBy("at")
    above = inside.rowsBetween(Window.unboundedPreceding, -1)
    row = placed.select("*", F.lead(F.struct("level", "f")).over(inside).alias("next"),
                        *[F.last(of_level[k], True).over(above).alias(f"near{k}") for k in shorter])
    row = row.join(edges, "part")
    following = F.coalesce("next", "following")
    full = (following["level"] == F.col("level") + 1) & (following["f"] == F.col("f"))
    return row.select("lang", "phrase", "level", "f", F.coalesce(full, F.lit(False)).alias(f"{name}_full"),
                      F.array(*[F.coalesce(f"near{k}", f"open{k}") for k in shorter]).alias(name))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, cut (words before it) of the best phrases of every language."""
    stream, totals = count_stream(docs, least, most_words)
    words = F.split("phrase", " ")
    ahead = _lockstep(stream, words, "begin", most_words)
    behind = _lockstep(stream, F.reverse(words), "finish", most_words).select("lang", "phrase", "finish", "finish_full")
    both = (ahead.where("level > 1 AND NOT begin_full").join(behind.hint("merge"), ["lang", "phrase"])
            .where("NOT finish_full").join(totals, "lang"))

    def at(k: Column) -> Column:
        left, right = F.get("begin", k - 1), F.get("finish", F.col("level") - k - 1)
        whole = "CAST(1000 * f AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0))"
        return F.struct(F.expr(whole).alias("part"), left.alias("l"), right.alias("r"), k.alias("cut"))

    cuts = F.transform(F.sequence(F.lit(1), F.col("level") - 1), at)
    both = both.withColumn("cuts", cuts).withColumn("best", F.expr(
        "array_min(transform(cuts, x -> named_struct('score', x.part div (CAST(x.l AS DECIMAL(19,0)) * CAST(x.r AS DECIMAL(19,0))),"
        " 'cut', x.cut, 'l', x.l, 'r', x.r)))"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = both.select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "n", "best.score", "best.cut")
    return (out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score",
                    F.col("cut").cast("bigint").alias("cut")))


ORACLE = f"""
WITH pieces AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded WHERE len(w) > 0),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM (
        SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
        FROM spots, (SELECT unnest(range(1, {MOST_WORDS + 1})) AS k) WHERE i + k - 1 <= len(w)) GROUP BY ALL),
often AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE f >= {LEAST}),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
cuts AS (SELECT o.lang, o.phrase, o.f AS a, x.f AS l, y.f AS r, t.n, c.cut,
        (1000::HUGEINT * o.f * t.n) // (x.f::HUGEINT * y.f) AS score
    FROM often o JOIN totals t USING (lang), (SELECT unnest(range(1, {MOST_WORDS})) AS cut) c, often x, often y
    WHERE c.cut < o.k AND x.lang = o.lang AND x.phrase = array_to_string(o.w[:c.cut], ' ')
      AND y.lang = o.lang AND y.phrase = array_to_string(o.w[c.cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT DISTINCT o.lang, s.phrase FROM often o,
        LATERAL (SELECT array_to_string(o.w[i:i + n - 1], ' ') AS phrase
                 FROM (SELECT unnest(range(1, {MOST_WORDS + 1})) AS i), (SELECT unnest(range(2, {MOST_WORDS})) AS n)
                 WHERE i + n - 1 <= o.k AND n < o.k) s
        JOIN often e ON e.phrase = s.phrase AND e.lang = o.lang WHERE 100 * o.f >= 100 * e.f)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank,
       b.phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score, cut::BIGINT AS cut
FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.phrase IS NULL
QUALIFY rank <= {TOP}
"""


@query("op11_phrases", ORACLE)
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
