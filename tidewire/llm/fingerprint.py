"""I-Match fingerprints on built-in functions alone.

The lexicon holds the terms whose document frequency lies in a band (an inverse
document frequency neither low nor high); it is taken over all documents. A text's
terms inside the lexicon are made distinct and sorted, and hashed once as a whole and
once for each of many random subsets of the lexicon. Subsets keep between an eighth
and a 4096th of the terms, so texts of any length have some subsets that hit only a few of
their terms: an edit changes a part of the hashes, not all.

Likeness of two fingerprints: equal slots among the slots that hold a term in either;
if no slot does, 1 when the whole hashes are equal and 0 otherwise.

The edited text needs the next document by doc_id. Documents go to ranges of doc_id, a
range's largest document is sent to the following range too, and a window within the
range does the rest: texts are shuffled once, no task sees all rows.

Size of the lexicon: the frequencies of its terms add up to at most the number of
(document, term) pairs, and each is at least `least_share` of the documents, so it has
at most (mean distinct terms of a text) / least_share terms, whatever the corpus size.

Null texts count as empty. Rows with a null doc_id sort below all others. Repeated
rows follow each other. A lone document is its own next one. Empty texts all have the
same fingerprint.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.llm.catalog import query, table
from tidewire.llm.common import documents_like
from tidewire.runtime import cut

LEAST_SHARE, MOST_SHARE = 0.0005, 0.05    # band of document frequency
LEAST_DOCS = 2
DRAWS = 10                                # independent draws of subsets
RATES = range(3, 13)                      # a subset keeps one term in 2 ** rate
SLOTS = 1 << 14                           # buckets of the lexicon's lookup table
RANGE_DOCS = 250


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-case words."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> DataFrame:
    """term: hashes of the terms inside the band."""
    base = docs.select(*documents_like())
    n = base.count()
    low, high = max(LEAST_DOCS, math.ceil(least_share * n)), max(LEAST_DOCS, math.floor(most_share * n))
    return (base.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term"))
            .groupBy("term").agg(F.count("*").alias("df"))
            .where(F.col("df").between(low, high)).select("term"))


def _slot(term: Column) -> Column:
    return term.bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def _lookup(words: DataFrame) -> Column:
    """The lexicon as one value: an array of buckets, as a scalar subquery."""
    spark = words.sparkSession
    filled = words.groupBy(_slot(F.col("term")).alias("slot")).agg(F.collect_list("term").alias("terms"))
    every = spark.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(filled, "slot", "left").select(
        "slot", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms"))
    ordered = every.agg(F.array_sort(F.collect_list(F.struct("slot", "terms"))).alias("all"))
    return cut(ordered.select(F.transform("all", lambda s: s["terms"]).alias("lexicon"))).scalar()


def _hex(number: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(number)), digits, "0")


def in_band(lists: Column, known: Column) -> Column:
    """Of each list of terms those that the lexicon holds, sorted.

    `known` stands here once, so that the optimiser moves the subquery into the expression
    and no row carries the lexicon.
    """
    return F.transform(lists, lambda terms: F.array_sort(F.filter(
        terms, lambda t: F.array_contains(F.get(known, _slot(t)), t))))


def slots(kept: Column) -> Column:
    """One 8-digit hash per lexicon subset; zeros where the subset misses the text.

    Subset (draw, rate) keeps the terms whose hash with the draw's number ends in `rate` zero
    bits, so the subsets of a draw are nested and only the largest is taken from all terms.
    """
    def chosen(held: Column, draw: Column, rate: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), rate) - 1
        return F.filter(held, lambda t: F.xxhash64(t, draw).bitwiseAND(mask) == 0)

    def slot(subset: Column) -> Column:
        return F.when(F.size(subset) == 0, F.lit("0" * 8)).otherwise(
            _hex(F.xxhash64(subset).bitwiseAND(F.lit(0xFFFFFFFF)), 8))

    first, last = F.lit(RATES[0]), F.lit(RATES[-1])
    largest = F.transform(F.sequence(F.lit(1), F.lit(DRAWS)),
                          lambda d: F.struct(d.alias("draw"), chosen(kept, d, first).alias("held")))
    return F.flatten(F.transform(largest, lambda x: F.transform(
        F.sequence(first, last), lambda r: slot(chosen(x["held"], x["draw"], r)))))


def likeness(a: Column, b: Column, whole_a: Column, whole_b: Column) -> Column:
    empty = "0" * 8
    held = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != empty) | (y != empty)), lambda z: z))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != empty)), lambda z: z))
    return F.when(held > 0, same / held).otherwise((whole_a == whole_b).cast("double"))


def _ranges(docs: DataFrame) -> Column:
    """Number of the doc_id range of a row; range borders are quantiles, looked up in two steps."""
    n = docs.count()
    count = min(1 << 16, max(1, n // RANGE_DOCS))
    at = [i / count for i in range(1, count)]
    borders = sorted(set(docs.approxQuantile("doc_id", at, 1 / (4 * count)))) if at else []
    borders = [int(b) for b in borders]
    step = max(1, math.isqrt(len(borders)))
    groups = [borders[i:i + step] for i in range(0, len(borders), step)]
    key = F.col("doc_id")
    if not groups:
        return F.lit(0)
    firsts = F.lit([g[0] for g in groups]).cast("array<bigint>")
    fine = F.array(*[F.lit(g).cast("array<bigint>") for g in groups])
    coarse = F.size(F.filter(firsts, lambda b: b <= key))
    inside = F.size(F.filter(F.get(fine, coarse - 1), lambda b: b <= key))
    return F.when(key.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * step + inside)


def with_next(docs: DataFrame) -> DataFrame:
    """Every document with the text of the next one by falling doc_id (after the last, the first).

    Columns: range, guest (1 for a row that is only here as the next of another), doc_id,
    text, next_text. The window orders a range from small to large.
    """
    base = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = base.withColumn("range", _ranges(base))
    tops = cut(placed.groupBy("range").agg(F.max("doc_id").alias("top")))
    in_order = Window.orderBy("range")          # one row per range
    receivers = tops.select("range", "top", F.coalesce(
        F.lead("range").over(in_order), F.min("range").over(Window.partitionBy())).alias("to"))
    receiver = F.broadcast(receivers)           # at most 65 536 rows
    tied = Window.partitionBy("range").orderBy(F.col("text").desc())
    guests = (placed.join(receiver.select(F.col("range").alias("from"), "top", "to"),
                          (F.col("range") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("top")))
              .withColumn("nth", F.row_number().over(tied)).where("nth = 1")
              .select("doc_id", "text", F.col("to").alias("range"), F.lit(1).alias("guest")))
    own = placed.select("doc_id", "text", "range", F.lit(0).alias("guest"))
    order = Window.partitionBy("range").orderBy(
        F.col("guest").desc(), F.col("doc_id").asc_nulls_first(), "text")
    return own.unionByName(guests).withColumn("next_text", F.lag("text").over(order))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = docs.select(*documents_like())
    known = _lookup(lexicon(docs))
    rows = with_next(docs)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half),
                      F.substring("next_text", F.lit(1), half))
    made = (rows.withColumn("edited", F.when(F.col("guest") == 0, edited))
            .select("range", "guest", "doc_id", F.char_length("text").cast("bigint").alias("n_chars"),
                    F.sha2("edited", 256).alias("edited_sha256"), "text",
                    terms(F.col("text")).alias("terms"), terms(F.col("edited")).alias("edited_terms"))
            .withColumn("known", known)
            .withColumn("both", in_band(F.array("terms", "edited_terms"), F.col("known")))
            .select("range", "guest", "doc_id", "n_chars", "edited_sha256", "text", "terms", "edited_terms",
                    F.get("both", F.lit(0)).alias("kept"), F.get("both", F.lit(1)).alias("edited_kept")))

    def whole(kept: str, all_terms: str) -> Column:
        return _hex(F.xxhash64(F.when(F.size(kept) > 0, F.col(kept)).otherwise(F.array_sort(all_terms))), 16)

    hashed = made.select("range", "guest", "doc_id", "n_chars", "edited_sha256", "text",
                         slots(F.col("kept")).alias("s"), slots(F.col("edited_kept")).alias("es"),
                         whole("kept", "terms").alias("w"), whole("edited_kept", "edited_terms").alias("ew"))
    order = Window.partitionBy("range").orderBy(F.col("guest").desc(), F.col("doc_id").asc_nulls_first(), "text")
    following = hashed.withColumn("ns", F.lag("s").over(order)).withColumn("nw", F.lag("w").over(order))
    return following.where("guest = 0").select(
        "doc_id", "n_chars", "edited_sha256", F.concat(F.col("w"), F.array_join("s", "")).alias("fingerprint"),
        F.concat(F.col("ew"), F.array_join("es", "")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("es"), F.col("w"), F.col("ew")).alias("near_edited"),
        likeness(F.col("s"), F.col("ns"), F.col("w"), F.col("nw")).alias("near_next"))


@query("op5_imatch")
def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
