"""Removal of lines that stand on many sites.

A line (trimmed, not blank) is boilerplate when it occurs on at least `min_sites`
distinct sites and in as many distinct texts. The second test leaves exact copies of one
article alone; they are the business of document deduplication. What else stands in the
texts of a line plays no part. Lines are carried as 64-bit hashes.

HyperLogLog sketches of sites and texts per line are built on the map side and merged by
aggregation, so a line that a third of all rows hold costs a sketch per task. Where an
estimate lies near its threshold, exact distinct counts decide. Lines that occur fewer
than `min_sites` times are left out before any sketch is made.

Documents keep their other lines in order. A document that had text and has none left is
dropped. Null and empty texts stay as they are; a null site is no site. Repeated rows
count as one text and are each cleaned. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.catalog import query, table
from tidewire.runtime import cut

MIN_SITES = 5
NEAR = 0.2               # an estimate within this share of its threshold is replaced by an exact count


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def occurrences(docs: DataFrame) -> DataFrame:
    """row, text, site, line of every line that is not blank."""
    lines = F.filter(_lines(F.col("text")), lambda x: F.trim(x) != "")
    listed = docs.where(F.col("text").isNotNull()).select(
        _row_key().alias("row"), F.xxhash64("text").alias("text"), F.col("source").alias("site"),
        F.transform(lines, _key).alias("lines"))
    return listed.select("row", "text", "site", F.explode("lines").alias("line"))


def _frequent(docs: DataFrame, min_sites: int) -> DataFrame:
    """The occurrences of lines that occur often enough to be boilerplate."""
    found = occurrences(docs)
    often = cut(found.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("line"))
    return cut(found.join(often, "line"))


def boilerplate(seen: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """line: hashes of the lines to remove, of the occurrences (row, text, site, line)."""
    guessed = cut(seen.groupBy("line").agg(
        *[F.hll_sketch_estimate(F.hll_sketch_agg(c)).alias(c) for c in ("site", "text")]))
    fewest = F.least("site", "text") / min_sites
    yes = guessed.where(fewest >= 1 + NEAR).select("line")
    unsure = guessed.where((fewest >= 1 - NEAR) & (fewest < 1 + NEAR)).select("line")
    exact = (seen.join(unsure, "line").select("line", "site", "text").distinct()
             .groupBy("line").agg(*[F.count_distinct(c).alias(c) for c in ("site", "text")])
             .where(F.least("site", "text") >= min_sites).select("line"))
    return yes.union(exact)


def _marked(docs: DataFrame, min_sites: int) -> DataFrame:
    """doc: the rows of `docs` as structs, so that no name of theirs can clash; bad: hashes of their boilerplate lines."""
    seen = _frequent(docs, min_sites)
    lines = cut(boilerplate(seen, min_sites))
    bad = seen.select("row", "line").join(lines, "line").groupBy("row").agg(F.collect_set("line").alias("bad"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _row_key().alias("row"))
    return keyed.join(bad, "row", "left").select("doc", "bad")


def _kept(text: Column, bad: Column) -> Column:
    return F.array_join(F.filter(_lines(text), lambda x: ~F.array_contains(bad, _key(x)) | (F.trim(x) == "")), "\n")


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The rows of `docs`, all columns, without boilerplate lines."""
    text, bad = F.col("doc.text"), F.col("bad")
    out = _marked(docs, min_sites).select("doc", "bad", F.when(bad.isNull(), text).otherwise(_kept(text, bad)).alias("left"))
    emptied = bad.isNotNull() & (F.trim(F.regexp_replace("left", r"\s+", "")) == "")
    made = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.coalesce(F.char_length("left").cast(docs.schema["n_chars"].dataType), F.col("doc.n_chars"))
    return out.where(~emptied).select(*[made.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source FROM documents),
l AS (SELECT r, doc_id, text, source, u.line, u.pos FROM d,
      LATERAL (SELECT unnest(string_split(text, chr(10))) AS line,
                      generate_subscripts(string_split(text, chr(10)), 1) AS pos) u),
k AS (SELECT *, trim(line, ' ') AS key FROM l WHERE trim(line, ' ') <> ''),
bad AS (SELECT key FROM k GROUP BY key HAVING count(DISTINCT source) >= {MIN_SITES} AND count(DISTINCT text) >= {MIN_SITES}),
f AS (SELECT r, count(*) AS n_removed FROM k WHERE key IN (SELECT key FROM bad) GROUP BY r),
rest AS (SELECT r, string_agg(line, chr(10) ORDER BY pos) AS text FROM l
         WHERE trim(line, ' ') = '' OR trim(line, ' ') NOT IN (SELECT key FROM bad) GROUP BY r)
SELECT d.doc_id, coalesce(f.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(rest.text, '')) END AS text_sha256
FROM d LEFT JOIN f ON f.r = d.r LEFT JOIN rest ON rest.r = d.r
"""


@query("op6_line_dedup", ORACLE)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of lines removed and the digest of the text that is left."""
    marked = _marked(table(spark, sf_dir, "documents"), MIN_SITES)
    text, bad = F.col("doc.text"), F.col("bad")
    removed = F.size(F.filter(_lines(text), lambda x: F.array_contains(bad, _key(x)) & (F.trim(x) != "")))
    return marked.select(
        "doc.doc_id", F.when(bad.isNull(), 0).otherwise(removed).cast("bigint").alias("n_removed"),
        F.sha2(F.when(bad.isNull(), text).otherwise(_kept(text, bad)), 256).alias("text_sha256"))
