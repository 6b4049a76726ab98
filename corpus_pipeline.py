"""A corpus pipeline: five stages over `documents`, each written as Parquet and reread by the next.

1. toxicity: rows that the classifier rejects go.
2. line dedup: lines that stand on many sites go from the texts; rows left without text go.
3. MinHash near-dedup: of each group of near duplicates one row with the smallest doc_id stays.
   Rows count by doc_id and text, so a doc_id with two texts is two of them.
4. PII: spans of personal data are replaced by marks.
5. packing: token sequences of at most 1024 ids; the result of the pipeline.

All but the last return the columns of `documents`. Models are fitted on what the stage is
given (and on `labels` for toxicity). Null texts pass all filters and pack as one end id;
rows without a doc_id are never taken for duplicates; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm import lines, minhash, packing, pii, toxicity, words
from tidewire.llm.catalog import table
from tidewire.operators.numbering import number_rows
from tidewire.runtime import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs.select(COLUMNS), model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.cleaned(docs.select(COLUMNS))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(COLUMNS).withColumn("_text", F.xxhash64("text"))
    named = docs.where("doc_id IS NOT NULL").select("doc_id", "_text").distinct()
    keys = cut(number_rows(named, ["doc_id", "_text"], (), "_key").select("doc_id", "_text", "_key"))
    keyed = cut(docs.join(keys, ["doc_id", "_text"], "left"))
    found = minhash.near_duplicates(keyed.select(F.col("_key").cast("bigint").alias("doc_id"), "text"))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_key")).distinct()
    left = keyed.join(gone, "_key", "left_anti")
    # rows without id or words are linked with nothing, not even with their repeats
    linkable = F.col("_key").isNotNull() & F.coalesce(F.col("text").rlike(r"[^ \x09-\x0d]"), F.lit(False))
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("lang", "source", "n_chars"))
    first = left.where(linkable).withColumn("_nth", nth).where("_nth = 1")
    return first.select(COLUMNS).union(left.where(~linkable).select(COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(COLUMNS)
    return pii.redacted(docs, pii.fit(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, words.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("minhash", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

# A trained classifier, a trained field and the token packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
