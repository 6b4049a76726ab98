"""The daily job: ingest, extract, report, send plan, each stage on the last; as totals, or as tables that stay."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import dedup, delivery, facts, ingest, report, responses
from tidewire.operators.numbering import number_rows
from tidewire.params import DEFAULTS, Params
from tidewire.runtime import cut, exists
from tidewire.sources.tables import replace_partitions


def _extracted(answers: DataFrame, ready: DataFrame, merge: bool, params: Params) -> DataFrame:
    """Stored items of the articles in `ready` (seq, published_at, source_id), with item_id."""
    wanted = answers.join(ready.select(F.col("seq").alias("article_id")), "article_id", "left_semi")     # no other is parsed
    parsed = responses.parse_responses(wanted)
    found = responses.response_items(parsed).join(
        ready.select(F.col("seq").alias("article_id"), "published_at", "source_id"), "article_id")
    if merge:
        ordered = number_rows(found, ["article_id", "chunk_index", "at"], (), "position")
        found = facts.fill_by_majority(facts.merge_facts(ordered))
    good = facts.drop_low_quality(found, params.confidence_threshold, params.stored_fact_min_len)
    return (good.withColumn("source_weight", F.lit(1.0))
            .withColumn("item_id", F.concat_ws("-", "article_id", "chunk_index", "at")))


def _ranked(items: DataFrame, params: Params) -> DataFrame:
    """report_date, region, layer, rank, score, item_id of the best items of every day and section."""
    scored = report.with_section(report.with_score(items, F.date_trunc("day", "published_at") + F.expr("INTERVAL 30 HOURS")))
    day = scored.withColumn("report_date", F.to_date("published_at"))
    return report.top_n(day.select("report_date", "region", "layer", "score", "item_id"), params.report_topn, ["report_date"])


STORED = ("articles", "extraction_queue", "extraction_items", "report_items", "delivery_plan")


def _stored(spark: SparkSession, path: str, run: str) -> DataFrame | None:
    """What other runs have left in a table; None where there is none."""
    return spark.read.parquet(path).where(F.col("run") != run) if exists(spark, path) else None


def run_stored(spark: SparkSession, root: str, run: str, crawled: DataFrame, answers: DataFrame, recipients: DataFrame,
               start: Column, merge: bool = False, params: Params = DEFAULTS) -> bool:
    """One run whose stages are tables under `root`, each read back by the next; False if it was complete already.

    Every table has a partition per run, which a run replaces, and known addresses and
    hashes come from the other runs only. The manifest (run, table, rows) is written last:
    a run that is in it changes nothing when it is asked for again, and one that was lost
    on the way starts over and leaves no trace of the lost one.
    """
    manifest = os.path.join(root, "manifest")
    if exists(spark, manifest) and not spark.read.parquet(manifest).where(F.col("run") == run).isEmpty():
        return False

    made: dict[str, DataFrame] = {}

    def keep(name: str, rows: DataFrame) -> DataFrame:
        replace_partitions(rows.withColumn("run", F.lit(run)), os.path.join(root, name), ["run"])
        path = os.path.join(root, name, f"run={run}")          # not there when no row was
        made[name] = spark.read.schema(rows.schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], rows.schema)
        return made[name]

    known = _stored(spark, os.path.join(root, "articles"), run)
    urls = None if known is None else known.select("url")
    hashes = None if known is None else known.select("simhash")
    fresh = dedup.dedup(crawled, "seq", urls, hashes, params.hamming_max)
    articles = keep("articles", ingest.new_articles(fresh, crawled.select("url").limit(0) if urls is None else urls, "seq"))
    ready, _ = ingest.content_gate(articles, params.min_content_len)
    queue = keep("extraction_queue", ingest.queue_rows(ready, "seq"))
    waiting = articles.join(queue.select(F.col("article_id").alias("seq")), "seq", "left_semi")
    items = keep("extraction_items", _extracted(answers, waiting, merge, params))
    keep("report_items", _ranked(items, params))
    valid, _ = delivery.split_valid(delivery.active_recipients(recipients))
    people = delivery.distinct_in_order(valid, "seq")
    keep("delivery_plan", delivery.send_plan(delivery.batches(people, "seq"), start))
    totals = None
    for name in STORED:
        rows = made[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.lit(run).alias("run"))
        totals = rows if totals is None else totals.unionByName(rows)
    replace_partitions(totals.coalesce(1), manifest, ["run"])
    return True


def daily_run(spark: SparkSession, crawled: DataFrame, answers: DataFrame, recipients: DataFrame,
              stored: DataFrame | None = None, merge: bool = False, params: Params = DEFAULTS) -> DataFrame:
    """Stage totals of one run.

    `crawled` are article rows with `seq`, `answers` model answers whose
    `article_id` is such a `seq`. The stages share one deduplicated article
    table, which is written once.
    """
    known_urls = stored.select("url") if stored is not None else None
    known_hashes = stored.select("simhash") if stored is not None else None
    articles = cut(dedup.dedup(crawled, "seq", known_urls, known_hashes, params.hamming_max))
    ready, short = ingest.content_gate(articles, params.min_content_len)
    items = cut(_extracted(answers, ready, merge, params))
    best = _ranked(items, params)
    valid, _ = delivery.split_valid(delivery.active_recipients(recipients))
    people = delivery.distinct_in_order(valid, "seq")

    def total(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n")

    stages = [("articles", articles), ("queued", ready), ("too_short", short), ("items", items), ("report_items", best),
              ("recipients", people)]
    out = total(*stages[0])
    for stage in stages[1:]:
        out = out.unionByName(total(*stage))
    return out
