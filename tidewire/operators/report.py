"""Report building: item filter, score, sections, Top-N and section statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions.scoring import score
from tidewire.functions.times import on_day
from tidewire.operators.numbering import number_rows
from tidewire.params import DEFAULTS, Params, UNKNOWN

SECTION = ("region", "layer")


def report_items(items: DataFrame, articles: DataFrame, sources: DataFrame, params: Params = DEFAULTS,
                 day: Column | None = None, done: Column | None = None) -> DataFrame:
    """Items of finished, long enough articles with enough confidence.

    All predicates sit on the scans; join sides are left to the optimiser,
    which broadcasts the source table only while its size allows it. Items may
    carry their own `source_id`, else that of the article is used.
    """
    ready = articles.where(
        (F.col("processing_status") == "done" if done is None else done)
        & (F.col("content_len") >= params.min_content_len))
    if day is not None:
        ready = ready.where(on_day(F.col("fetched_at"), day))
    wanted = items.where(F.col("confidence") >= params.confidence_threshold)
    if "source_id" in items.columns:
        ready = ready.drop("source_id")
    weight = F.col("weight") if "weight" in sources.columns else F.lit(1.0)
    named = sources.select("source_id", "source_name", F.coalesce(weight, F.lit(1.0)).alias("source_weight"))
    found = (wanted.join(ready, "article_id").join(named, "source_id")
             .withColumn("finance_relevance", F.coalesce("finance_relevance", F.lit(1.0))))
    return found.withColumn("opinion", F.coalesce("opinion", F.lit(""))) if "opinion" in items.columns else found


def with_score(items: DataFrame, as_of: Column) -> DataFrame:
    return items.withColumn("score", score(F.col("confidence"), F.col("published_at"), as_of,
                                           F.col("source_weight"), F.col("finance_relevance")))


def with_section(items: DataFrame) -> DataFrame:
    return items.withColumns({c: F.coalesce(c, F.lit(UNKNOWN)) for c in SECTION})


def top_n(items: DataFrame, n: int = DEFAULTS.report_topn, period: Sequence[str] = (),
          tie: Sequence[str] = ("item_id",)) -> DataFrame:
    """Best `n` items of each section (and period), ranked.

    The rank filter becomes a group limit below the shuffle: a section of any
    size sends at most `n` rows per task.
    """
    ranked = Window.partitionBy(*period, *SECTION).orderBy(F.col("score").desc(), *tie)
    return items.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n)


def section_ranks(items: DataFrame, period: Sequence[str] = (), tie: Sequence[str | Column] = ("item_id",)) -> DataFrame:
    """Full ranking of every section, without gathering a section in one task."""
    return number_rows(items, [F.col("score").desc(), *tie], [*period, *SECTION], "rank")


def all_sorted(items: DataFrame, tie: Sequence[str] = ("item_id",)) -> DataFrame:
    """Every item with its position in the global score order."""
    return number_rows(items, [F.col("score").desc(), *tie], (), "position")


def best_overall(items: DataFrame, n: int = DEFAULTS.attachment_max_items,
                 tie: Sequence[str] = ("item_id",)) -> DataFrame:
    """Global best `n`, then ranked inside their sections."""
    best = items.orderBy(F.col("score").desc(), *tie).limit(n)
    ranked = Window.partitionBy(*SECTION).orderBy(F.col("score").desc(), *tie)
    return best.withColumn("rank", F.row_number().over(ranked))


def section_counts(items: DataFrame) -> DataFrame:
    """Items in total, per region and per (region, layer); level 0, 1 or 2."""
    per_section = items.groupBy(*SECTION).agg(F.count("*").alias("items"))
    return (per_section.rollup(*SECTION).agg(F.sum("items").alias("items"), F.grouping_id().alias("_g"))
            .withColumn("level", F.when(F.col("_g") == 3, 0).when(F.col("_g") == 1, 1).otherwise(2)).drop("_g"))


def section_meta(items: DataFrame, n: int = DEFAULTS.report_topn, period: Sequence[str] = ()) -> DataFrame:
    """Section counts with the number of items that make the Top-N."""
    return (items.groupBy(*period, *SECTION).agg(F.count("*").alias("items"))
            .withColumn("topn_items", F.least("items", F.lit(n)))
            .groupBy(*period).agg(F.sum("items").alias("total_items"), F.sum("topn_items").alias("topn_items"),
                                  F.count("*").alias("sections")))


def region_shape(items: DataFrame) -> DataFrame:
    """Items and number of layers per region."""
    per_section = items.groupBy(*SECTION).agg(F.count("*").alias("n"))
    return per_section.groupBy("region").agg(F.sum("n").alias("items"), F.count("*").alias("layers"))


def distribution(items: DataFrame, reports: DataFrame) -> DataFrame:
    """Totals of reports and items, items by region and by layer, in one table."""
    by_value = (
        items.groupBy("region", "layer").agg(F.count("*").alias("n"))
        .select("n", F.explode(F.array(
            F.struct(F.lit("items").alias("kind"), F.lit("all").alias("value")),
            F.struct(F.lit("region").alias("kind"), F.col("region").alias("value")),
            F.struct(F.lit("layer").alias("kind"), F.col("layer").alias("value")))).alias("k"))
        .groupBy("k.kind", "k.value").agg(F.sum("n").alias("n")))
    total = reports.agg(F.count("*").alias("n")).select(
        F.lit("reports").alias("kind"), F.lit("all").alias("value"), "n")
    return by_value.unionByName(total)


def search_items(items: DataFrame, page: int = 1, page_size: int = 20, order: Sequence[str | Column] = ("item_id",),
                 text: str | None = None, region: str | None = None, layer: str | None = None,
                 first: Column | None = None, last: Column | None = None) -> DataFrame:
    """One page of the items that match every given filter."""
    if text:
        items = items.where(F.lower("fact").contains(text.lower()))
    if region:
        items = items.where(F.col("region") == region)
    if layer:
        items = items.where(F.col("layer") == layer)
    if first is not None:
        items = items.where(F.col("fetched_at") >= first)
    if last is not None:
        items = items.where(F.col("fetched_at") < F.date_add(last, 1).cast("timestamp_ntz"))
    return items.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def days_between(spark, start: str, end: str) -> DataFrame:
    """One row per day of a closed range."""
    return spark.sql("SELECT explode(sequence(CAST(:a AS DATE), CAST(:b AS DATE), INTERVAL 1 DAY)) AS report_date",
                     args={"a": start, "b": end})


def days_status(days: DataFrame, built: DataFrame) -> DataFrame:
    """Every wanted day with its item count and whether a report could be built."""
    return (days.join(built, "report_date", "left")
            .select("report_date", F.coalesce("items", F.lit(0)).cast("bigint").alias("items"),
                    F.when(F.col("items") > 0, "success").otherwise("error").alias("status")))


def attach_notes(reports: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes of a whole report or of one section; reports without notes stay."""
    scoped = notes.select(F.col("report_date").alias("_date"), F.col("section_key").alias("_key"),
                          "scope", "content_md")
    return reports.join(
        scoped, (reports["report_date"] == scoped["_date"])
        & ((F.col("scope") == "global") | (reports["section_key"] == scoped["_key"])), "left").drop("_date", "_key")
