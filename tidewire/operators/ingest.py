"""From crawled rows to stored articles: normalise, gate, store, queue, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.text import strip
from tidewire.functions.times import to_local, within_hours
from tidewire.functions.urls import canonical_or_url
from tidewire.operators.dedup import first_per_key
from tidewire.params import DEFAULTS


def recent_items(items: DataFrame, as_of: Column, since: Column | None = None,
                 hours: int = DEFAULTS.lookback_hours) -> DataFrame:
    """Items published since a moment, or in the last hours; no time, no row."""
    fresh = F.col("published_at") >= since if since is not None else within_hours(F.col("published_at"), as_of, hours)
    return items.where(F.col("published_at").isNotNull() & fresh)


def normalize_items(items: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fill source names and canonical URLs; rows that are not records go aside."""
    record = F.coalesce(F.col("url"), F.col("title"), F.col("content_text")).isNotNull()
    names = sources.select("source_id", F.col("source_name").alias("_name"))
    good = (items.where(record).join(names, "source_id", "left")
            .withColumn("source_name", F.coalesce("source_name", "_name")).drop("_name")
            .withColumn("canonical_url", canonical_or_url(F.col("canonical_url"), F.col("url"))))
    return good, items.where(~record)


def content_gate(articles: DataFrame, min_len: int = DEFAULTS.min_content_len,
                 text: str = "content_text") -> tuple[DataFrame, DataFrame]:
    """Articles with enough text, and the others with a reason."""
    enough = F.length(strip(F.coalesce(F.col(text), F.lit("")))) >= min_len
    return articles.where(enough), articles.where(~enough).withColumn("reason", F.lit("content_too_short"))


def new_articles(items: DataFrame, stored: DataFrame, order: str, title_max: int = DEFAULTS.title_max) -> DataFrame:
    """Rows to append: first use of each URL that is not stored yet.

    Instants become local wall times; wall times are local already.
    """
    fresh = first_per_key(items, "url", order).join(stored.select("url"), "url", "left_anti")
    instant = isinstance(items.schema["published_at"].dataType, T.TimestampType)
    published = to_local(F.col("published_at")) if instant else F.col("published_at")
    text = F.coalesce("content_text", F.lit(""))
    return fresh.select(
        order, "source_id", F.substring(strip(F.coalesce("title", F.lit(""))), 1, title_max).alias("title"), "url",
        published.alias("published_at"), text.alias("content_text"), F.length(text).alias("content_len"),
        canonical_or_url(F.col("canonical_url"), F.col("url")).alias("canonical_url"),
        *[c for c in ("dedup_key", "simhash") if c in items.columns], F.lit("raw").alias("processing_status"))


def queue_rows(articles: DataFrame, key: str) -> DataFrame:
    """One waiting row per stored article."""
    return articles.select(F.col(key).alias("article_id"), F.lit("queued").alias("status"),
                           F.lit(0).alias("priority"), F.lit(0).alias("attempts"))


def crawl_funnel(items: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Rows per source that reached each stage, from flags on the rows."""
    return items.groupBy("source_id").agg(
        F.count("*").alias("fetched"), *[F.count_if(flag).alias(name) for name, flag in stages.items()])
