"""Article rows from landed RSS and Atom files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import clean_text, plain_text, strip
from tidewire.functions.times import parse_local
from tidewire.functions.urls import normalize_url

RSS_ITEM = ("title string, link string, pubDate string, published string, updated string, created string,"
            " `content:encoded` string, summary string, description string, source_id bigint, source_name string")
ATOM_ENTRY = ("title string, link struct<_href: string>, published string, updated string, created string,"
              " content struct<_VALUE: string, _type: string>, summary string, source_id bigint, source_name string")


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Entries of RSS files; one entry per `item` element, schema given."""
    raw = spark.read.format("xml").options(rowTag="item", ignoreNamespace=False, mode="PERMISSIVE").schema(RSS_ITEM).load(path)
    return raw.withColumn("content", F.col("`content:encoded`")).drop("content:encoded")


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("xml").options(rowTag="entry", mode="PERMISSIVE").schema(ATOM_ENTRY).load(path)
    return (raw.withColumn("link", F.col("link._href")).withColumn("content", F.col("content._VALUE"))
            .withColumn("pubDate", F.lit(None).cast("string")).withColumn("description", F.lit(None).cast("string")))


def feed_articles(entries: DataFrame, as_of: Column) -> DataFrame:
    """Entries with title and link as article rows.

    Time is the first of published, updated, created, pubDate that parses, else
    `as_of`. Body is the first of content, summary, description that is there.
    """
    def filled(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    body = F.coalesce(filled("content"), filled("summary"), filled("description"), F.lit(""))
    times = [parse_local(filled(c)) for c in ("published", "updated", "created", "pubDate")]
    title, link = strip(F.col("title")), F.trim("link")
    return (entries.where((title != "") & (link != ""))
            .select(*[c for c in ("source_id", "source_name") if c in entries.columns],
                    title.alias("title"), normalize_url(link).alias("url"),
                    F.coalesce(*times, as_of.cast("timestamp_ntz")).alias("published_at"),
                    clean_text(plain_text(body)).alias("content_text")))
