"""Registry document with the sources and recipients of an installation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = ("sources array<struct<name: string, type: string, url: string, enabled: boolean, concurrency: int,"
            " timeout_sec: int, parser: string>>, recipients array<string>")


def read_registry(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Source rows with defaults filled, and recipient rows with cleaned addresses."""
    doc = spark.read.schema(REGISTRY).option("multiLine", multi_line).json(path)
    sources = doc.select(F.posexplode("sources").alias("seq", "s")).select(
        "seq", "s.name", "s.type", F.trim("s.url").alias("url"), F.coalesce("s.enabled", F.lit(True)).alias("enabled"),
        F.coalesce("s.concurrency", F.lit(1)).alias("concurrency"),
        F.coalesce("s.timeout_sec", F.lit(30)).alias("timeout_sec"), "s.parser")
    email = F.lower(F.trim("email"))
    recipients = doc.select(F.posexplode("recipients").alias("seq", "email")).select(
        "seq", email.alias("email"), F.substring_index(email, "@", 1).alias("display_name"),
        F.lit("recipient").alias("type"), F.lit(True).alias("enabled"))
    return sources, recipients
