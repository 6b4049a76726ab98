"""Table schemas and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.runtime import cut

TABLES = {
    "sources": "source_id BIGINT, source_name STRING, type STRING, url STRING, enabled BOOLEAN, concurrency INT,"
               " timeout_sec INT, parser STRING, region_hint STRING, weight DOUBLE",
    "articles": "article_id BIGINT, source_id BIGINT, title STRING, url STRING, published_at TIMESTAMP_NTZ,"
                " fetched_at TIMESTAMP_NTZ, content_text STRING, content_len INT, section STRING, region_tag STRING,"
                " lang STRING, simhash BIGINT, canonical_url STRING, dedup_key STRING, processing_status STRING,"
                " keywords ARRAY<STRING>",
    "extraction_queue": "article_id BIGINT, provider_hint STRING, priority INT, attempts INT, status STRING,"
                        " last_error STRING, started_at TIMESTAMP_NTZ, finished_at TIMESTAMP_NTZ",
    "extraction_items": "item_id BIGINT, article_id BIGINT, fact STRING, opinion STRING, region STRING, layer STRING,"
                        " evidence_span STRING, confidence DOUBLE, finance_relevance DOUBLE",
    "reports": "report_date DATE, version INT, overview_summary STRING, sections_json STRING, html_body STRING,"
               " html_attachment STRING, build_meta STRING, build_ms INT",
    "report_recipients": "email STRING, type STRING, display_name STRING, enabled BOOLEAN",
    "delivery_log": "report_id BIGINT, batch_no BIGINT, recipients_snapshot STRING, message_id STRING, status STRING,"
                    " error_code STRING, error_message STRING, sent_at TIMESTAMP_NTZ, duration_ms INT",
    "provider_usage": "provider_name STRING, model_name STRING, article_id BIGINT, prompt_tokens BIGINT,"
                      " completion_tokens BIGINT, total_tokens BIGINT, cost DECIMAL(18,6), created_at TIMESTAMP_NTZ",
    "system_settings": "key STRING, value STRING, updated_at TIMESTAMP_NTZ",
    "admin_audit_log": "log_id BIGINT, admin_email STRING, action STRING, resource_type STRING, resource_id BIGINT,"
                       " before_json STRING, after_json STRING, created_at TIMESTAMP_NTZ",
    "user_preferences": "user_email STRING, name STRING, scope STRING, prompt_text STRING, is_default BOOLEAN, seq BIGINT",
    "watchlist_rules": "rule_id BIGINT, type STRING, pattern STRING, is_enabled BOOLEAN, priority INT",
    "blocklist_rules": "rule_id BIGINT, type STRING, pattern STRING, is_enabled BOOLEAN, reason STRING",
    "report_notes": "report_date DATE, scope STRING, section_key STRING, content_md STRING",
}


def missing_tables(spark: SparkSession, database: str) -> DataFrame:
    """Declared tables the catalog does not have."""
    wanted = spark.createDataFrame([(n,) for n in TABLES], "tableName string")
    present = spark.sql(f"SHOW TABLES IN {database}").select("tableName")
    return wanted.exceptAll(present)


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Rewrite only the partitions present in `df`; others stay."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def write_months(df: DataFrame, path: str, at: str) -> None:
    """Append rows to a table partitioned by the month of `at`; rows without a time have a partition of their own."""
    append(df.withColumn("month", F.date_format(at, "yyyy-MM")), path, ["month"])


def drop_before(spark: SparkSession, path: str, at: str, as_of: Column, days: int) -> tuple[list[str], str | None]:
    """Drop the rows of a month-partitioned table whose time is more than `days` before `as_of`.

    Months that lie wholly before go as folders, without being read; only the month in
    which the limit falls is rewritten. Rows without a time stay, as they would under
    DELETE. Returns the months dropped and the month rewritten.
    """
    limit = spark.range(1).select((as_of - F.expr(f"INTERVAL {days} DAYS")).alias("t")).select(
        F.date_format("t", "yyyy-MM").alias("month"), F.col("t")).first()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    months = {s.getPath().getName().removeprefix("month="): s.getPath() for s in fs.listStatus(folder)
              if s.isDirectory() and s.getPath().getName().startswith("month=") and s.getPath().getName()[6:7].isdigit()}
    gone = sorted(m for m in months if m < limit["month"])
    for month in gone:
        fs.delete(months[month], True)
    if limit["month"] not in months:
        return gone, None
    edge = spark.read.parquet(path).where((F.col("month") == limit["month"]) & (F.col(at) >= F.lit(limit["t"])))
    kept = cut(edge)
    if kept.isEmpty():
        fs.delete(months[limit["month"]], True)
    else:
        replace_partitions(kept, path, ["month"])
    return gone, limit["month"]
