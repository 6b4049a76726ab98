"""Extraction queue: state from an event log, selection, failures, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.times import on_day

# ---- fixed values -----------------------------------------------------------
QUEUED, RUNNING, DONE, FAILED = "queued", "running", "done", "failed"
RETRY_PRIORITY = 100
# ---- end of fixed values ----------------------------------------------------


def queue_state(events: DataFrame) -> DataFrame:
    """Current row of every article from (article_id, seq, ts, status, error).

    `seq` orders the events of an article. A `queued` event after others is a
    retry and clears times and error; `running` starts an attempt. All parts are
    order-free aggregates, so a hot article is combined before the shuffle.
    """
    at = F.col("seq")
    is_queued, is_running = F.col("status") == QUEUED, F.col("status") == RUNNING
    ended = F.col("status").isin(DONE, FAILED)
    state = events.groupBy("article_id").agg(
        F.max(F.struct("seq", "status", "error")).alias("_last"),
        F.max(F.when(is_queued, at)).alias("_reset"),
        F.max(F.when(is_running, F.struct("seq", "ts"))).alias("_run"),
        F.max(F.when(ended, F.struct("seq", "ts"))).alias("_end"),
        F.count_if(is_running).alias("attempts"),
        F.max(F.when(is_queued, F.coalesce("priority", F.lit(0)))).alias("priority"))
    since = F.coalesce("_reset", F.lit(-1))
    return state.select(
        "article_id", F.col("_last.status").alias("status"), F.coalesce("priority", F.lit(0)).alias("priority"),
        "attempts", F.when(F.col("_last.status") == FAILED, F.col("_last.error")).alias("last_error"),
        F.when(F.col("_run.seq") > since, F.col("_run.ts")).alias("started_at"),
        F.when((F.col("_end.seq") > since) & (F.col("_end.seq") > F.coalesce("_run.seq", F.lit(-1))),
               F.col("_end.ts")).alias("finished_at"))


def select_queued(queue: DataFrame, articles: DataFrame | None = None, day: Column | None = None) -> DataFrame:
    """Waiting rows, most urgent first; with a day only articles created on it."""
    waiting = queue.where(F.col("status") == QUEUED)
    if day is not None:
        made = articles.where(on_day(F.col("created_at"), day)).select("article_id")
        waiting = waiting.join(made, "article_id", "left_semi")
    return waiting.orderBy(F.col("priority").desc(), "article_id")


def failed_on(rows: DataFrame, day: Column, status: str = "status") -> DataFrame:
    """Failed rows published or fetched on a day."""
    return rows.where((F.col(status) == FAILED) & (on_day(F.col("published_at"), day) | on_day(F.col("fetched_at"), day)))


def retried(rows: DataFrame, keep_attempts: bool = True) -> DataFrame:
    """Failed rows back in the queue."""
    out = rows.withColumn("status", F.lit(QUEUED))
    return out if keep_attempts else out.withColumn("attempts", F.lit(0).cast("bigint"))


def retry_articles(queue: DataFrame, article_ids: DataFrame) -> DataFrame:
    """Requeue listed articles; those not queued yet enter with high priority."""
    wanted = article_ids.select("article_id").distinct().withColumn("_want", F.lit(True))
    both = queue.join(wanted, "article_id", "full")
    want, fresh = F.col("_want").isNotNull(), F.col("status").isNull()
    return both.select(
        "article_id", F.when(want, QUEUED).otherwise(F.col("status")).alias("status"),
        F.when(fresh, RETRY_PRIORITY).otherwise(F.col("priority")).alias("priority"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
        *[F.when(~want, F.col(c)).alias(c) for c in ("last_error", "started_at", "finished_at")])


def queue_health(queue: DataFrame, as_of: Column) -> DataFrame:
    """Depth, failure rate, tasks of the last day and mean time to finish."""
    recent = F.col("started_at") >= as_of - F.expr("INTERVAL 24 HOURS")
    finished = F.col("status").isin(DONE, FAILED)
    took = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in (QUEUED, RUNNING, DONE, FAILED)]
    return queue.agg(
        *counts, F.count_if(recent).alias("last_day"),
        F.coalesce(F.try_divide(F.count_if(F.col("status") == FAILED), F.count_if(finished)), F.lit(0.0)).alias("failure_rate"),
        (F.avg(F.when(finished, took)) / 1e6).alias("mean_seconds"))


def done_on(queue: DataFrame, day: Column) -> DataFrame:
    return queue.where((F.col("status") == DONE) & on_day(F.col("finished_at"), day)).agg(F.count("*").alias("done"))
