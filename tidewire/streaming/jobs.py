"""Streaming forms of ingest, exact dedup, queue state and route switches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewire.operators.routes import HOUR_US, SWITCHES, next_state
from tidewire.params import DEFAULTS
from tidewire.runtime import cut, exists, scratch_path


def landed(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Stream over landed Parquet files."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def recent(stream: DataFrame, at: str, as_of: Column, hours: int = DEFAULTS.lookback_hours) -> DataFrame:
    """Rows of the last hours; the same span bounds the state."""
    fresh = stream.where(F.col(at).isNotNull() & (as_of - F.col(at) <= F.expr(f"INTERVAL {hours} HOURS")))
    return fresh.withWatermark(at, f"{hours} hours")


def first_seen(stream: DataFrame, key: list[str], at: str, hours: int = DEFAULTS.lookback_hours) -> DataFrame:
    """Exact dedup within the watermark."""
    return stream.withWatermark(at, f"{hours} hours").dropDuplicatesWithinWatermark(key)


SEEN_BUCKETS = 64
FILTER_BITS = 32768      # of one bucket; a bitmap of 4 kB


def _filter_bit(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(FILTER_BITS)).cast("int")


def touched_buckets(fresh: DataFrame, filters: DataFrame) -> list[int]:
    """Buckets of the history that may hold a key of `fresh`, by the bitmaps of (bucket, bits)."""
    stored = filters.groupBy("bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright("_bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    known = fresh.join(stored, "bucket").where(F.getbit(byte, F.col("_bit").bitwiseAND(7)) == 1)
    return [r["bucket"] for r in known.select("bucket").distinct().collect()]


def append_unseen(target: str, key: str, order: str, buckets: int = SEEN_BUCKETS):
    """foreachBatch writer of rows with new keys; the history stays in files, not in the state store.

    The history is partitioned by a hash of the key. Beside it a bitmap per bucket and batch
    (`<target>-filters`) tells which keys may be stored, and a batch reads only buckets that
    may hold one of its keys. A batch's folders are replaced, so a batch that is run again
    stays exact; filters are written first, so none is missing for stored rows.
    """
    from tidewire.operators.dedup import first_per_key

    filters = f"{target}-filters"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = first_per_key(batch.withColumn(key, F.col(key).cast("string")), key, order)
        fresh = cut(fresh.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).withColumn("_bit", _filter_bit(key)))
        if exists(spark, filters):
            touched = touched_buckets(fresh, spark.read.parquet(filters).where(F.col("batch_id") != batch_id))
            if touched and exists(spark, target):
                stored = spark.read.parquet(target).where(F.col("bucket").isin(touched) & (F.col("batch_id") != batch_id))
                fresh = fresh.join(stored.select(key), key, "left_anti")
        made = fresh.select("bucket", "_bit").distinct().groupBy("bucket").agg(F.bitmap_construct_agg("_bit").alias("bits"))
        rows = fresh.drop("_bit").withColumn("batch_id", F.lit(batch_id))
        for df, path, by in ((made.withColumn("batch_id", F.lit(batch_id)), filters, ["batch_id"]), (rows, target, ["batch_id", "bucket"])):
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

    return write


def count_recent(at: str, as_of: Column, hours: int = DEFAULTS.lookback_hours):
    """foreachBatch writer factory: recent rows, and beside them how many went and why.

    An observation counts the batch on the way to the table, so nothing is read twice;
    `<target>-counts` gets a row per batch and outcome: kept, too_old, no_time.
    """
    outcome = (F.when(F.col(at).isNull(), "no_time")
               .when(as_of - F.col(at) <= F.expr(f"INTERVAL {hours} HOURS"), "kept").otherwise("too_old"))

    def writer(target: str):
        def write(batch: DataFrame, batch_id: int) -> None:
            seen = Observation()
            marked = batch.withColumn("_outcome", outcome).observe(
                seen, *[F.count_if(F.col("_outcome") == o).alias(o) for o in ("kept", "too_old", "no_time")])
            # one file set per batch: a batch that is run again replaces its own
            (marked.where("_outcome = 'kept'").drop("_outcome").withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(target))
            rows = [(batch_id, o, n) for o, n in seen.get.items()]
            (batch.sparkSession.createDataFrame(rows, "batch_id bigint, outcome string, n bigint").coalesce(1).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{target}-counts"))
        return write
    return writer


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, label: str, for_each=None, mode: str = "append", timers: bool = False) -> str:
    """Process what has landed, then stop; returns the folder with the result.

    timers: the stream keeps state with timers, which needs the RocksDB state store.
    """
    spark = stream.sparkSession
    target, marks = scratch_path(spark, label), scratch_path(spark, f"{label}-marks")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True)
    before = spark.conf.get(STATE_STORE, None)
    if timers:
        spark.conf.set(STATE_STORE, ROCKS)
    try:
        query = (writer.foreachBatch(for_each(target)) if for_each else
                 writer.format("parquet").option("path", target)).start()
    finally:
        if timers:
            spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)
    query.awaitTermination()
    return target


class RouteProcessor(StatefulProcessor):
    """Route state of one domain: open failures, and the held route until its timer ends."""

    def __init__(self, limit: int, hold_us: int):
        self.limit, self.hold_us = limit, hold_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("route", "count bigint, route boolean, held boolean, since bigint")

    def _load(self) -> dict:
        if not self.state.exists():
            return {}
        return {k: v for k, v in zip(("count", "route", "held", "since"), self.state.get()) if v is not None}

    def _save(self, current: dict, now_us: int) -> None:
        """Keep the state while something in it can still matter, and wake up when the hold ends."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if "since" in current and now_us - current["since"] >= self.hold_us:
            current = {k: v for k, v in current.items() if k not in ("held", "since")}
        if "count" not in current:
            current = {k: v for k, v in current.items() if k != "route"}
        if not current:
            self.state.clear()
            return
        self.state.update(tuple(current.get(k) for k in ("count", "route", "held", "since")))
        if "since" in current:
            self.handle.registerTimer((current["since"] + self.hold_us) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        current = self._load()
        held = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        made = []
        for seq, at, ok, default in zip(held["seq"], held["ts_us"], held["ok"], held["default_proxy"]):
            current, proxy, switched = next_state(current, int(at), bool(ok), bool(default), self.limit, self.hold_us)
            made.append((key[0], seq, at, proxy, self.limit if switched else current.get("count", 0), switched))
        self._save(current, timerValues.getCurrentWatermarkInMs() * 1000)
        yield pd.DataFrame(made, columns=SWITCHES.fieldNames())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._save(self._load(), timerValues.getCurrentWatermarkInMs() * 1000)
        return iter(())

    def close(self) -> None:
        pass


def route_switch_stream(fetches: DataFrame, limit: int = DEFAULTS.failures_to_switch,
                        hours: int = DEFAULTS.switch_hours, late: str = "24 hours") -> DataFrame:
    """Stateful twin of the batch route switches; run it with `timers`.

    State is one small record per domain, and only while failures are open or a switch
    holds: a timer in event time ends it a hold after the switch. Rows of a domain are
    taken in order inside a batch (its size is the trigger's), batches in order of
    arrival; rows more than `late` behind are dropped.
    """
    timed = fetches.withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", late)
    return timed.groupBy("domain").transformWithStateInPandas(
        RouteProcessor(limit, hours * HOUR_US), SWITCHES, "append", "eventTime")


def replace_result(target: str):
    """foreachBatch writer for the complete mode: the newest result replaces the table."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(target)
    return write


def queue_state_stream(events: DataFrame) -> DataFrame:
    """Running state per article, to be used with the update or complete mode."""
    return events.groupBy("article_id").agg(
        F.max_by("status", "seq").alias("status"), F.count_if(F.col("status") == "running").alias("attempts"),
        F.max("ts").alias("changed_at"))
