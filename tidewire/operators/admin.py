"""Settings, preferences, recipients and sources: change sets and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions.scoring import blank_to_null, clamp
from tidewire.params import DEFAULT_SETTINGS, DEFAULTS


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Changed, added and removed rows with both states as JSON."""
    old = before.select(F.col(key), F.struct(*columns).alias("_old"))
    new = after.select(F.col(key), F.struct(*columns).alias("_new"))
    changed = old.join(new, key, "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    action = F.when(F.col("_old").isNull(), "create").when(F.col("_new").isNull(), "delete").otherwise("update")
    return changed.select(key, action.alias("action"), F.to_json("_old").alias("before_json"),
                          F.to_json("_new").alias("after_json"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows replace stored ones with the same key."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def with_default_settings(stored: DataFrame, defaults: dict[str, str] = DEFAULT_SETTINGS) -> DataFrame:
    """Stored settings plus the default of every missing key."""
    table = stored.sparkSession.createDataFrame(sorted(defaults.items()), "key string, _default string")
    return (table.join(stored, "key", "full")
            .select("key", F.coalesce("value", "_default").alias("value"),
                    F.when(F.col("value").isNull(), "default").otherwise("stored").alias("origin")))


def clean_source_config(sources: DataFrame) -> DataFrame:
    """Concurrency in 1..50, timeout in 5..300, blank parser is none."""
    return (sources.withColumn("concurrency", clamp(F.col("concurrency"), 1, 50))
            .withColumn("timeout_sec", clamp(F.col("timeout_sec"), 5, 300))
            .withColumn("parser", blank_to_null(F.col("parser"))))


def save_preferences(stored: DataFrame, incoming: DataFrame, limit: int = DEFAULTS.prefs_per_user) -> DataFrame:
    """Latest version per (user, name), at most `limit` names, at most one default.

    A name beyond the limit is refused, as a single save would be; the first
    names of a user count. The default is the last row flagged as such, and a
    later unflagged save of the same name clears it.
    """
    every = stored.unionByName(incoming)
    named = every.withColumn("name", F.trim("name"))
    per_name = named.groupBy("user_email", "name").agg(
        F.min("seq").alias("first_seq"), F.max(F.struct("seq", "scope", "prompt_text", "is_default")).alias("l"),
        F.max(F.when(F.col("is_default"), F.col("seq"))).alias("flagged_seq"))
    order = Window.partitionBy("user_email").orderBy("first_seq")
    kept = (per_name.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
            .select("user_email", "name", "flagged_seq", "l.*"))
    newest = kept.groupBy("user_email").agg(F.max("flagged_seq").alias("_default_seq"))
    return (kept.join(newest, "user_email", "left")
            .withColumn("is_default", F.coalesce(F.col("seq") == F.col("_default_seq"), F.lit(False)))
            .drop("_default_seq", "flagged_seq"))


def delete_rows(stored: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return stored.join(keys.select(*on), on, "left_anti")


def toggle(rows: DataFrame, keys: DataFrame, key: str, value: bool | None = None) -> DataFrame:
    """Flip `enabled` of the listed rows, or set it to `value`."""
    hit = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    new = ~F.col("enabled") if value is None else F.lit(value)
    return (rows.join(hit, key, "left")
            .withColumn("enabled", F.when(F.col("_hit"), new).otherwise(F.col("enabled"))).select(*rows.columns))


def split_conflicts(incoming: DataFrame, stored: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Creates that may go in, and those whose key is taken."""
    taken = stored.select(*on)
    return incoming.join(taken, on, "left_anti"), incoming.join(taken, on, "left_semi")


def retained(rows: DataFrame, at: str, as_of: Column, days: int) -> DataFrame:
    """Rows young enough to keep; a plain range on the time column."""
    return rows.where(F.col(at) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def filtered_log(log: DataFrame, as_of: Column, days: int = 7, action: str | None = None, limit: int = 200) -> DataFrame:
    """Newest log rows of the last days, of one action when given."""
    shown = log.where(F.col("created_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    if action:
        shown = shown.where(F.col("action") == action)
    return shown.orderBy(F.col("created_at").desc(), "log_id").limit(limit)


def action_types(log: DataFrame) -> DataFrame:
    return log.where("action IS NOT NULL AND action <> ''").select("action").distinct().orderBy("action")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def seed_missing(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is absent, first one per key, and the inserted and skipped counts."""
    first = Window.partitionBy(key).orderBy(order)
    ranked = incoming.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    fresh = ranked.join(stored.select(key), key, "left_anti")
    flags = fresh.select(F.lit(1).alias("new"), F.lit(0).alias("seen")).unionByName(
        incoming.select(F.lit(0).alias("new"), F.lit(1).alias("seen")))
    inserted = F.coalesce(F.sum("new"), F.lit(0))
    counts = flags.agg(inserted.alias("inserted"), (F.coalesce(F.sum("seen"), F.lit(0)) - inserted).alias("skipped"))
    return fresh, counts
