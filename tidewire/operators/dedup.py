"""Article deduplication by address and by body."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions.bits import bit_set, may_hold
from tidewire.functions.simhash import simhash64
from tidewire.functions.urls import dedup_key
from tidewire.operators.similar import dropped_by_leaders, near_pairs
from tidewire.runtime import cut


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Earliest row of each non-empty key.

    The `= 1` filter becomes a group limit before the shuffle, so a key that
    holds much of the table sends one row per task.
    """
    first = Window.partitionBy(key).orderBy(order)
    return (
        df.where(F.coalesce(F.col(key), F.lit("")) != "")
        .withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
    )


def dedup_by_url(items: DataFrame, order: str, known: DataFrame | None = None, url: str = "url") -> DataFrame:
    """Keep the first row per URL that is not known yet."""
    fresh = first_per_key(items, url, order)
    if known is None:
        return fresh
    return fresh.join(known.where(F.col(url).isNotNull()).select(url), url, "left_anti")


def known_references(stored: DataFrame, keep: Sequence[str] = (), fresh: DataFrame | None = None,
                     url: str = "url", simhash: str = "simhash") -> DataFrame:
    """Stored rows that have an address or a hash, those columns alone.

    With `fresh`, only rows whose address or hash may be among the fresh ones: bit sets of
    the fresh keys thin out the history in its scan, before anything is shuffled. A row
    that is left may still match nothing; a join decides.
    """
    rows = stored.where(F.col(url).isNotNull() | F.col(simhash).isNotNull()).select(*keep, url, simhash)
    if fresh is None:
        return rows
    return rows.where(may_hold(bit_set(fresh, url), F.col(url)) | may_hold(bit_set(fresh, simhash), F.col(simhash)))


def body_hashes(items: DataFrame, order: str, text: str) -> DataFrame:
    """(order, simhash) of the rows that have a body, written once."""
    return cut(items.where(F.coalesce(F.col(text), F.lit("")) != "")
               .select(F.col(order).alias("_order"), simhash64(F.col(text)).alias("simhash")))


def hash_nodes(hashes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One node per non-zero hash; known hashes come before all new ones."""
    fresh = (hashes.where("simhash <> 0").groupBy("simhash")
             .agg(F.min("_order").alias("_order")).withColumn("_known", F.lit(False)))
    if known is None:
        return fresh
    lowest = F.lit(-(1 << 62)).cast("bigint")
    stored = (known.where("simhash IS NOT NULL AND simhash <> 0").select("simhash").distinct()
              .withColumn("_order", lowest).withColumn("_known", F.lit(True)))
    return stored.unionByName(fresh.join(stored.select("simhash"), "simhash", "left_anti"))


def kept_by_body(hashes: DataFrame, known: DataFrame | None = None, max_bits: int = 3) -> DataFrame:
    """Order values and hashes that survive the near-duplicate pass."""
    nodes = cut(hash_nodes(hashes, known))
    pairs = cut(near_pairs(nodes, "simhash", "_order", known="_known", max_bits=max_bits))
    near_known = pairs.where("known_a").select(F.col("b").alias("node")).distinct()
    open_pairs = (pairs.where("NOT known_a")
                  .join(near_known.select(F.col("node").alias("a")), "a", "left_anti")
                  .join(near_known.select(F.col("node").alias("b")), "b", "left_anti"))
    lost = near_known.unionByName(dropped_by_leaders(open_pairs))
    leaders = (nodes.where("NOT _known").select("_order", "simhash")
               .join(lost.select(F.col("node").alias("_order")), "_order", "left_anti"))
    return leaders.unionByName(hashes.where("simhash = 0").select("_order", "simhash"))


def dedup_by_body(items: DataFrame, order: str, text: str = "content_text", known: DataFrame | None = None,
                  max_bits: int = 3) -> DataFrame:
    """Keep a row when no earlier kept (or known) body is within `max_bits`.

    Rows without body are dropped; `order` must be a unique whole number.
    Rows are joined back on `order`, never on the hash, so a hash shared by
    many copies makes no hot key.
    """
    kept = kept_by_body(body_hashes(items, order, text), known, max_bits)
    return items.join(kept.withColumnRenamed("_order", order), order)


def dedup(items: DataFrame, order: str, known_urls: DataFrame | None = None,
          known_hashes: DataFrame | None = None, max_bits: int = 3) -> DataFrame:
    """URL pass, then body pass, then the dedup key."""
    by_url = cut(dedup_by_url(items, order, known_urls))
    by_body = dedup_by_body(by_url, order, "content_text", known_hashes, max_bits)
    canonical = F.col("canonical_url") if "canonical_url" in items.columns else F.lit(None).cast("string")
    return by_body.withColumn("dedup_key", dedup_key(canonical, F.col("url"), F.col("title"), F.col("published_at")))
