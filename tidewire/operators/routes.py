"""Consecutive fetch failures per domain and the route switches they cause."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.operators.numbering import carried, in_ranges
from tidewire.params import DEFAULTS

SWITCHES = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("via_proxy", T.BooleanType()),
    T.StructField("failures", T.LongType()),
    T.StructField("switched", T.BooleanType()),
])
HOUR_US = 3_600_000_000


def next_state(state: dict, at: int, ok: bool, default_proxy: bool, limit: int, hold_us: int) -> tuple[dict, bool, bool]:
    """State after one fetch, the route it used, and whether it switched.

    state: count, route (of the counted failures), held (route after a switch), since.
    """
    held = "since" in state and at - state["since"] < hold_us
    proxy = state["held"] if held else default_proxy
    if ok:
        state.pop("count", None)
        return state, proxy, False
    count = state["count"] + 1 if "count" in state and state["route"] == proxy else 1
    if count >= limit:
        return {"held": not proxy, "since": at}, proxy, True
    return {**state, "count": count, "route": proxy}, proxy, False


def with_islands(fetches: DataFrame, hold_us: int) -> DataFrame:
    """Add `island`: the seq of the first fetch of a stretch that no earlier fetch of the domain can influence.

    A success clears the count, and only a third failure in a row can switch. So a stretch
    begins after a success, where every later fetch is a full hold after any such failure.
    """
    placed = in_ranges(fetches, ["seq"], ["domain"])
    placed = carried(placed, ["domain"], before=("last", F.col("ok")))
    placed = carried(placed, ["domain"], before2=("last", F.col("before")))
    third = ~F.col("ok") & ~F.coalesce("before", F.lit(True)) & ~F.coalesce("before2", F.lit(True))
    placed = carried(placed, ["domain"], risky=("max", F.when(third, F.col("ts_us"))), soonest=("min", F.col("ts_us")))
    free = F.col("risky").isNull() | (F.col("soonest") - F.col("risky") >= hold_us)
    begins = F.when(F.coalesce("before", F.lit(True)) & free, F.col("seq"))
    placed = carried(placed.withColumn("begins", begins), ["domain"], begun=("last", F.col("begins")))
    return placed.select(*fetches.columns, F.coalesce("begins", "begun").alias("island"))


def route_switches(fetches: DataFrame, limit: int = DEFAULTS.failures_to_switch,
                   hours: int = DEFAULTS.switch_hours) -> DataFrame:
    """Route and failure count at every fetch of (domain, seq, ts_us, ok, default_proxy).

    Domains are folded by islands, so a busy domain is many groups, and rows stream
    through the fold, so an island of any length needs no memory. `limit` is 3 or more.
    """
    if limit < 3:
        raise ValueError("islands hold for limits from 3")
    hold = hours * HOUR_US

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_island, current = None, {}
        for rows in batches:
            made = []
            for domain, island, seq, at, ok, default in rows.itertuples(index=False):
                if (domain, island) != at_island:
                    at_island, current = (domain, island), {}
                current, proxy, switched = next_state(current, int(at), bool(ok), bool(default), limit, hold)
                made.append((domain, seq, at, proxy, limit if switched else current.get("count", 0), switched))
            yield pd.DataFrame(made, columns=SWITCHES.fieldNames())

    dealt = with_islands(fetches.select("domain", "seq", "ts_us", "ok", "default_proxy"), hold)
    return (dealt.select("domain", "island", "seq", "ts_us", "ok", "default_proxy").repartition("domain", "island")
            .sortWithinPartitions("domain", "island", "seq").mapInPandas(fold, SWITCHES))


def route_stats(switches: DataFrame) -> DataFrame:
    """Fetches, open failures and switches per domain."""
    return switches.groupBy("domain").agg(
        F.count("*").alias("fetches"), F.count_if("switched").alias("switches"),
        F.max_by(F.when(F.col("switched"), 0).otherwise(F.col("failures")), "seq").alias("open_failures"))
