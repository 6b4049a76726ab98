"""Ordered numbering and ordered folds that never gather a whole group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewire.runtime import by_key, cut

_LOW = (1 << 33) - 1


def _as_columns(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def in_ranges(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = ()) -> DataFrame:
    """The rows in range partitions on (group, order), written once, with `_part` and `_at` (place in it)."""
    keys = [F.col(c).asc() for c in by]
    order_cols = _as_columns(order)
    return cut(
        df.repartitionByRange(*keys, *order_cols)
        .sortWithinPartitions(*keys, *order_cols)
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(_LOW))


def carried(placed: DataFrame, by: Sequence[str], **values: tuple[str, Column]) -> DataFrame:
    """Add running values over groups of any size that `in_ranges` has spread over partitions.

    Each value is (kind, column): `last` is the last one of the earlier rows that is not
    null, `max` the largest of the earlier rows, `min` the smallest from the row on. A
    window sees one partition of a group; one row per (partition, group) carries the rest.
    """
    ahead = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy("_part", *by).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    parts = Window.partitionBy(*[f"_by_{c}" for c in by]).orderBy("_of")
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*[f"_by_{c}" for c in by]).orderBy(F.desc("_of")).rowsBetween(Window.unboundedPreceding, -1)
    near, edge, far, both = [], [], [], []
    for name, (kind, value) in values.items():
        if kind == "last":
            near.append(F.last(value, True).over(ahead).alias(f"_near_{name}"))
            edge.append(F.max_by(value, F.when(value.isNotNull(), F.col("_at"))).alias(name))
            far.append(F.last(name, True).over(earlier).alias(f"_far_{name}"))
            both.append(F.coalesce(f"_near_{name}", f"_far_{name}").alias(name))
        elif kind == "max":
            near.append(F.max(value).over(ahead).alias(f"_near_{name}"))
            edge.append(F.max(value).alias(name))
            far.append(F.max(name).over(earlier).alias(f"_far_{name}"))
            both.append(F.greatest(f"_near_{name}", f"_far_{name}").alias(name))
        else:
            near.append(F.min(value).over(onward).alias(f"_near_{name}"))
            edge.append(F.min(value).alias(name))
            far.append(F.min(name).over(later).alias(f"_far_{name}"))
            both.append(F.least(f"_near_{name}", f"_far_{name}").alias(name))
    edges = placed.groupBy("_part", *by).agg(*edge).select(
        F.col("_part").alias("_of"), *[F.col(c).alias(f"_by_{c}") for c in by], *values)
    edges = edges.select("_of", *[f"_by_{c}" for c in by], *far)
    rows = placed.select("*", *near)
    match = [rows["_part"] == edges["_of"]] + [rows[c].eqNullSafe(edges[f"_by_{c}"]) for c in by]
    return cut(rows.join(edges, match).select(*placed.columns, *both))


def number_rows(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (),
                name: str = "position") -> DataFrame:
    """Add the 1-based position of a row in its group.

    The rows are range-partitioned on (group, order), so a group of any size
    spreads over many tasks; only one count per (partition, group) is combined.
    `order` must end in a unique key.
    """
    placed = in_ranges(df, order, by)
    counts = placed.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", *[F.col(c).alias(f"_by_{c}") for c in by], "_first",
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    match = [placed["_part"] == offsets["_part"]] + [placed[c].eqNullSafe(offsets[f"_by_{c}"]) for c in by]
    return (
        placed.join(offsets, match)
        .withColumn(name, (placed["_at"] - F.col("_first") + F.col("_before") + 1).cast("bigint"))
        .select(*df.columns, name)
    )


Fold = Callable[[pd.DataFrame, str], tuple[pd.DataFrame | None, str]]


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, out: T.StructType,
                 final: Callable[[str], pd.DataFrame] | None = None, segment_rows: int = 500_000) -> DataFrame:
    """Fold each group in order with a small text state.

    `fold(rows, state)` returns output rows and the next state; `final(state)`
    may add rows after the last one. Groups of up to `segment_rows` rows are
    folded in one call. Larger groups are numbered, cut into segments and
    folded segment by segment, the state being carried between rounds, so no
    task ever holds more than one segment.
    """
    columns = list(df.columns)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    large = cut(sizes.where(F.col("_rows") > segment_rows))
    names = out.fieldNames()

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order), kind="stable")
        made, state = fold(rows, "")
        shown = [m for m in (made, final(state) if final else None) if m is not None]
        made = pd.concat(shown, ignore_index=True) if shown else pd.DataFrame({n: [] for n in names})
        for k in keys:
            made[k] = rows[k].iloc[0]
        return made[names]

    if large.isEmpty():
        return by_key(df, *keys).groupBy(*keys).applyInPandas(whole, out)

    small = by_key(df.join(large, list(keys), "left_anti"), *keys).groupBy(*keys).applyInPandas(whole, out)
    hot = df.join(large.select(*keys), list(keys), "left_semi")
    cutting = cut(number_rows(hot, order, keys, "_position").withColumn(
        "_segment", F.floor((F.col("_position") - 1) / segment_rows).cast("bigint")))
    last = cutting.agg(F.max("_segment")).first()[0]
    carried_type = T.StructType([T.StructField("_state", T.StringType()), *out.fields])
    state_cols = [*keys, "_state"]
    parts, states = [], None

    def step(key: tuple, rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        state = before["_state"].iloc[0] if len(before) else ""
        if len(rows):
            rows = rows.sort_values(list(order), kind="stable")
            made, state = fold(rows[columns], state)
        else:
            made = None
        carry = pd.DataFrame([{**{n: None for n in names}, "_state": state}], columns=["_state", *names], dtype=object)
        if made is None or not len(made):
            made = carry
        else:
            made = made.reindex(columns=["_state", *names]).astype(object)
            made = pd.concat([made.where(made.notna(), None), carry], ignore_index=True)
        for k, v in zip(keys, key):
            made[k] = v
        return made

    for number in range(last + 1):
        rows = cutting.where(F.col("_segment") == number)
        if states is None:
            states = large.select(*keys).withColumn("_state", F.lit(""))
        folded = cut(rows.groupBy(*keys).cogroup(states.select(*state_cols).groupBy(*keys))
                     .applyInPandas(step, carried_type))
        parts.append(folded.where(F.col("_state").isNull()).select(*names))
        states = folded.where(F.col("_state").isNotNull()).select(*state_cols)
    if final:
        def finish(rows: pd.DataFrame) -> pd.DataFrame:
            made = final(rows["_state"].iloc[0])
            for k in keys:
                made[k] = rows[k].iloc[0]
            return made[names]
        parts.append(states.groupBy(*keys).applyInPandas(finish, out))
    for part in parts:
        small = small.unionByName(part)
    return small
