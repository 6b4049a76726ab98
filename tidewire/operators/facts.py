"""Extracted facts: quality filters, merging within an article, majority labels."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewire.functions.responses import recode, stored_layer, stored_region
from tidewire.functions.simhash import simhash64
from tidewire.functions.text import normalize_fact
from tidewire.operators.numbering import ordered_fold
from tidewire.operators.similar import components, near_pairs
from tidewire.params import DEFAULTS, LAYER_CODES, LENIENT_LAYER, REGION_CODES, UNKNOWN
from tidewire.runtime import cut


def drop_low_quality(items: DataFrame, min_confidence: float = DEFAULTS.confidence_threshold,
                     min_fact_len: int = DEFAULTS.fact_min_len) -> DataFrame:
    filled = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("fact", "region", "layer")]
    return items.where(
        (F.coalesce(F.col("confidence"), F.lit(0.0)) >= min_confidence)
        & (F.length(F.coalesce(F.col("fact"), F.lit(""))) >= min_fact_len)
        & filled[0] & filled[1] & filled[2])


def drop_irrelevant(items: DataFrame, layer: str = "layer", relevance: str = "finance_relevance",
                    lenient_layer: str = LENIENT_LAYER) -> DataFrame:
    """Relevance of at least 0.4, or 0.2 in the lenient layer."""
    floor = F.when(F.col(layer) == lenient_layer, F.lit(0.2)).otherwise(F.lit(0.4))
    return items.where(F.coalesce(F.col(relevance), F.lit(1.0)) >= floor)


def to_stored_items(items: DataFrame) -> DataFrame:
    """Items with stored region and layer values and filled defaults."""
    return items.select(
        "article_id", F.coalesce("fact", F.lit("")).alias("fact"), F.coalesce("opinion", F.lit("")).alias("opinion"),
        stored_region(F.coalesce("region", F.lit(UNKNOWN))).alias("region"),
        stored_layer(F.coalesce("layer", F.lit(UNKNOWN))).alias("layer"),
        F.coalesce("evidence_span", F.lit("")).alias("evidence_span"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("finance_relevance", F.lit(1.0)).alias("finance_relevance"))


def recode_history(items: DataFrame, status_columns: tuple[str, ...] = (), back: bool = False) -> DataFrame:
    """Bring old rows to the current codes, or rows back to the old ones."""
    def codes(table: dict[str, str]) -> dict[str, str]:
        return {new: old for old, new in table.items()} if back else table

    out = (items.withColumn("region", recode(F.col("region"), codes(REGION_CODES)))
           .withColumn("layer", recode(F.col("layer"), codes(LAYER_CODES)))
           .withColumn("finance_relevance", F.coalesce("finance_relevance", F.lit(1.0))))
    for name in status_columns:
        out = out.withColumn(name, F.lower(name))
    return out


def cap_per_article(items: DataFrame, limit: int, order: list) -> DataFrame:
    """Best rows of each article; the limit is pushed below the shuffle."""
    ranked = Window.partitionBy("article_id").orderBy(*order)
    return items.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= limit).drop("_rank")


def fill_by_majority(items: DataFrame, columns: tuple[str, ...] = ("region", "layer"),
                     position: str = "position") -> DataFrame:
    """Replace unknown labels by the most frequent one of the article.

    Ties go to the label seen first. Counts are combined before the shuffle.
    """
    labels = F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c), F.lit(UNKNOWN)).alias("v")) for c in columns])
    counted = (items.select("article_id", F.col(position).alias("_p"), F.explode(labels).alias("_l"))
               .groupBy("article_id", "_l.c", "_l.v").agg(F.count("*").alias("_n"), F.min("_p").alias("_first")))
    rank = F.struct("_n", -F.col("_first"))
    top = counted.groupBy("article_id").agg(*[
        F.max_by("v", F.when(F.col("c") == name, rank)).alias(f"_top_{name}") for name in columns])
    out = items.join(top, "article_id")
    for name in columns:
        known = F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(UNKNOWN)) != UNKNOWN
        out = out.withColumn(name, F.when(known, F.col(name)).otherwise(F.col(f"_top_{name}"))).drop(f"_top_{name}")
    return out


KEPT = T.StructType([
    T.StructField("group", T.StringType()),
    T.StructField("item", T.LongType()),
])


def _merge_fold(rows: pd.DataFrame, state: str) -> tuple[None, str]:
    """Arrival-order merge of one similarity component; the state is the kept list.

    An index from node to the kept facts of that node finds the earliest kept fact that
    is near, so a fact costs as many steps as its node has neighbours.
    """
    kept = dict(enumerate(json.loads(state) if state else []))
    of_node: dict[int, list[int]] = {}
    for place, fact in kept.items():
        of_node.setdefault(fact[1], []).append(place)
    place = len(kept)
    for item, node, conf, near in zip(rows["item"].tolist(), rows["node"].tolist(), rows["confidence"].tolist(), rows["near"]):
        match = min((of_node[n][0] for n in (node, *near.tolist()) if of_node.get(n)), default=None)
        if match is not None:
            if conf <= kept[match][2]:
                continue
            of_node[kept.pop(match)[1]].remove(match)
        kept[place] = [item, node, conf]
        of_node.setdefault(node, []).append(place)
        place += 1
    return None, json.dumps(list(kept.values()))


def _merge_result(state: str) -> pd.DataFrame:
    kept = json.loads(state) if state else []
    return pd.DataFrame({"group": [None] * len(kept), "item": [k[0] for k in kept]})


def merge_facts(items: DataFrame, position: str = "position", max_bits: int = 3,
                segment_rows: int = 500_000) -> DataFrame:
    """Drop similar facts of an article in arrival order, keeping higher confidence.

    `position` is a unique whole number that gives the arrival order. A better
    fact replaces the one it matches and becomes the text later facts are
    compared with. Facts interact only inside a component of the similarity
    graph of their article: repeats of one text are a plain aggregate, and only
    components with several texts are folded in order, in bounded segments.
    """
    facts = items.where(F.coalesce(F.col("fact"), F.lit("")) != "")
    hashed = cut(facts.select("article_id", F.col(position).alias("item"),
                              F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
                              simhash64(normalize_fact(F.col("fact"))).alias("simhash")))
    # facts with one hash are alike; the best of them, first one on ties
    nodes = cut(hashed.groupBy("article_id", "simhash").agg(
        F.min("item").alias("first"), F.max_by("item", F.struct("confidence", -F.col("item"))).alias("best")))
    pairs = cut(near_pairs(nodes, "simhash", "first", scope=["article_id"], max_bits=max_bits).select("a", "b"))
    if pairs.isEmpty():
        kept = nodes.select(F.col("best").alias(position))
        return items.join(kept, position, "left_semi")
    labels = components(pairs)
    linked = nodes.join(labels, nodes["first"] == labels["node"])
    near = (pairs.select(F.col("a").alias("node"), F.col("b").alias("other"))
            .unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
            .groupBy("node").agg(F.collect_set("other").alias("near")))
    several = (hashed.join(linked.select("article_id", "simhash", "node", "label"), ["article_id", "simhash"])
               .join(near, "node")
               .select(F.col("label").cast("string").alias("group"), "item", "node", "confidence", "near"))
    folded = ordered_fold(several, ["group"], ["item"], _merge_fold, KEPT, _merge_result, segment_rows).select("item")
    single = nodes.join(labels, nodes["first"] == labels["node"], "left_anti").select(F.col("best").alias("item"))
    kept = single.unionByName(folded)
    return items.join(kept.withColumnRenamed("item", position), position, "left_semi")


def similar_facts(items: DataFrame, position: str = "position", max_bits: int = 3) -> DataFrame:
    """Pairs of distinct fact texts of one article within `max_bits`."""
    hashed = items.where("fact <> ''").select(
        "article_id", F.col(position).alias("node"), simhash64(normalize_fact(F.col("fact"))).alias("simhash"))
    nodes = cut(hashed.groupBy("article_id", "simhash").agg(F.min("node").alias("first")))
    return near_pairs(nodes, "simhash", "first", scope=["article_id"], max_bits=max_bits)


def merge_counts(items: DataFrame, merged: DataFrame, chunk: str = "chunk_index") -> DataFrame:
    """Chunks and facts before and after the merge, by article."""
    before = items.groupBy("article_id").agg(
        F.count_distinct(chunk).alias("total_chunks"), F.count("*").alias("original_count"))
    after = merged.groupBy("article_id").agg(F.count("*").alias("merged_count"))
    return (before.join(after, "article_id", "left").fillna(0, ["merged_count"])
            .withColumn("dedup_count", F.col("original_count") - F.col("merged_count")))
