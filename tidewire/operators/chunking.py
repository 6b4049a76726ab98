"""Split long bodies into chunks under a token target. One row at a time, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.arrays import unfold
from tidewire.functions.text import detect_language, estimate_tokens, split_semantic
from tidewire.params import DEFAULTS, Params

# ---- fixed values -----------------------------------------------------------
OVERALL_CHUNK = "[全文概括]\n前{head}段详细内容已处理，剩余{rest}段需要概括处理。"
# ---- end of fixed values ----------------------------------------------------


def pack_sentences(sentences: Column, target: Column | int, overlap_chars: int, lang: Column) -> Column:
    """Greedy packing with an overlap of `overlap_chars` between full chunks.

    A sentence over the target stands alone and passes no overlap on.
    """
    target = F.lit(target) if isinstance(target, int) else target
    sized = F.transform(sentences, lambda s: F.struct(s.alias("s"), estimate_tokens(s, lang).alias("n")))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("open"), F.lit(0).cast("bigint").alias("tokens"))

    def closed(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    def step(acc: Column, x: Column) -> Column:
        tail = F.when((acc["open"] == "") | F.lit(overlap_chars <= 0), F.lit("")).otherwise(
            F.expr("''") if overlap_chars <= 0 else F.substring(acc["open"], -overlap_chars, overlap_chars))
        alone = F.struct(F.concat(closed(acc), F.array(x["s"])).alias("done"), F.lit("").alias("open"),
                         F.lit(0).cast("bigint").alias("tokens"))
        fresh_text = F.concat(tail, x["s"])
        fresh = F.struct(closed(acc).alias("done"), fresh_text.alias("open"),
                         F.when(tail == "", x["n"]).otherwise(estimate_tokens(fresh_text, lang)).alias("tokens"))
        grown = F.struct(acc["done"].alias("done"), F.concat(acc["open"], x["s"]).alias("open"),
                         (acc["tokens"] + x["n"]).alias("tokens"))
        return (F.when(x["n"] > target, alone)
                .when(acc["tokens"] + x["n"] > target, fresh)
                .otherwise(grown))

    return F.aggregate(sized, start, step, closed)


def plan_chunks(articles: DataFrame, text: str = "content_text", params: Params = DEFAULTS) -> DataFrame:
    """Add language, token estimate, the chunk list and the chunks put off.

    Texts within the budget are one chunk. Beyond `max_chunks` the plan is
    degraded: the first chunks only, or one less plus a summary marker; all others
    are in `deferred`, so that no text is lost.
    """
    target, most = params.token_budget, params.max_chunks
    body = F.col(text)
    sized = (
        articles.where(F.coalesce(body, F.lit("")) != "")
        .withColumn("lang_hint", detect_language(body))
        .withColumn("tokens", estimate_tokens(body, F.col("lang_hint")))
    )
    packed = pack_sentences(split_semantic(body), target, params.overlap_chars, F.col("lang_hint"))
    planned = sized.withColumn("_all", F.when(F.col("tokens") <= target, F.array(body)).otherwise(packed))
    total = F.size("_all")
    over = total > most
    if params.long_text_strategy == "headN_plus_overall":
        rest = F.format_string(OVERALL_CHUNK.replace("{head}", str(most - 1)).replace("{rest}", "%d"),
                               total - most + 1)
        first, shorter = most - 1, F.concat(F.slice("_all", 1, most - 1), F.array(rest))
    else:
        first, shorter = most, F.slice("_all", 1, most)
    later = F.slice("_all", F.lit(first + 1), F.greatest(total - first, F.lit(0)))
    return (
        planned.withColumn("total_chunks", total)
        .withColumn("degraded", over)
        .withColumn("strategy", F.when(over, F.lit(params.long_text_strategy)))
        .withColumn("overflow", F.when(over, total - most).otherwise(0))
        .withColumn("chunks", F.when(over, shorter).otherwise(F.col("_all")))
        .withColumn("deferred_from", F.when(over, first))
        .withColumn("deferred", F.when(over, later).otherwise(F.array().cast("array<string>")))
        .drop("_all")
    )


def chunk_rows(planned: DataFrame, keep: list[str]) -> DataFrame:
    """One row per chunk with its 0-based index."""
    return unfold(planned, keep, "chunks", "chunk_index", "chunk")


def deferred_rows(planned: DataFrame, keep: list[str]) -> DataFrame:
    """One row per chunk put off, with its 0-based index in the whole text."""
    rows = unfold(planned, [*keep, "deferred_from"], "deferred", "_at", "chunk")
    return rows.withColumn("chunk_index", F.col("deferred_from") + F.col("_at")).drop("_at", "deferred_from")
