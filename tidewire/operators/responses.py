"""Model responses: parsed rows, items in chunk order, article roll-ups, attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.arrays import unfold
from tidewire.functions.responses import parse_response
from tidewire.params import DEFAULT_MODELS, DEFAULT_PROVIDER


def parse_responses(responses: DataFrame, content: str = "content") -> DataFrame:
    """One row per chunk: items, keywords, status and error.

    An answer is read and parsed once, whatever is asked of the result: the optimiser
    moves no later filter below an explode, where it would repeat the whole expression.
    """
    read = responses.withColumn("_c", F.explode_outer(F.array(content))).withColumn(
        "_r", F.explode_outer(F.array(parse_response(F.col("_c")))))
    parsed = read.drop("_c")
    bad = F.col("_r").isNull() | F.col("_r._corrupt_record").isNotNull()
    return (parsed
            .withColumn("status", F.when(bad, "failed").otherwise("success"))
            .withColumn("error", F.when(bad, "invalid json"))
            .withColumn("items", F.when(bad, F.expr("array()").cast(parsed.schema["_r"].dataType["items"].dataType))
                        .otherwise(F.coalesce("_r.items", F.expr("array()").cast(
                            parsed.schema["_r"].dataType["items"].dataType))))
            .withColumn("keywords", F.when(bad, F.array().cast("array<string>"))
                        .otherwise(F.coalesce("_r.keywords", F.array().cast("array<string>"))))
            .drop("_r"))


def response_items(parsed: DataFrame) -> DataFrame:
    """Items of the good chunks with a position that follows chunk order."""
    # failed chunks have no items; a filter here would parse every answer twice
    return (unfold(parsed, ["article_id", "chunk_index"], "items", "at", "item")
            .select("article_id", "chunk_index", "at", "item.*"))


def article_keywords(parsed: DataFrame) -> DataFrame:
    """Keywords of an article are those of its first chunk."""
    return (parsed.where("chunk_index = 0 AND status = 'success' AND size(keywords) > 0")
            .select("article_id", "keywords"))


def article_rollup(parsed: DataFrame) -> DataFrame:
    """Status, token sums and the provider and model of the first good chunk."""
    good = F.col("status") == "success"
    failed = F.count_if(~good)
    return (
        parsed.groupBy("article_id").agg(
            F.count("*").alias("total_chunks"), failed.alias("failed_chunks"),
            F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"),
            F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"),
            F.min(F.when(good, F.struct("chunk_index", "provider", "model"))).alias("_first"))
        .withColumn("status", F.when(F.col("failed_chunks") == 0, "success")
                    .when(F.col("failed_chunks") < F.col("total_chunks"), "partial").otherwise("failed"))
        .withColumn("provider", F.coalesce("_first.provider", F.lit(DEFAULT_PROVIDER)))
        .withColumn("model", F.coalesce("_first.model", F.coalesce(
            F.try_element_at(F.create_map(*[F.lit(x) for p in DEFAULT_MODELS.items() for x in p]), F.lower("provider")),
            F.lit(DEFAULT_MODELS[DEFAULT_PROVIDER]))))
        .drop("_first"))


def first_success(attempts: DataFrame, key: str = "request_id", retries: int = 2) -> DataFrame:
    """First good attempt by provider priority; a provider has `retries` + 1 tries."""
    tried = attempts.where(F.col("attempt") <= retries + 1)
    won = F.min(F.when(F.col("ok"), F.struct("priority", "attempt", "provider_name", "model_name")))
    last = F.max_by("error", F.struct("priority", "attempt"))
    return (tried.groupBy(key).agg(won.alias("w"), last.alias("last_error"), F.count("*").alias("attempts"))
            .select(key, F.when(F.col("w").isNull(), "failed").otherwise("success").alias("status"),
                    F.col("w.provider_name").alias("provider_name"), F.col("w.model_name").alias("model_name"),
                    F.when(F.col("w").isNull(), F.col("last_error")).alias("last_error"), "attempts"))
