"""Token usage: prices, cost, statistics by provider, model and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.scoring import cost, split_tokens
from tidewire.functions.times import trailing_days
from tidewire.params import FALLBACK_PRICE, PRICES

SUMS = ("prompt_tokens", "completion_tokens", "total_tokens")


def price_table(spark) -> DataFrame:
    return spark.createDataFrame(PRICES, "provider string, model string, price_in double, price_out double")


def with_price(usage: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Add input and output price with where they come from: exact, default or fallback.

    Provider is matched in any case, model as written.
    """
    # the fixed table may be broadcast, any other is left to the optimiser
    table = F.broadcast(price_table(usage.sparkSession)) if prices is None else prices
    exact = table.select(F.col("provider").alias("_p"), F.col("model").alias("_m"),
                         F.col("price_in").alias("_ein"), F.col("price_out").alias("_eout"))
    default = table.where("model = 'default'").select(
        F.col("provider").alias("_dp"), F.col("price_in").alias("_din"), F.col("price_out").alias("_dout"))
    provider = F.lower("provider_name")
    return (
        usage.join(exact, (provider == F.col("_p")) & (F.col("model_name") == F.col("_m")), "left")
        .join(default, provider == F.col("_dp"), "left")
        .withColumn("price_in", F.coalesce("_ein", "_din", F.lit(FALLBACK_PRICE[0])))
        .withColumn("price_out", F.coalesce("_eout", "_dout", F.lit(FALLBACK_PRICE[1])))
        .withColumn("price_source", F.when(F.col("_ein").isNotNull(), "exact")
                    .when(F.col("_din").isNotNull(), "default").otherwise("fallback"))
        .drop("_p", "_m", "_ein", "_eout", "_dp", "_din", "_dout"))


def with_cost(usage: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    return (with_price(usage, prices)
            .withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
            .withColumn("cost", cost(F.col("prompt_tokens"), F.col("completion_tokens"),
                                     F.col("price_in"), F.col("price_out"))))


def estimate_cost(plan: DataFrame, tokens: str, ratio: float = 0.7, prices: DataFrame | None = None) -> DataFrame:
    """Cost of a token estimate split into prompt and completion parts."""
    prompt, completion = split_tokens(F.col(tokens), ratio)
    return with_cost(plan.withColumn("prompt_tokens", prompt).withColumn("completion_tokens", completion), prices)


def _measures() -> list[Column]:
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS]
    return [*sums, F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"), F.count("*").alias("calls")]


def usage_since(usage: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return usage.where(trailing_days(F.col("created_at"), as_of, days))


def by_provider(usage: DataFrame) -> DataFrame:
    return usage.groupBy("provider_name").agg(*_measures())


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Per model, per provider and in total, with the mean cost of a call."""
    per_model = usage.groupBy("provider_name", "model_name").agg(*_measures())
    totals = [F.sum(c).alias(c) for c in (*SUMS, "cost", "calls")]
    return (per_model.rollup("provider_name", "model_name").agg(*totals, F.grouping_id().alias("_g"))
            .withColumn("level", F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "provider").otherwise("model"))
            .withColumn("cost_per_call", F.coalesce(F.try_divide("cost", "calls"), F.lit(0))).drop("_g"))


def providers_with_models(usage: DataFrame) -> DataFrame:
    """One row per provider with its model rows nested; models per provider are few."""
    models = usage.groupBy("provider_name", "model_name").agg(*_measures())
    fields = [*SUMS, "cost", "calls"]
    return models.groupBy("provider_name").agg(
        *[F.sum(c).alias(c) for c in fields],
        F.sort_array(F.collect_list(F.struct(F.col("model_name").alias("name"), *fields))).alias("models"))


def by_period(usage: DataFrame, unit: str) -> DataFrame:
    """Tokens and cost per day, week or month."""
    return usage.groupBy(F.date_trunc(unit, "created_at").alias("period")).agg(*_measures())


def by_periods(usage: DataFrame, units: tuple[str, ...] = ("day", "week", "month")) -> DataFrame:
    """Several units at once, from one scan: every row of the daily table counts in each unit."""
    every = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.date_trunc(u, "period").alias("period")) for u in units]))
    totals = [F.sum(c).alias(c) for c in (*SUMS, "cost", "calls")]
    return (by_period(usage, "day").select(every.alias("at"), *SUMS, "cost", "calls")
            .groupBy("at.unit", "at.period").agg(*totals))
