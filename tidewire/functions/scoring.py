"""Score, price, hash distance and schedule expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours_between(later: Column, earlier: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(3_600_000_000.0)


def recency(published_at: Column, as_of: Column) -> Column:
    """1 at `as_of`, 0 a day earlier, 0.5 when unknown; above 1 for later times."""
    fresh = F.greatest(F.lit(0.0), F.lit(1.0) - hours_between(as_of, published_at) / F.lit(24.0))
    return F.when(published_at.isNull(), F.lit(0.5)).otherwise(fresh)


def score(confidence: Column, published_at: Column, as_of: Column, weight: Column | None = None,
          relevance: Column | None = None) -> Column:
    weight = F.lit(1.0) if weight is None else F.coalesce(weight, F.lit(1.0))
    relevance = F.lit(1.0) if relevance is None else F.coalesce(relevance, F.lit(1.0))
    return (
        F.lit(0.4) * F.coalesce(confidence, F.lit(0.5))
        + F.lit(0.1) * recency(published_at, as_of)
        + F.lit(0.2) * F.least(F.lit(1.0), weight)
        + F.lit(0.3) * relevance
    )


def cost(prompt_tokens: Column, completion_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """Six decimals, half to even, computed on decimals."""
    tokens = "decimal(18,0)"
    price = "decimal(9,4)"
    total = prompt_tokens.cast(tokens) * price_in.cast(price) + completion_tokens.cast(tokens) * price_out.cast(price)
    return (F.bround(total.cast("decimal(30,4)"), 0) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")


def split_tokens(tokens: Column, ratio: float = 0.7) -> tuple[Column, Column]:
    """Prompt and completion parts of a token estimate, each cut to a whole number."""
    return F.floor(tokens * F.lit(ratio)), F.floor(tokens * F.lit(1 - ratio))


def hash_distance(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def same_content(left: Column, right: Column, max_bits: int = 3) -> Column:
    return (left != 0) & (right != 0) & (hash_distance(left, right) <= max_bits)


def retry_delay(attempt: Column, base_sec: float = 2.0) -> Column:
    return F.lit(base_sec) * F.pow(F.lit(2.0), attempt)


def planned_send_time(start: Column, batch_no: Column, rate_per_sec: float = 1.0) -> Column:
    """Batches leave at a fixed rate, the first one at `start`."""
    micros = ((batch_no - 1) * F.lit(1_000_000.0 / rate_per_sec)).cast("bigint")
    return F.timestamp_micros(F.unix_micros(start.cast("timestamp")) + micros)


def clamp(value: Column, low: int, high: int) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))
