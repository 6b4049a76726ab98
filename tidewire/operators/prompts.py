"""Prompt tables: item lines, fixed blocks, token-packed blocks and section plans."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import WORDS_TO_TOKENS, CJK, cjk_count, mixed_tokens, word_count
from tidewire.operators.numbering import number_rows
from tidewire.params import DEFAULTS, UNKNOWN, Params
from tidewire.runtime import by_key, cut

# ---- fixed values -----------------------------------------------------------
LAYER_INSTRUCTIONS = {
    "金融政策监管": "重点分析政策对金融机构、资本市场的直接影响，以及监管趋势变化",
    "金融经济": "关注市场表现、资金流向、机构动态，分析市场趋势和投资机会",
    "金融大模型技术": "关注技术商业化进展、融资动态、对金融行业的潜在影响",
    "金融科技应用": "分析具体应用场景、市场机会、竞争格局和商业价值",
    "未知": "综合分析该领域情报的金融影响和趋势",
}
ITEM_LINE = "{index}. 【{region}-{layer}】(评分: {score}, 置信度: {confidence})\n   事实: {fact}\n"
OPINION_LINE = "   观点: {opinion}\n"
# ---- end of fixed values ----------------------------------------------------

# Caller may pass another template; the item lines go on lines of their own.
SECTION_TEMPLATE = "【{region}-{layer}】\n{instruction}\n共 {count} 条\n\n{items}\n"


def two_decimals(value: Column) -> Column:
    cents = F.floor(value * 100 + 0.5)
    shown = F.concat(F.floor(F.abs(cents) / 100).cast("string"), F.lit("."), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))
    return F.when(cents < 0, F.concat(F.lit("-"), shown)).otherwise(shown)


def filled(template: str, values: dict[str, Column]) -> Column:
    """The template with its {names} replaced, as one concatenation."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[part] if i % 2 else F.lit(part) for i, part in enumerate(parts) if part])


def item_line(index: Column) -> Column:
    opinion = F.coalesce(F.col("opinion"), F.lit(""))
    line = filled(ITEM_LINE, {
        "index": index.cast("string"), "region": F.coalesce("region", F.lit(UNKNOWN)),
        "layer": F.coalesce("layer", F.lit(UNKNOWN)), "score": two_decimals(F.coalesce("score", F.lit(0.0))),
        "confidence": two_decimals(F.coalesce("confidence", F.lit(0.0))), "fact": F.coalesce("fact", F.lit(""))})
    return F.concat(line, F.when(opinion != "", filled(OPINION_LINE, {"opinion": opinion})).otherwise(""))


def instruction_for(layer: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LAYER_INSTRUCTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, layer), F.lit(LAYER_INSTRUCTIONS["未知"]))


def _template_text(template: str, count: Column) -> Column:
    """The prompt without its item lines."""
    text = F.lit(template.replace("{items}", ""))
    for name, value in (("{region}", F.col("region")), ("{layer}", F.col("layer")),
                        ("{instruction}", instruction_for(F.col("layer"))), ("{count}", count.cast("string"))):
        text = F.replace(text, F.lit(name), value)
    return text


def _sizes() -> list[Column]:
    line = item_line(F.lit(1))           # the number of an item is one word, whatever it is
    return [cjk_count(line).alias("_cjk"), word_count(F.regexp_replace(line, CJK, "")).alias("_words")]


def _totals(sized: DataFrame, by: Sequence[str], template: str) -> DataFrame:
    frame = _template_text(template, F.col("items"))
    return (
        sized.groupBy(*by).agg(F.count("*").alias("items"), F.sum("_cjk").alias("c"), F.sum("_words").alias("w"))
        .withColumn("section_tokens", (F.col("c") + cjk_count(frame) + F.floor(
            (F.col("w") + word_count(F.regexp_replace(frame, CJK, ""))) * F.lit(WORDS_TO_TOKENS))).cast("bigint"))
        .drop("c", "w"))


def section_plan(items: DataFrame, by: Sequence[str], template: str = SECTION_TEMPLATE, params: Params = DEFAULTS) -> DataFrame:
    """Items, tokens and number of prompts of every section; sums alone, nothing is ranked."""
    blocks = F.ceil(F.col("items") / params.prompt_block_items)
    return _totals(items.select(*by, *_sizes()), by, template).withColumn(
        "prompts", F.when(F.col("section_tokens") <= params.token_budget, F.lit(1)).otherwise(blocks).cast("bigint"))


def plan_section_prompts(items: DataFrame, by: Sequence[str], tie: Sequence[str] = ("item_id",),
                         template: str = SECTION_TEMPLATE, params: Params = DEFAULTS,
                         keep: Sequence[str] | None = None) -> DataFrame:
    """Assign every ranked item to a prompt of its section.

    A section whose whole prompt fits the token budget is one prompt, any other
    is cut in blocks of a fixed number of items. The estimate is a sum of
    per-item counts, so no section text is built to measure it. Rows are sorted
    once with the columns to `keep` (all, when not given) and never joined back
    to the items. `tie` is unique in a section.
    """
    first = [*by, *tie, "score"]
    more = [c for c in (items.columns if keep is None else keep) if c not in first]
    sized = number_rows(items.select(*first, *more, *_sizes()), [F.col("score").desc(), *tie], by, "rank")
    fits = F.col("section_tokens") <= params.token_budget
    block = F.floor((F.col("rank") - 1) / params.prompt_block_items)
    return (sized.join(_totals(sized, by, template), list(by))
            .withColumn("block", F.when(fits, F.lit(0)).otherwise(block).cast("bigint"))
            .withColumn("line_no", F.when(fits, F.col("rank"))
                        .otherwise((F.col("rank") - 1) % params.prompt_block_items + 1)).drop("_cjk", "_words"))


def section_prompts(planned: DataFrame, by: Sequence[str], template: str = SECTION_TEMPLATE) -> DataFrame:
    """Prompt text per section block; a block is bounded by the budget or the block size."""
    lines = planned.withColumn("_line", item_line(F.col("line_no")))
    made = (lines.groupBy(*by, "block").agg(
        F.count("*").alias("items"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "_line"))),
                                 lambda x: x["_line"]), "\n").alias("_text")))
    head, tail = template.split("{items}")
    return made.withColumn(
        "prompt", F.concat(_template_text(head, F.col("items")), "_text", _template_text(tail, F.col("items")))
    ).drop("_text")


def _segment_map(target: int):
    """Effect of one segment on the open block, as steps over the tokens carried in."""
    def run(tokens: np.ndarray) -> list[tuple[int, int, int, bool]]:
        n = len(tokens)
        upto = np.concatenate([[0], np.cumsum(tokens)])
        follow = np.searchsorted(upto[1:], upto[:-1] + target, side="right")
        big = tokens > target
        follow = np.where(big, np.arange(n) + 1, follow)
        leave, opens = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for j in range(n - 1, -1, -1):
            k = follow[j]
            if k >= n:
                leave[j], opens[j] = (0 if big[j] else upto[n] - upto[j]), 1
            else:
                leave[j], opens[j] = leave[k], opens[k] + 1
        steps = []
        if upto[n] < target:
            steps.append((1, int(upto[n]), 0, True))
        j = int(np.searchsorted(upto[1:], target - 1, side="right"))
        for at in range(min(j, n - 1), -1, -1):
            low = max(1, int(target - upto[at + 1] + 1))
            step = (low, int(leave[at]), int(opens[at]), False)
            if low > target:
                continue
            if not steps or steps[-1][1:] != step[1:]:
                steps.append(step)
        return [(0, int(leave[0]), int(opens[0]), False)] + steps
    return run


def pack_by_tokens(items: DataFrame, by: Sequence[str], tie: Sequence[str] = ("item_id",),
                   target: int = int(DEFAULTS.model_limit * 0.6), segment_rows: int = 500_000, texts: bool = True) -> DataFrame:
    """Greedy blocks of ranked items under a token target; an oversize item is alone.

    Without `texts` a row has only its keys, rank, tokens and block.

    The pass is sequential, so a section is cut in segments of bounded size.
    Each segment is reduced to how it changes the open block, those few steps
    are chained per section, and every segment is then packed on its own.
    """
    keys = list(by)
    sizes = items.select(*keys, *tie, "score", mixed_tokens(item_line(F.lit(1))).alias("tokens"))
    ranked = cut(number_rows(sizes, [F.col("score").desc(), *tie], by, "rank").drop("score"))
    lean = ranked.select(*keys, "rank", "tokens", F.floor((F.col("rank") - 1) / segment_rows).cast("bigint").alias("segment"))
    key_type = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lean.schema.fields if f.name in keys)
    effect = _segment_map(target)

    def summarise(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        steps = effect(rows.sort_values("rank")["tokens"].to_numpy(dtype=np.int64))
        made = pd.DataFrame(steps, columns=["low", "leave", "opens", "adds"])
        for name, value in zip([*keys, "segment"], key):
            made[name] = value
        return made[[*keys, "segment", "low", "leave", "opens", "adds"]]

    def chain(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        carry, opened, made = 0, 0, []
        for segment, steps in rows.sort_values(["segment", "low"]).groupby("segment", sort=True):
            made.append((segment, carry, opened))
            lows = steps["low"].to_numpy()
            row = steps.iloc[int(np.searchsorted(lows, carry, side="right")) - 1]
            carry = int(carry + row["leave"]) if row["adds"] else int(row["leave"])
            opened += int(row["opens"])
        out = pd.DataFrame(made, columns=["segment", "carry", "opened"])
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, "segment", "carry", "opened"]]

    def assign(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        carry, block = int(rows["carry"].iloc[0]), int(rows["opened"].iloc[0])
        blocks = []
        for tokens in rows["tokens"]:
            if tokens > target:
                block, carry = block + 1, 0
            elif carry == 0 or carry + tokens > target:
                block, carry = block + 1, tokens
            else:
                carry += tokens
            blocks.append(block)
        return rows[keys].assign(rank=rows["rank"], tokens=rows["tokens"], block=blocks)

    if lean.where("segment > 0").isEmpty():
        started = lean.withColumns({"carry": F.lit(0), "opened": F.lit(0)})
    else:
        steps = lean.groupBy(*keys, "segment").applyInPandas(
            summarise, f"{key_type}, segment bigint, low bigint, leave bigint, opens bigint, adds boolean")
        entry = steps.groupBy(*keys).applyInPandas(chain, f"{key_type}, segment bigint, carry bigint, opened bigint")
        started = lean.join(entry, [*keys, "segment"])
    placed = (by_key(started, *keys, "segment").groupBy(*keys, "segment")
              .applyInPandas(assign, f"{key_type}, rank bigint, tokens bigint, block bigint"))
    blocks = ranked.drop("tokens").join(placed, [*keys, "rank"])
    return items.join(blocks, [*keys, *tie]) if texts else blocks
