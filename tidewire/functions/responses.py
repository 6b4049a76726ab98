"""Model response expressions: fences, cleaning, parsing, enum values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.params import LAYER_ALIASES, REGION_VALUES, UNKNOWN

ITEM = T.StructType([
    T.StructField("fact", T.StringType()),
    T.StructField("opinion", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("layer", T.StringType()),
    T.StructField("evidence_span", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("finance_relevance", T.DoubleType()),
])
RESPONSE = T.StructType([
    T.StructField("items", T.ArrayType(ITEM)),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("_corrupt_record", T.StringType()),
])

# ---- fixed values -----------------------------------------------------------
CURLY_DOUBLE = "“”"
CURLY_SINGLE = "‘’"
# ---- end of fixed values ----------------------------------------------------


def unfence(content: Column) -> Column:
    """Body of the first json fence, else of the first plain fence, else the text."""
    fence, json_fence = F.lit("```"), F.lit("```json")
    json_part = F.split_part(F.split_part(content, json_fence, F.lit(2)), fence, F.lit(1))
    body = (F.when(content.contains("```json"), json_part)
            .when(content.contains("```"), F.split_part(content, fence, F.lit(2))).otherwise(content))
    return F.trim(body, F.lit(" \n\r\t"))


def clean_json(content: Column) -> Column:
    """Straight quotes and no byte order mark."""
    return F.translate(content, CURLY_DOUBLE + CURLY_SINGLE + "﻿", "\"\"''")


def parse_response(content: Column) -> Column:
    return F.from_json(clean_json(unfence(content)), RESPONSE,
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})


def _mapped(value: Column, mapping: dict[str, str], missing: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), missing)


def stored_region(region: Column) -> Column:
    return F.when(region.isin(*REGION_VALUES), region).otherwise(F.lit(UNKNOWN))


def stored_layer(layer: Column) -> Column:
    return _mapped(layer, LAYER_ALIASES, F.lit(UNKNOWN))


def recode(value: Column, mapping: dict[str, str]) -> Column:
    """Replace old codes, keep every other value."""
    return _mapped(value, mapping, value)
