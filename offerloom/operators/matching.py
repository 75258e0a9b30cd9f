"""Predicates shared by text matching and pricing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least scores with and without a known price.
MIN_SCORE_PRICED = 55
MIN_SCORE_UNPRICED = 60


def accepted(score: Column, price: Column) -> Column:
    return score >= F.when(price.isNull(), MIN_SCORE_UNPRICED).otherwise(MIN_SCORE_PRICED)


def brand_matches(wanted: Column, brand: Column) -> Column:
    """The wanted brand occurs in the offer's brand between word boundaries, ignoring case."""
    quoted = F.regexp_replace(wanted, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    pattern = F.concat(F.lit(r"(?iU)\b"), quoted, F.lit(r"\b"))
    return F.coalesce(F.regexp_like(brand, pattern), F.lit(False))
