"""Rounding that does not depend on the engine, and price arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def round_to_sql(value: str, digits: int) -> str:
    scale = f"{10 ** digits}::DOUBLE"
    return f"(floor(({value}) * {scale} + 0.5::DOUBLE) / {scale})"


def sane_was_price(was: Column, price: Column) -> Column:
    """A former price counts only above the current one."""
    return F.when(was > price, was)


def discount_percent(price: Column, was: Column) -> Column:
    valid = (was > 0) & (price >= 0) & (was > price)
    return F.when(valid, F.bround((F.lit(1.0) - price / was) * 100, 0).cast("bigint"))


def valid_on(valid_from: Column, valid_to: Column, day: Column) -> Column:
    """Validity with open ends."""
    return F.coalesce(valid_from <= day, F.lit(True)) & F.coalesce(day <= valid_to, F.lit(True))
