"""Small lookup tables as one literal expression each."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sql(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_sql(v) for v in value) + ")"
    return repr(value)


def literal_map(pairs: Iterable[tuple[object, object]]) -> Column:
    return F.expr("map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in pairs) + ")")


def literal_array(values: Iterable[object]) -> Column:
    return F.expr(_sql(list(values)))


def literal_rows(names: list[str], rows: Iterable[tuple]) -> Column:
    """Array of structs."""
    return F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{n}', {_sql(v)}" for n, v in zip(names, r)) + ")" for r in rows) + ")")
