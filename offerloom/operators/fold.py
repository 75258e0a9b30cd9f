"""Cheapest offer of a group under a comparison that depends on the order of the offers.

Two offers with unit prices in the same unit group compare by unit price, all others by
price. That is not transitive, so the result is defined by passing through the offers in
order and keeping the current best. Groups with one kind of comparison are decided by one
aggregation. Groups mixing both kinds are passed through as a sorted array where they are
small; larger ones are cut into segments whose outcome is summarised for every kind of
incoming best offer, so no large group has to fit into one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom.session import cut_lineage

Row = tuple  # (comparable unit group or None, unit price, price, payload)


def beats(a: Row, b: Row) -> bool:
    if a[0] is not None and a[0] == b[0]:
        return a[1] < b[1]
    return a[2] < b[2]


def run_from(rows: list[Row], start: int) -> int:
    """Index of the best offer after passing through rows[start:]."""
    best = start
    for i in range(start + 1, len(rows)):
        if beats(rows[i], rows[best]):
            best = i
    return best


def summarise(rows: list[Row]) -> dict:
    """Outcome of a segment: for an empty start, and for each kind of offer that may come in.

    For a kind of incoming offer the first row that beats it is the first one below its unit
    price (same group) or below its price (others); only running minima can be that row.
    """
    kinds: dict[str, dict[str, list]] = {}
    outcome: dict[int, int] = {}

    def final(i: int) -> int:
        if i not in outcome:
            outcome[i] = run_from(rows, i)
        return outcome[i]

    for kind in {r[0] for r in rows} | {None}:
        low_unit = low_price = float("inf")
        same, other = [], []
        for i, row in enumerate(rows):
            if kind is not None and row[0] == kind:
                if row[1] < low_unit:
                    low_unit = row[1]
                    same.append([i, row[1], final(i)])
            elif row[2] < low_price:
                low_price = row[2]
                other.append([i, row[2], final(i)])
        kinds[kind or ""] = {"same": same, "other": other}
    used = {final(0)} | {e[2] for k in kinds.values() for es in k.values() for e in es}
    return {"start": final(0), "kinds": kinds, "rows": {str(i): list(rows[i]) for i in used}}


def step(best: Row | None, summary: dict) -> Row:
    """Best offer after a segment, given the best one before it."""
    rows = summary["rows"]
    if best is None:
        return tuple(rows[str(summary["start"])])
    kind = summary["kinds"].get(best[0] or "") or summary["kinds"][""]
    hits = [e for e in kind["same"] if e[1] < best[1]][:1] + [e for e in kind["other"] if e[1] < best[2]][:1]
    return tuple(rows[str(min(hits)[2])]) if hits else best


def cheapest_in_order(offers: DataFrame, keys: list[str], order: list[str], payload: list[str], array_rows: int = 10_000) -> DataFrame:
    """One row per key with the payload of its cheapest offer.

    ``offers`` needs ``price``, ``unit_group`` and ``ppn``; ``order`` is a total order. Unpriced offers count only where a key has no priced one. Mixed groups above
    ``array_rows`` take the segmented pass.
    """
    row = F.struct(*payload)
    comparable = F.when(F.col("price").isNotNull() & F.col("ppn").isNotNull(), F.col("unit_group"))
    rows = offers.withColumn("__cg", comparable)
    decided = rows.groupBy(*keys).agg(
        F.min_by(row, F.when(F.col("price").isNull(), F.struct(*order))).alias("unpriced"),
        F.min_by(row, F.when(F.col("__cg").isNotNull(), F.struct("ppn", *order))).alias("by_unit"),
        F.min_by(row, F.when(F.col("price").isNotNull(), F.struct("price", *order))).alias("by_price"),
        F.count("price").alias("n_priced"),
        F.count("__cg").alias("n_cg"),
        (F.min("__cg") == F.max("__cg")).alias("one_group"),
    )
    simple = (
        F.when(F.col("n_priced") == 0, F.col("unpriced"))
        .when(F.col("n_cg") == 0, F.col("by_price"))
        .when((F.col("n_cg") == F.col("n_priced")) & F.col("one_group"), F.col("by_unit"))
    )
    decided = cut_lineage(decided.select(*keys, "n_priced", simple.alias("row")))
    settled = decided.where(F.col("row").isNotNull()).select(*keys, "row.*")
    open_keys = decided.where(F.col("row").isNull())
    mixed = rows.where(F.col("price").isNotNull())
    small = mixed.join(open_keys.where(F.col("n_priced") <= array_rows).select(*keys), keys, "left_semi")
    result = settled.unionByName(_fold_arrays(small, keys, order, payload))
    large_keys = open_keys.where(F.col("n_priced") > array_rows).select(*keys)
    if large_keys.isEmpty():
        return result
    return result.unionByName(_pass_through(mixed.join(large_keys, keys, "left_semi"), keys, order, payload))


def _fold_arrays(rows: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """Ordered pass over groups of bounded size, inside one aggregation."""
    item = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], "__cg", "ppn", "price", F.struct(*payload).alias("row"))
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))

    def better(best: Column, x: Column) -> Column:
        same = F.coalesce(x["__cg"] == best["__cg"], F.lit(False))
        return F.when(F.when(same, x["ppn"] < best["ppn"]).otherwise(x["price"] < best["price"]), x).otherwise(best)

    best = F.aggregate("items", F.get("items", F.lit(0)), better)
    return lists.select(*keys, best.alias("best")).select(*keys, "best.row.*")


def _pass_through(rows: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """Ordered pass over the groups of a range-partitioned table."""
    schema = rows.schema
    payload_type = T.StructType([schema[c] for c in payload])
    key_fields = [schema[k] for k in keys]
    slim = rows.select(*keys, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], "__cg", "ppn", "price", F.to_json(F.struct(*payload)).alias("__row"))
    sort = [*keys, *[f"__o{i}" for i in range(len(order))]]
    segment_schema = T.StructType(
        [*key_fields, *[T.StructField(f"__o{i}", schema[c].dataType) for i, c in enumerate(order)], T.StructField("__open", T.BooleanType()),
         T.StructField("__seg", T.StringType())]
    )
    n_keys = len(keys)

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            records = list(batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None))
            bounds = [0] + [i for i in range(1, len(records)) if records[i][:n_keys] != records[i - 1][:n_keys]] + [len(records)]
            out = []
            for a, b in zip(bounds, bounds[1:]):
                part = [tuple(r[-4:]) for r in records[a:b]]
                # only a group at the edge of a batch can continue in another one
                opened = a == 0 or b == len(records)
                text = json.dumps(summarise(part)) if opened else part[run_from(part, 0)][3]
                out.append((*records[a][: n_keys + len(order)], opened, text))
            yield pd.DataFrame(out, columns=segment_schema.names)

    @F.pandas_udf(T.StringType())
    def join_segments(groups: pd.Series) -> pd.Series:
        out = []
        for parts in groups:
            best = None
            for part in parts:
                best = step(best, json.loads(part["__seg"])) if part["__open"] else (None, None, None, part["__seg"])
            out.append(best[3])
        return pd.Series(out, dtype=object)

    cut = slim.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInPandas(segments, segment_schema)
    ordered = F.struct(*[f"__o{i}" for i in range(len(order))], "__open", "__seg")
    whole = cut.groupBy(*keys).agg(F.array_sort(F.collect_list(ordered)).alias("__segs"))
    return whole.select(*keys, F.from_json(join_segments("__segs"), payload_type).alias("r")).select(*keys, "r.*")
