"""Deduplication, links and counts of the offer catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.units import parse_base_price


def deduplicate_offers(raw: DataFrame, key: list[Column], order: str, keep: list[str] | None = None) -> DataFrame:
    """Keep the first row of each key, nulls being equal, with the columns of ``keep`` (all, if not given).

    The rows of one key are reduced before the shuffle, so a key with very many copies
    never gathers in one task.
    """
    names = [f"__k{i}" for i in range(len(key))]
    rest = [c for c in (keep or raw.columns) if c != order]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("__row")
    return (
        raw.groupBy(*[k.alias(n) for k, n in zip(key, names)])
        .agg(F.min(order).alias(order), first)
        .select(order, *[F.col(f"__row.{c}").alias(c) for c in rest])
    )


def with_base_prices(rows: DataFrame, text: str, name: str, source: DataFrame | None = None) -> DataFrame:
    """``rows`` with the parsed unit price of a price text; every distinct text is parsed once and joined back.

    ``source``, where given, holds all texts of ``rows`` and is cheaper to read twice.
    """
    parsed = (rows if source is None else source).select(F.col(text).alias("__text")).where("__text IS NOT NULL").distinct().withColumn(name, parse_base_price(F.col("__text")))
    return rows.join(parsed, F.col(text) == F.col("__text"), "left").drop("__text")


def first_by(df: DataFrame, keys: list[str], order: list[Column], keep: list[str] | None = None) -> DataFrame:
    """Row with the smallest order value per key, by partial aggregation."""
    rest = [c for c in (keep or df.columns) if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def last_by(df: DataFrame, keys: list[str], order: list[Column], keep: list[str] | None = None) -> DataFrame:
    """Row with the largest order value per key, by partial aggregation."""
    rest = [c for c in (keep or df.columns) if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def offer_brochure_links(occurrences: DataFrame) -> DataFrame:
    """One link per (offer, brochure) with the first page position."""
    return occurrences.groupBy("offer_id", "brochure_id").agg(
        F.min_by("page_number", "raw_id").alias("page_number"), F.count(F.lit(1)).alias("printed")
    )


def occurrence_counts(offers: DataFrame, links: DataFrame) -> DataFrame:
    """Number of brochures per offer, zero where there is none."""
    counts = links.groupBy("offer_id").agg(F.count(F.lit(1)).alias("occurrence_count"))
    return offers.join(counts, "offer_id", "left").withColumn("occurrence_count", F.coalesce("occurrence_count", F.lit(0)))


def ordered_index(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Position and total within the group and over all groups, without a global window.

    Positions are counted inside ordered slices of a group; offsets of slices and groups come
    from a small table of counts.
    """
    from pyspark.sql import Window as W

    cuts = rows.groupBy(group).agg(F.percentile_approx(order, [i / 32 for i in range(1, 32)], 1000).alias("cuts"))
    sliced = rows.join(cuts, group).withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col(order)))).drop("cuts")
    local = sliced.withColumn("pos", F.row_number().over(W.partitionBy(group, "slice").orderBy(order)))
    sizes = sliced.groupBy(group, "slice").agg(F.count(F.lit(1)).alias("n"))
    by_group, everything = W.partitionBy(group), W.partitionBy(F.lit(1))
    running = sizes.select(
        group, "slice",
        (F.sum("n").over(by_group.orderBy("slice")) - F.col("n")).alias("before_slice"),
        F.sum("n").over(by_group).alias("chain_total"),
        (F.sum("n").over(everything.orderBy(group, "slice")) - F.col("n")).alias("before_all"),
        F.sum("n").over(everything).alias("global_total"),
    )
    return local.join(running, [group, "slice"]).select(
        order, group, (F.col("before_all") + F.col("pos")).alias("global_index"), "global_total",
        (F.col("before_slice") + F.col("pos")).alias("chain_index"), "chain_total",
    )


def brochures_of_places(brochures: DataFrame, stores: DataFrame) -> DataFrame:
    """Distinct (brochure_id, store_id): a brochure of a store belongs to all stores of its chain and postcode.

    The many pairs come out of the last join, once each: a brochure and a store that share several
    places meet at the first of them, so that the pairs themselves need no distinct.
    """
    place = F.when(F.col("chain").isNotNull() & F.col("postcode").isNotNull(), F.struct("chain", "postcode"))

    def placed(rows: DataFrame, owner: str, name: str) -> DataFrame:
        sets = rows.where(F.col("place").isNotNull()).groupBy(owner).agg(F.array_sort(F.collect_set("place")).alias(name))
        return sets.select(owner, name, F.explode(name).alias("place"))

    at = stores.select("store_id", place.alias("place"))
    found = placed(brochures.select("brochure_id", "store_id").join(at, "store_id"), "brochure_id", "theirs")
    pairs = found.join(placed(at, "store_id", "own"), "place")
    once = (F.size("own") == 1) | (F.size("theirs") == 1) | (F.array_min(F.array_intersect("own", "theirs")) == F.col("place"))
    return pairs.where(once).select("brochure_id", "store_id")
