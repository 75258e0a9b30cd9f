"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 60-bit hash. Words are summed by source and the first 12 bits; the bucket
in which a source's budget runs out is found from running sums, and only the documents of that
bucket are split again by the next 12 bits, and so on. The result is one hash threshold per
source, and a document is taken once more if its hash is below it: no sort of the documents.

Defined results: a null text has 0 words; a null source is a source of its own and comes last;
documents with the same id and text share a hash and are taken together; a source without words
has target 0; an empty table gives an empty table; further columns are left out of the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import WORD, stored

BITS, LEVELS = 12, 5


def source_targets(sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], repeat: int) -> DataFrame:
    """(source, source_size) to (source, source_size, target, base, rest).

    ``share`` is the wanted total as a fraction of all words; weights repeat over the sources in
    code point order. A source stops at ``repeat`` times its size, and the excess goes to the
    others by weight: sources are capped in ascending order of limit over weight as long as their
    part of what is left reaches their limit. There is one row per source, so the windows are small.
    """
    up, down = share
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    limits = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeat)
    everything = Window.partitionBy()
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * up - F.coalesce(F.sum("cap").over(before), F.lit(0)) * down
    others = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    capped = limits.withColumn("capped", F.col("weight") * left >= F.col("cap") * down * others)
    spent = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    pool = F.sum("source_size").over(everything) * up - spent * down
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((pool * F.col("weight")).cast("double") / (open_weight * down).cast("double"))
    base = F.when(F.col("capped"), F.lit(repeat).cast("long")).otherwise(F.floor(F.col("target") / F.col("source_size")))
    return (
        capped.withColumn("target", target)
        .withColumn("base", F.when(F.col("source_size") == 0, F.lit(0).cast("long")).otherwise(base))
        .withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
        .select("source", "source_size", "target", "base", "rest")
    )


def hash_thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, base, target, source_size, threshold, edge): a document is taken ``base`` times, and once more if its
    hash is below ``threshold`` or, where ``edge`` is true, equal to it."""

    def refine(counted: DataFrame) -> DataFrame:
        w = Window.partitionBy("source").orderBy("bucket")
        running = counted.withColumn("upto", F.col("below") + F.sum("words").over(w))
        crossing = running.where("upto > rest").withColumn("first", F.row_number().over(w)).where("first = 1")
        return crossing.select(F.col("source").alias("of"), "rest", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("words")).alias("below"), "words")

    def inside(found: DataFrame, shift: int) -> Column:
        return F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("h", shift) == found["prefix"])

    shift = BITS * (LEVELS - 1)
    budgets = targets.where("rest > 0").select(F.col("source").alias("of"), "rest")
    first = rows.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
    counted = first.join(budgets, F.col("source").eqNullSafe(F.col("of"))).withColumn("below", F.lit(0).cast("long"))
    level = stored(refine(counted), "mix-level")
    boundary = stored(rows.join(level, inside(level, shift)).select("source", "size", "h"), "mix-boundary")
    for step in range(1, LEVELS):
        found = level.drop("words")
        met = boundary.join(found, inside(found, shift))
        shift -= BITS
        level = refine(met.groupBy("source", "rest", "below", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words")))
    nearer = (F.col("rest") - F.col("below")) * 2 > F.col("words")
    found = level.select("of", F.col("prefix").alias("threshold"), nearer.alias("edge"))
    return targets.join(found, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "rest")


def _mark(docs: DataFrame, id_col: str, text: str) -> Column:
    """60 bits of a hash of the document's id and text."""
    mark = F.md5(F.concat(F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit("|"), F.coalesce(docs[text], F.lit(""))))
    return F.conv(F.substring(mark, 1, BITS * LEVELS // 4), 16, 10).cast("long")


def _copies() -> Column:
    more = (F.col("h") < F.col("threshold")) | (F.col("edge") & (F.col("h") == F.col("threshold")))
    return F.col("base") + F.coalesce(more.cast("long"), F.lit(0))


def mix_plan(
    docs: DataFrame, weights: Sequence[int], share: tuple[int, int], repeat: int, id_col: str, text: str, source: str
) -> tuple[DataFrame, DataFrame]:
    """The documents' (id, source, size, h) and one row per source (of, source_size, target, base, threshold, edge), both stored."""
    size = F.regexp_count(F.coalesce(docs[text], F.lit("")), F.lit(WORD)).cast("long")
    rows = stored(docs.select(docs[id_col].alias(id_col), docs[source].alias("source"), size.alias("size"), _mark(docs, id_col, text).alias("h")), "mix-rows")
    targets = stored(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeat), "mix-targets")
    return rows, stored(hash_thresholds(rows, targets).withColumnRenamed("source", "of"), "mix-thresholds")


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), repeat: int = 2,
    id_col: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """One row per document: id, ``size`` in words, ``source_size``, ``target`` of its source, ``taken`` words, ``copies``."""
    rows, limits = mix_plan(docs, weights, share, repeat, id_col, text, source)
    return rows.join(limits, F.col("source").eqNullSafe(F.col("of"))).select(
        id_col, "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"), _copies().alias("copies")
    )


def mixed_documents(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), repeat: int = 2,
    id_col: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as it is taken; rows are tested in place, not shuffled."""
    _, limits = mix_plan(docs, weights, share, repeat, id_col, text, source)
    marked = docs.select(F.struct(*docs.columns).alias("doc"), docs[source].alias("source"), _mark(docs, id_col, text).alias("h"))
    met = marked.join(limits, F.col("source").eqNullSafe(F.col("of")))
    return met.select("doc", F.explode(F.array_repeat(F.lit(1), _copies().cast("int")))).select("doc.*")
