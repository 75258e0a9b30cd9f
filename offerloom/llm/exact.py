"""Exact deduplication: a Bloom filter of repeated hashes decides which rows have to meet at all.

The first pass hashes every text and packs the hash bits hit twice into bitmaps; in the second
pass a row whose bits are not all set has a text of its own and goes straight to the output.
Only the rest is shuffled and grouped by SHA-256, so a false alarm costs time, never a row.

Defined results: a null text counts as empty; empty texts are equal texts; of equal texts the
row with the largest id stays (a null id is smaller than any), and of wholly repeated rows
exactly one; an empty table gives an empty table; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.bloom import blocks_for, flagged, repeated_filter
from offerloom.llm.common import attach_groups, stored


def _text(df: DataFrame, text: str) -> Column:
    return F.coalesce(df[text], F.lit(""))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    The texts are read once; what follows works on their digests.
    """
    digests = stored(
        docs.select(
            docs[id_col].alias(id_col), F.sha2(_text(docs, text), 256).alias("text_sha256"),
            F.xxhash64(_text(docs, text)).alias("__h"), F.monotonically_increasing_id().alias("__row"),
        ),
        "exact-digests",
    )
    n = digests.count()
    blocks = blocks_for(n)
    probed = flagged(digests, "__h", repeated_filter(digests, "__h", blocks), blocks)
    alone = probed.where("not __maybe").select(
        id_col, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    maybe = stored(probed.where("__maybe").select(id_col, "text_sha256", "__row"), "exact-maybe")
    groups = stored(
        maybe.groupBy("text_sha256").agg(F.max(F.struct(id_col, "__row")).alias("__keep"), F.count("*").alias("group_size")), "exact-groups"
    )
    met = attach_groups(maybe, groups, "text_sha256", "group_size", n).select(
        id_col, F.col(f"__keep.{id_col}").alias("keep_id"), "group_size", (F.col("__row") == F.col("__keep.__row")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(met)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row per distinct text, all columns kept; only possibly repeated rows are shuffled."""
    order = F.struct(docs[id_col], F.xxhash64(*docs.columns)).alias("order")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), _text(docs, text).alias("text"), F.xxhash64(_text(docs, text)).alias("h"), order)
    blocks = blocks_for(docs.count())
    probed = flagged(rows, "h", repeated_filter(rows.select("h"), "h", blocks), blocks)
    best = probed.where("__maybe").groupBy(F.sha2("text", 256)).agg(F.max_by("doc", "order").alias("doc"))
    return probed.where("not __maybe").select("doc.*").unionByName(best.select("doc.*"))
