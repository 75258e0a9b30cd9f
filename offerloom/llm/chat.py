"""Chat formatting: the dialogue as each participant's training example.

For every speaker of a conversation the dialogue is rendered with that speaker as assistant and
all others as named users; the mask holds the character spans of the assistant's turns. System
turns stay system turns and are no participants.

The turns of a dialogue are numbered by turn number, speaker and text, and rendered in parts of
``PART`` of them, so that a conversation that holds a third of all rows is never one group,
whatever its turn numbers are. Rows are dealt into slices in that order; a number is what earlier
slices hold of the conversation, and the place in its own slice.

Defined results: a null or blank role speaks as ``unknown``; a null text is an empty turn; a turn
without number comes last; wholly repeated rows are one turn delivered twice and are rendered
once; a conversation of system turns alone gives one row with a null ``perspective`` and no
mask; marker strings inside a text are broken up by a space; texts of any length are rendered
whole; an empty table gives an empty table; further columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import stored

PART = 64
LAST_TURN = 2**62


def _parts(turns: DataFrame, part: int) -> DataFrame:
    """(conv_id, part, turns): distinct turns (conv_id, at, speaker, text) gathered by part, in order."""
    order = ["at", "speaker", "text"]
    sliced = stored(turns.repartitionByRange("conv_id", *order).withColumn("slice", F.spark_partition_id()), "chat-slices")
    counts = sliced.groupBy("conv_id", "slice").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # Only the conversation that a slice begins with can have turns in earlier ones: a row a slice at most.
    before = counts.withColumn("before", F.sum("n").over(earlier)).where("before is not null").select(F.col("conv_id").alias("conv"), F.col("slice").alias("in"), "before")
    same = sliced["conv_id"].eqNullSafe(before["conv"]) & (sliced["slice"] == before["in"])
    place = F.row_number().over(Window.partitionBy("conv_id", "slice").orderBy(*order))
    numbered = sliced.join(F.broadcast(before), same, "left").withColumn("place", F.coalesce("before", F.lit(0)) + place - 1)
    gathered = numbered.groupBy("conv_id", F.floor(F.col("place") / part).alias("part")).agg(F.sort_array(F.collect_list(F.struct("place", "speaker", "text"))).alias("turns"))
    return gathered


def _header(speaker: Column, perspective: Column) -> Column:
    role = (
        F.when(speaker == "system", F.lit("system"))
        .when(speaker == perspective, F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), speaker))
    )
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))


def rotate_perspectives(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part: int = PART
) -> DataFrame:
    """One row per conversation, speaker and part: the rendered ``text``, ``mask`` ("start-end,..." in characters, end
    exclusive), ``n_turns`` and ``n_own``."""
    clean = F.regexp_replace(F.coalesce(turns[text], F.lit("")), r"<\|(im_start|im_end)\|>", "< |$1| >")
    speaker = F.coalesce(F.nullif(F.trim(turns[role]), F.lit("")), F.lit("unknown"))
    at = F.coalesce(turns[turn].cast("long"), F.lit(LAST_TURN))
    rows = turns.select(turns[conv].alias("conv_id"), at.alias("at"), speaker.alias("speaker"), clean.alias("text")).distinct()
    speakers = rows.select(F.col("conv_id").alias("conv"), F.nullif(F.col("speaker"), F.lit("system")).alias("perspective")).distinct()
    parts = _parts(rows, part)
    own = speakers.where("perspective is not null")
    silent = speakers.groupBy("conv").agg(F.max("perspective").alias("perspective")).where("perspective is null")
    views = own.unionByName(silent)
    seen = parts.join(views, parts["conv_id"].eqNullSafe(views["conv"])).drop("conv")

    def piece(x: Column) -> Column:
        head = _header(x["speaker"], F.col("perspective"))
        own = F.coalesce(x["speaker"] == F.col("perspective"), F.lit(False))
        return F.struct(head.alias("head"), F.concat(x["text"], F.lit("<|im_end|>")).alias("body"), own.alias("own"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["end"] + F.length(x["head"])
        stop = start + F.length(x["body"])
        span = F.concat(start.cast("string"), F.lit("-"), stop.cast("string"))
        return F.struct((stop + 1).alias("end"), F.when(x["own"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("spans"))
    rendered = seen.withColumn("pieces", F.transform("turns", piece))
    return rendered.select(
        "conv_id", "perspective", "part",
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("text"),
        F.array_join(F.aggregate("pieces", start, step)["spans"], ",").alias("mask"),
        F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda x: x["own"])).cast("long").alias("n_own"),
    )
