"""Request files for an outside classification service, and its answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "struct<i bigint, ok string, uk string, s array<string>, m string, g string, f boolean>"
LIST_KEYS = ["products", "results", "data", "items"]


def request_lines(products: DataFrame, size: int = 50) -> DataFrame:
    """(batch, line): one JSON request per group of products (idx, name, description, brand)."""
    parts = F.concat_ws(
        " | ",
        F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), F.col("name")),
        F.when(F.col("description") != "", F.concat(F.lit("Beschreibung: "), F.col("description"))),
        F.when(F.col("brand") != "", F.concat(F.lit("Marke: "), F.col("brand"))),
    )
    grouped = products.withColumn("batch", F.floor(F.col("idx") / size)).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("idx", parts.alias("t")))).alias("l"))
    content = F.array_join(F.transform("l", lambda x: x["t"]), "\n")
    line = F.to_json(F.struct(F.concat(F.lit("batch_"), F.lpad(F.col("batch").cast("string"), 3, "0")).alias("custom_id"), content.alias("content")))
    return grouped.select("batch", F.size("l").alias("n"), line.alias("line"))


def response_items(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of answers (custom_id, status, content); code fences, lists and the usual wrappers are accepted."""
    text = F.trim(F.regexp_replace("content", r"^\s*```(?:json)?\s*|\s*```\s*$", ""))
    plain = F.from_json(text, f"array<{RESULT}>")
    wrapped = [F.from_json(F.get_json_object(text, f"$.{k}"), f"array<{RESULT}>") for k in LIST_KEYS]
    numbered = F.map_values(F.from_json(text, f"map<string, {RESULT}>"))
    listed = F.when(F.startswith(text, F.lit("[")), plain).otherwise(F.coalesce(*wrapped, numbered))
    usable = F.filter(listed, lambda r: r["i"].isNotNull())
    read = answers.withColumn("found", F.when(F.col("status") == 200, usable))
    ok = F.coalesce(F.size("found") > 0, F.lit(False))
    return read.where(ok).select("custom_id", F.explode("found").alias("r")).select("custom_id", "r.*"), read.where(~ok).select("custom_id", "status")
