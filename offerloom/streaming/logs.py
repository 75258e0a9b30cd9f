"""Search-log capture and windowed aggregates; every function takes batch or streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Longest texts kept in the log.
QUERY_CHARS, NAME_CHARS = 500, 200


def capture_search(raw: DataFrame) -> DataFrame:
    """Log rows from loosely typed input: texts cut to their column size, numbers read leniently."""
    return raw.withColumns(
        {
            "query": F.substring("query", 1, QUERY_CHARS),
            "category_name": F.substring("category_name", 1, NAME_CHARS),
            "result_count": F.col("result_count").try_cast("bigint"),
            "radius_km": F.col("radius_km").try_cast("double"),
        }
    )


def counted(log: DataFrame) -> DataFrame:
    """(query, selected, n) of a log (query, selected): what both functions below read, far smaller than the log."""
    return log.groupBy("query", "selected").agg(F.count(F.lit(1)).alias("n"))


def frequent_queries(log: DataFrame, least: int, top: int | None = None) -> DataFrame:
    """(query, searches) of queries of two letters on, searched ``least`` times or more; the ``top`` most frequent, or all. ``log`` is counted."""
    found = log.where(F.length("query") >= 2).groupBy("query").agg(F.sum("n").alias("searches")).where(F.col("searches") >= least)
    return found if top is None else found.orderBy(F.desc("searches"), "query").limit(top)


def ranking_examples(ranked: DataFrame, asked: DataFrame, log: DataFrame, limit: int | None = None) -> DataFrame:
    """Training rows of a ranking model: every ranked category of a query with its clicks; ``log`` is counted.

    ``limit`` keeps the first ranks of each query.
    """
    clicks = log.where("selected IS NOT NULL").select("query", F.col("selected").alias("category_id"), F.col("n").alias("clicks"))
    shown = ranked if limit is None else ranked.where(F.col("rank") <= limit)
    joined = shown.withColumnRenamed("q", "query").join(asked, "query").join(clicks, ["query", "category_id"], "left")
    return joined.select(
        "query", "category_id", (F.col("rank") - 1).alias("rank"), F.col("clicks").isNotNull().cast("int").alias("clicked"), F.coalesce("clicks", F.lit(0)).alias("click_count"),
        F.col("n").alias("offer_count"), "searches",
    )


def popular_windows(clicks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Clicks per category over 30-day windows sliding by a day: ``clicks`` is (ts, category_id)."""
    window = F.window("ts", "30 days", "1 day")
    counted = clicks.withWatermark("ts", delay).groupBy(window.alias("w"), "category_id").agg(F.count(F.lit(1)).alias("clicks"))
    return counted.select(F.col("w.start").alias("start"), "category_id", "clicks")


def daily_prices(samples: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily price statistics per category: ``samples`` is (ts, category_id, price)."""
    per_day = samples.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "category_id")
    stats = per_day.agg(F.avg("price").alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.count(F.lit(1)).alias("samples"))
    return stats.select(F.col("w.start").alias("day"), "category_id", "avg_price", "min_price", "max_price", "samples")


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Drain a stream into a Parquet table in append mode and read it back."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")
