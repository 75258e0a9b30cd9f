"""Equi joins whose heavy keys are spread over several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], spread_by: list[Column], rows_per_task: int = 2_000_000) -> DataFrame:
    """Inner join in which every key of ``big`` above ``rows_per_task`` is cut into parts.

    The heavy keys come from one pre-aggregated count; their rows on the small side are
    repeated once per part. No row is lost and none is met twice. A few small rows can make many pairs,
    so the number of tasks is fixed and not left to the size of the input.
    """
    parts = F.ceil(F.col("count") / F.lit(rows_per_task)).cast("int").alias("__parts")
    heavy = big.groupBy(*keys).count().where(F.col("count") > rows_per_task).select(*keys, parts)
    cut = big.join(heavy, keys, "left").withColumn(
        "__part", F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(*spread_by), F.col("__parts")).cast("int")).otherwise(0)
    )
    repeated = small.join(heavy, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    on, tasks = [*keys, "__part"], int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.drop("__parts").repartition(tasks, *on).join(repeated.drop("__parts").repartition(tasks, *on), on).drop("__part")
