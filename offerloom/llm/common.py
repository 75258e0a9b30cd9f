"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.session import shared_folder

#: White space of the word rule of the contracts: a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: the cut in the lineage that survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def attach_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int, share: int = 1024) -> DataFrame:
    """Join each row with the one row of its group, also where one group holds most of all rows.

    Groups of more than ``total / share`` rows number less than ``share``, so that they can be
    broadcast; the rest is an ordinary join whose largest key is small. ``groups`` should be stored.
    """
    keys = [key] if isinstance(key, str) else key
    heavy = groups.where(F.col(size) * share > total)
    light = groups.where(F.col(size) * share <= total)
    in_heavy = rows.join(F.broadcast(heavy), keys)
    in_light = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return in_heavy.unionByName(in_light)
