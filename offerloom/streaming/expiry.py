"""Streaming deduplication of offers until they expire.

A key is passed on when none of its offers is still valid, and again once that one has expired. The
state of a key is the last day of the offer passed on; an event-time timer drops it when the
watermark is past that day, so that state is bounded by the offers valid now, however long the
stream runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class UntilExpiry(StatefulProcessor):
    """Passes the first of the offers (start and end in seconds) of a key that begins after the one passed before has ended."""

    def __init__(self, key: list[str]) -> None:
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", T.StructType([T.StructField("end_s", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Of a batch's rows only their distinct periods matter.
        periods = sorted({(row["start_s"], row["end_s"]) for row in rows})
        known = self.until.get() if self.until.exists() else None
        held = end = known[0] if known else None
        for start_s, end_s in periods:
            if end is None or start_s > end:
                end = end_s
                yield Row(**dict(zip(self.key, key, strict=True)), start_s=start_s, end_s=end_s)
        if end != held:
            self.until.update((end,))
            self.handle.registerTimer(1000 * (end + 1))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # An older timer of a key whose offer was followed by another one comes too early.
        if self.until.exists() and 1000 * (self.until.get()[0] + 1) <= expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


@contextmanager
def rocks_state(spark: SparkSession):
    """State in RocksDB, which timers need, for the queries started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def valid_offers(offers: DataFrame, key: list[str], start: str, end: str, delay: str = "1 day") -> DataFrame:
    """(key, start_s, end_s) of the offers passed on; ``start`` and ``end`` are timestamps, both inclusive.

    Start a query on it inside ``rocks_state``.
    """
    keys = [offers.schema[k] for k in key]
    out = T.StructType([*keys, T.StructField("start_s", T.LongType()), T.StructField("end_s", T.LongType())])
    seen = offers.withWatermark(start, delay).select(*key, start, F.unix_seconds(start).alias("start_s"), F.unix_seconds(end).alias("end_s"))
    return seen.groupBy(*key).transformWithState(UntilExpiry(key), out, "Append", "EventTime")
