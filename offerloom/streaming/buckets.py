"""A keyed table that a stream of changes rewrites bucket by bucket.

Keys are hashed into a fixed number of buckets. A batch reads and rewrites only the buckets that
its keys fall into; a manifest says which batch wrote the present files of a bucket. Files are
never changed in place: a repeated batch writes its own folders again, from the state before it,
and a reader of an older manifest still finds its files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom.operators.catalog import last_by


@dataclass(frozen=True)
class BucketTable:
    """``folder`` must be shared by all executors; ``version`` orders the rows of a key; a bucket is written by ``writers`` tasks."""

    folder: str
    schema: T.StructType
    key: tuple[str, ...]
    version: str
    buckets: int = 64
    writers: int = 1

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def create(self, spark: SparkSession) -> None:
        """An empty table, unless there is one."""
        spark.createDataFrame([], "bucket int").write.mode("ignore").parquet(f"{self.folder}/manifest/batch=-1")

    def manifest(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """Batch that wrote each bucket last, of all batches or those before one: at most one row a bucket."""
        entries = spark.read.schema("bucket int, batch long").option("basePath", f"{self.folder}/manifest").parquet(f"{self.folder}/manifest")
        if before is not None:
            entries = entries.where(F.col("batch") < before)
        return {r["bucket"]: r["batch"] for r in entries.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}

    def paths(self, spark: SparkSession, before: int | None = None, buckets: set[int] | None = None) -> list[str]:
        """Folders that hold the present rows, of all buckets or some."""
        found = self.manifest(spark, before)
        return [f"{self.folder}/data/batch={n}/bucket={b}" for b, n in sorted(found.items()) if buckets is None or b in buckets]

    def read(self, spark: SparkSession, before: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        paths = self.paths(spark, before, buckets)
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, number: int) -> None:
        """The newest row of every key of the table and the batch; ties go to neither side by rule, so versions should differ."""
        spark = batch.sparkSession
        batch = batch.persist()
        touched = {r["bucket"] for r in batch.select(self._bucket().alias("bucket")).distinct().collect()}
        rows = batch.select(*self.schema.names).unionByName(self.read(spark, number, touched))
        newest = last_by(rows, list(self.key), [F.col(self.version)]).select(*self.schema.names).withColumn("bucket", self._bucket())
        dealt = newest.repartition(F.col("bucket"), F.pmod(F.xxhash64(*self.key, F.lit(1)), F.lit(self.writers)))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/batch={number}")
        spark.createDataFrame([(b,) for b in sorted(touched)], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={number}")
        batch.unpersist()


def upsert_stream(stream: DataFrame, folder: str, key: list[str], version: str, buckets: int = 64) -> DataFrame:
    """Keep the newest row per key over all batches of a stream; a batch rewrites only the buckets of its keys."""
    spark = stream.sparkSession
    table = BucketTable(folder, stream.schema, tuple(key), version, buckets)
    table.create(spark)
    query = stream.writeStream.foreachBatch(table.merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read(spark)
