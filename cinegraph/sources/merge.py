"""Keyed tables that take deltas: MERGE by key, last write wins, touching only what changes.

A table is Parquet laid out in a fixed number of buckets, a hash of its key, one folder each.
A delta is reduced to its last row per key, by an order that the caller must give. Only the
buckets that its keys fall into are read (partition pruning), merged and written back (dynamic
partition overwrite); all other files stay as they are. Table and delta are dealt out once, by
bucket, and written from there: Spark stages the new buckets and moves them into place when all are
written, so a job that is lost before leaves the table whole, and the same merge again gives the
same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegraph.sources.sinks import last_per_key

BUCKET = "_bucket"
_FRESH = "_fresh"


class KeyedTable:
    """A bucketed Parquet table with one row per key. Null keys are a key like any other."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _with_bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, df: DataFrame, path: str) -> None:
        # a bucket's rows have met in one task, so each touched bucket is one file
        (df.sortWithinPartitions(BUCKET, *self.keys).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path))

    def create(self, rows: DataFrame, order: list[str]) -> None:
        """First load: the last row per key by ``order``."""
        self._write(self._with_bucket(last_per_key(rows, self.keys, order)).repartition(BUCKET), self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(BUCKET)

    def merge(self, delta: DataFrame, order: list[str]) -> list[int]:
        """Update or insert the last row per key of ``delta`` by ``order``; returns the buckets written.

        Rows of the delta win over the table's, whatever they hold; an empty delta writes nothing.
        """
        touched = sorted(r[0] for r in self._with_bucket(delta).select(BUCKET).distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return []
        table = self.spark.read.parquet(self.path)
        old = table.where(F.col(BUCKET).isin(touched)).withColumn(_FRESH, F.lit(0))
        fresh = self._with_bucket(last_per_key(delta, self.keys, order)).select(*table.columns).withColumn(_FRESH, F.lit(1))
        # a bucket is a function of the key: rows dealt out by it are grouped by key without another shuffle
        both = old.unionByName(fresh).repartition(BUCKET)
        self._write(last_per_key(both, [BUCKET, *self.keys], [_FRESH]).drop(_FRESH), self.path)
        return touched
