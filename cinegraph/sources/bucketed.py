"""Tables laid out by the hash of a key: joins and groupings by it need no exchange (SNK3).

A key with very many rows would make one bucket, and so one task, as large as itself. Hence two
parts: the rows of keys up to ``hot_rows`` lie in buckets (``bucketBy``, sorted inside), those of the
other, *hot* keys lie in ordinary files, spread over as many tasks as wrote them. A join puts
bucket beside bucket for the first, and lets Spark shuffle the second, where its skew handling
applies; no key is in both parts, so results of the parts are simply put together.

The layout is known to the session's catalog under a name of its own; files lie under the given
path. Defined cases: null keys are a key like any other when writing and grouping, and match nothing
in a join; an empty table has empty parts; tables of different bucket counts join with an exchange.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.operators.joins import bounded_broadcast, count_upto

# Rows of a key that a bucket may hold: a few MB of edges.
HOT_ROWS = 1_000_000
# Hot keys that may be broadcast.
HOT_KEYS = 100_000
# Hash slots whose rows are counted first: only keys of a slot with more than ``hot_rows`` can be hot.
SLOTS = 4096


@dataclass(frozen=True)
class BucketedTable:
    key: str
    cold: DataFrame
    hot: DataFrame
    hot_keys: DataFrame
    n_hot: int | None
    path: str

    def files(self) -> DataFrame:
        """All rows as one plain scan of the files, sorted by key in each: for readers that need no buckets."""
        return self.hot.sparkSession.read.schema(self.hot.schema).parquet(f"{self.path}/buckets", f"{self.path}/hot")

    def all_rows(self) -> DataFrame:
        return self.cold.unionByName(self.hot)

    def group(self, *aggregates) -> DataFrame:
        """``groupBy(key).agg(...)``: buckets are grouped where they lie, hot keys after partial sums."""
        return self.cold.groupBy(self.key).agg(*aggregates).unionByName(self.hot.groupBy(self.key).agg(*aggregates))

    def _of_hot(self, df: DataFrame) -> DataFrame:
        return df.join(bounded_broadcast(self.hot_keys, self.n_hot, HOT_KEYS), self.key, "left_semi")

    def join(self, other: "BucketedTable", then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """Inner join by the key. ``then`` is applied to each part, and has to work key by key."""
        if self.key != other.key:
            raise ValueError(f"tables laid out by {self.key} and {other.key} have no common key")
        parts = [self.cold.join(other.cold, self.key)]
        if self.n_hot != 0:
            parts.append(self.hot.join(self._of_hot(other.all_rows()), self.key))
        if other.n_hot != 0:
            parts.append(other._of_hot(self.cold).join(other.hot, self.key))
        out = then(parts[0])
        for part in parts[1:]:
            out = out.unionByName(then(part))
        return out


def _hot_keys(df: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """(_k): keys of more than ``hot_rows`` rows. Rows are counted by slot, at most ``SLOTS`` counts a task, and
    those of crowded slots by key."""
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    crowded = df.groupBy(slot.alias("_s")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    slots = [r[0] for r in crowded.select("_s").collect()]  # at most SLOTS numbers
    few = df.where(slot.isin(slots) if slots else F.lit(False))
    return few.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select("_k")


def write_bucketed(df: DataFrame, path: str, key: str, n_buckets: int, sort_cols: list[str] | None = None,
                   hot_rows: int = HOT_ROWS, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> BucketedTable:
    """Write ``df`` under ``path``, laid out by ``key``; one file a bucket. ``then`` is applied to the rows
    of each part once they lie by key, has to work key by key and to keep the key."""
    spark, path = df.sparkSession, path.rstrip("/")
    sizes = _hot_keys(df, key, hot_rows)
    sizes.write.mode("overwrite").parquet(f"{path}/hot_keys")
    hot_keys = spark.read.schema(sizes.select("_k").schema).parquet(f"{path}/hot_keys")
    n_hot = count_upto(hot_keys, HOT_KEYS)
    few = bounded_broadcast(hot_keys, n_hot, HOT_KEYS)
    same = df[key].eqNullSafe(few["_k"])
    hot = then(df.join(few, same, "left_semi") if n_hot != 0 else df.where(F.lit(False)))
    hot.write.mode("overwrite").parquet(f"{path}/hot")
    name = f"cinegraph_{uuid.uuid4().hex}"
    cold = df.join(few, same, "left_anti") if n_hot != 0 else df
    (then(cold.repartition(n_buckets, key)).write.mode("overwrite").bucketBy(n_buckets, key).sortBy(*(sort_cols or [key]))
     .option("path", f"{path}/buckets").format("parquet").saveAsTable(name))
    return BucketedTable(key, spark.table(name), spark.read.schema(hot.schema).parquet(f"{path}/hot"),
                         hot_keys.withColumnRenamed("_k", key), n_hot, path)
