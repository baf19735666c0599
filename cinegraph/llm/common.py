"""Helpers shared by the training-data operators: shared-folder tables, Arrow batches, word caches."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegraph.session import ensure_checkpoint_dir

# Rows of one Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it back.

    This cuts the lineage: lost executors cost a re-read of the written table, never a
    recomputation of what came before, and a table used twice is computed once.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cinegraph-llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(col):
    """Lower-case A-Z only (the JVM's ``lower`` also maps letters outside ASCII)."""
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())


def text_key(col):
    """A long that tells rows of one id with different texts apart (null texts are empty)."""
    return F.xxhash64(F.coalesce(col, F.lit("")))


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | list], schema: str) -> DataFrame:
    """``mapInArrow`` that hands ``fn`` at most SLICE_ROWS rows at a time.

    A batch may hold thousands of very long texts; slicing bounds what a worker keeps as
    Python objects. ``fn`` returns one record batch (or a list of them) per slice.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                out = fn(batch.slice(start, SLICE_ROWS))
                if isinstance(out, list):
                    yield from out
                elif out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


_LIVE: weakref.WeakValueDictionary = weakref.WeakValueDictionary()


class BoundedCache(dict):
    """``cache[key]`` computes ``make(key)`` on first use.

    Keeps two generations of at most ``limit`` keys: when the young one is full it becomes
    the old one, and keys still in use are taken over from there.
    """

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self._make, self._limit, self._old = make, limit, {}
        _LIVE[id(self)] = self

    def forget(self) -> None:
        self.clear()
        self._old = {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        if len(self) >= self._limit:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


def keep_only(*tables: BoundedCache) -> None:
    """Empty all word tables of this worker process but these.

    Spark keeps a Python worker between stages: without this, a pipeline's workers would hold
    a full table for each operator they have run.
    """
    kept = set(map(id, tables))
    for at, table in list(_LIVE.items()):
        if at not in kept and table:
            table.forget()


def fixed_bitmap(values: DataFrame, column: str, bits: int) -> bytes:
    """A bit set of ``2**bits`` bits with bit ``value mod 2**bits`` set for each long of a column.

    Its size is fixed by ``bits`` (2**23 bits are 1 MB), not by the data, so it may go to the
    driver and out to the workers: a sieve that never misses a value and lets a few others by.
    """
    at = F.pmod(F.col(column), F.lit(1 << bits))
    words = values.select((F.shiftright(at, 6)).alias("w"), F.call_function(
        "shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (bits - 6), np.int64)
    found = words.toArrow()  # one job; at most 2**(bits - 6) rows of two longs
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out.tobytes()


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the unsigned ``values`` have their bit set (``bitmap`` as unsigned 64-bit words)."""
    at = values & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
