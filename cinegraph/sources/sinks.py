"""Sinks and loads (SNK1-SNK13): overwrite writes, typed loads, keyed upserts.

The source application loads a relational store, a property graph and a vector store.
Here each becomes a Parquet table; keyed semantics (first row per key wins on insert,
last write wins on merge) become explicit window / anti-join steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinegraph.operators.movies import MOVIE_COLUMNS


def write_table(df: DataFrame, path: str, sort_cols: list[str] | None = None,
                partition_by: list[str] | None = None) -> None:
    """SNK1-SNK4: full overwrite as Parquet; optional local sort (row-group skipping) and
    directory partitioning. An empty input writes an empty table with its schema."""
    out = df.sortWithinPartitions(*sort_cols) if sort_cols else df
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV as ``readers.read_csv`` reads it back: blanks kept, quotes doubled, nulls empty."""
    (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first by ``order`` (insert with ON CONFLICT DO NOTHING)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def last_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the last by ``order``, nulls first (MERGE ... SET overwrites)."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() if hasattr(o, "desc") else F.desc(o) for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def load_movies(df: DataFrame, order: list | None = None) -> DataFrame:
    """SNK5: typed 15-column projection (missing columns as nulls), first row per movie_id."""
    first = first_per_key(df, ["movie_id"], order or [F.asc("movie_id")])
    cols = [(F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in MOVIE_COLUMNS]
    return first.select(*cols)


def restrict_to(child: DataFrame, parent: DataFrame, key: str = "movie_id") -> DataFrame:
    """SNK6/SNK7: keep child rows whose key exists in the parent (foreign key)."""
    return child.join(parent.select(key), key, "left_semi")


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str], order: list) -> DataFrame:
    """SNK8: keyed merge where the update wins, and of several updates the last by ``order``.

    existing rows whose key is updated are removed by an anti-join; the updates (one per
    key) are appended. Both sides shuffle on the key only. ``merge.KeyedTable`` keeps such a
    table on disk and rewrites the touched buckets only.
    """
    if not order:
        raise ValueError("upsert needs an order: without one the winner among updates of a key is arbitrary")
    upd = last_per_key(updates, keys, order)
    kept = existing.join(upd.select(*keys), keys, "left_anti")
    return kept.unionByName(upd.select(*existing.columns))


def split_by_dimension(points: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(points with a vector of ``dim`` entries, all others with a ``reason``); no point is in neither."""
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    reason = F.when(size < 0, F.lit("no vector")).when(size != dim, F.concat(
        F.lit("dimension "), size.cast("string"), F.lit(f" instead of {dim}")))
    judged = points.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def upsert_vectors(existing: DataFrame | None, points: DataFrame, dim: int, order: list) -> tuple[DataFrame, DataFrame]:
    """SNK13: (vector points keyed by movie_id, points rejected with their reason). A recreated
    collection is ``existing=None``; of several points of a movie the last by ``order`` stays."""
    good, rejected = split_by_dimension(points, dim)
    if existing is None:
        if not order:
            raise ValueError("upsert_vectors needs an order")
        return last_per_key(good, ["movie_id"], order), rejected
    return upsert(existing, good, ["movie_id"], order), rejected
