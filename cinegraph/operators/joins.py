"""Join helpers: broadcast only behind a proven row bound, and per-group top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Largest side (rows) broadcast on a proven bound; beyond it joins shuffle, and AQE's
# skew-join rule splits oversized partitions (hot users, hot tags).
MAX_BROADCAST_ROWS = 2_000_000
# Largest seed / query set whose ids are inlined as a pushed-down IN filter.
MAX_INLINE_IDS = 1024


def bounded_broadcast(df: DataFrame, row_bound: int | None, max_rows: int | None = None) -> DataFrame:
    """``broadcast(df)`` when ``row_bound`` is known and within ``max_rows``, else ``df``."""
    limit = MAX_BROADCAST_ROWS if max_rows is None else max_rows
    if row_bound is not None and row_bound <= limit:
        return F.broadcast(df)
    return df


def count_upto(df: DataFrame, cap: int) -> int | None:
    """Row count of ``df`` if it is at most ``cap`` (reads at most cap+1 rows), else None."""
    n = df.limit(cap + 1).count()
    return n if n <= cap else None


def small_id_list(df: DataFrame, col: str, cap: int = MAX_INLINE_IDS) -> list | None:
    """Distinct ids of a small parameter table (seeds, queries) for a pushed-down filter.

    Returns None when there are more than ``cap`` ids: callers then fall back to a join
    without inlined literals.
    """
    rows = df.select(col).distinct().limit(cap + 1).collect()
    if len(rows) > cap:
        return None
    return sorted(r[0] for r in rows if r[0] is not None)


def top_k(df: DataFrame, group_cols: list[str], order_cols: list[Column], k: int | None,
          rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k inside each group (``row_number``; order must end on a unique key).

    Spark plans a partial ``WindowGroupLimit`` before the shuffle, so even a group holding
    a third of all rows ships at most k rows per input partition.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    ranked = df.withColumn(rank_col, F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col(rank_col) <= k)
