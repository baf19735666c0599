"""Load audit and data-quality checks (OP19, DQ1-DQ4, VEC6) as one long report table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.functions.vector import l2_norm


def _rows(table: str, one: DataFrame, checks: list[str]) -> DataFrame:
    """``one``: a single row with a column per check -> (check, tbl, value)."""
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("check"), F.lit(table).alias("tbl"), F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("value"))
        for c in checks])))


def keys_and_rows(df: DataFrame, keys: list[str], **sums) -> DataFrame:
    """One row from one pass: rows, pk_duplicates (key values that occur more than once, DQ1, DQ3)
    and a sum of each further column expression."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), *[F.sum(e).alias(n) for n, e in sums.items()])
    return groups.agg(F.sum("_c").alias("rows"), F.count_if(F.col("_c") > 1).alias("pk_duplicates"),
                      *[F.sum(n).alias(n) for n in sums])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of key values that occur more than once (DQ1, DQ3)."""
    return keys_and_rows(df, keys).select(F.col("pk_duplicates").alias("n"))


def rows_and_orphans(child: DataFrame, parent: DataFrame, key: str = "movie_id") -> DataFrame:
    """One row from one pass: rows, and fk_orphans, child rows whose key has no parent row (DQ2).
    The child's rows are counted by key before they meet the parent's keys."""
    per_key = child.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    known = parent.select(F.col(key).alias("_key")).distinct()
    met = per_key.join(known, F.col(key) == F.col("_key"), "left")
    return met.agg(F.sum("_c").alias("rows"), F.sum(F.when(F.col("_key").isNull(), F.col("_c"))).alias("fk_orphans"))


def orphans(child: DataFrame, parent: DataFrame, key: str = "movie_id") -> DataFrame:
    return rows_and_orphans(child, parent, key).select(F.coalesce("fk_orphans", F.lit(0)).alias("n"))


def distinct_names_duplicated(edges: DataFrame, col: str) -> DataFrame:
    """The duplicate check of a node table that is the distinct names of an edge table."""
    return keys_and_rows(edges.select(col).distinct(), [col])


def dq_report(movies: DataFrame, movie_tags: DataFrame, availability: DataFrame, ratings: DataFrame,
              nodes: DataFrame, has_genre: DataFrame, has_tag: DataFrame, rated: DataFrame,
              vectors: DataFrame, dim: int, tol: float = 1e-5) -> DataFrame:
    """(check, tbl, value): rows, duplicate keys, orphans and the vector contract; the checks of one
    kind on a table are made in one pass."""
    norm = l2_norm("embedding")
    points = keys_and_rows(vectors, ["movie_id"], vector_bad_dim=F.when(F.size("embedding") != dim, 1).otherwise(0),
                           vector_not_unit=F.when(F.abs(norm - 1.0) >= tol, 1).otherwise(0))
    parts = [
        _rows("movies", keys_and_rows(movies, ["movie_id"]), ["rows", "pk_duplicates"]),
        _rows("movie_tags", rows_and_orphans(movie_tags, movies), ["rows", "fk_orphans"]),
        _rows("availability", rows_and_orphans(availability, movies), ["rows", "fk_orphans"]),
        _rows("ratings", ratings.agg(F.count(F.lit(1)).alias("rows")), ["rows"]),
        _rows("movie_vectors", points, ["rows", "pk_duplicates", "vector_bad_dim", "vector_not_unit"]),
        _rows("movie_nodes", keys_and_rows(nodes, ["movie_id"]), ["pk_duplicates"]),
        _rows("genre_nodes", distinct_names_duplicated(has_genre, "genre"), ["pk_duplicates"]),
        _rows("tag_nodes", distinct_names_duplicated(has_tag, "tag"), ["pk_duplicates"]),
        _rows("has_genre", rows_and_orphans(has_genre, nodes), ["fk_orphans"]),
        _rows("has_tag", rows_and_orphans(has_tag, nodes), ["fk_orphans"]),
        _rows("rated", rows_and_orphans(rated, nodes), ["fk_orphans"]),
    ]
    return reduce(DataFrame.unionByName, parts)
