"""Subgraph sample (OP17) and its typed node / edge tables (OP18).

Picks a few good movies sharing a genre (fallback: any good movies with a genre and a
tag), then their genre, tag and rating edges. Every cap of the source application is
kept but made deterministic (ordered by keys). Groups are counted, never collected, and
the chosen ids (<= n_movies) and overlapping users (<= n_users) are collected once and
used as literal IN filters, which reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values of the source application ------------------------------------------
N_MOVIES = 4
N_USERS = 10
MAX_GENRE_EDGES = 14
MAX_TAG_EDGES = 16
MIN_QUALITY = 3.5
TITLE_CHARS, NAME_CHARS = 30, 12
# ------------------------------------------------------------------------------------


def sample_ids(nodes: DataFrame, has_genre: DataFrame, has_tag: DataFrame,
               n_movies: int = N_MOVIES, min_quality: float = MIN_QUALITY) -> DataFrame:
    """(movie_id) of the sample: the first ``n_movies`` ids of the first genre (by name)
    that has at least ``n_movies`` good movies with a tag; else the first good movies
    with a genre and a tag. Fewer than 2 ids -> empty."""
    good = (nodes.where(F.col("bayesian_avg") >= min_quality).select("movie_id")
            .join(has_tag.select("movie_id"), "movie_id", "left_semi"))
    gm = has_genre.join(good, "movie_id", "left_semi").select("genre", "movie_id").distinct()
    chosen = (gm.groupBy("genre").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n_movies)
              .agg(F.min("genre")).scalar())
    primary = gm.where(F.col("genre") == chosen).select("movie_id").orderBy("movie_id").limit(n_movies)
    fallback = (gm.select("movie_id").distinct().orderBy("movie_id").limit(n_movies)
                .where(chosen.isNull()))
    ids = primary.unionByName(fallback)
    n_ids = ids.select(F.count(F.lit(1))).scalar()
    return ids.where(n_ids >= 2)


def _id_list(ids, col: str, cap: int) -> list:
    """The (bounded) sampled ids as a Python list, for literal IN filters."""
    if isinstance(ids, (list, tuple)):
        return sorted(ids)
    rows = ids.select(col).limit(cap + 1).collect()
    if len(rows) > cap:
        raise ValueError(f"sample larger than its bound {cap}")
    return sorted(r[0] for r in rows)


def sample_edges(ids, has_genre: DataFrame, has_tag: DataFrame, rated: DataFrame,
                 n_users: int = N_USERS, max_genres: int = MAX_GENRE_EDGES, max_tags: int = MAX_TAG_EDGES):
    """(genre_edges, tag_edges, rated_edges) of the sample.

    ``ids`` (at most N_MOVIES) become a literal ``movie_id IN (...)`` filter that reaches
    the edge scans. Rating edges come from users who rated >= 2 sampled movies (first
    ``n_users`` by id); if there are none, from the first 20 rating rows of any users,
    capped at ``n_users`` users. One edge per (user, movie): the highest rating.
    """
    ids = _id_list(ids, "movie_id", N_MOVIES)
    on = F.col("movie_id").isin(ids)
    genre_e = has_genre.where(on).orderBy("movie_id", "genre").limit(max_genres)
    tag_e = (has_tag.where(on).orderBy("movie_id", "tag", "count").limit(max_tags)
             .select("movie_id", "tag").distinct())
    on_ids = rated.where(on)
    users = _id_list(on_ids.groupBy("user_id").agg(F.countDistinct("movie_id").alias("n"))
                     .where(F.col("n") >= 2).select("user_id").orderBy("user_id").limit(n_users),
                     "user_id", n_users)
    if users:
        rated_e = (on_ids.where(F.col("user_id").isin(users))
                   .groupBy("user_id", "movie_id").agg(F.max("rating").alias("rating")))
    else:
        fb_rows = (on_ids.orderBy("user_id", "movie_id", "rating").limit(n_users * 2)
                   .withColumn("_pos", F.row_number().over(Window.orderBy("user_id", "movie_id", "rating"))))
        fb_users = (fb_rows.groupBy("user_id").agg(F.min("_pos").alias("_first"))
                    .orderBy("_first").limit(n_users).select("user_id"))
        rated_e = (fb_rows.join(fb_users, "user_id", "left_semi")
                   .groupBy("user_id", "movie_id").agg(F.max("rating").alias("rating")))
    return genre_e, tag_e, rated_e


def subgraph_tables(nodes: DataFrame, has_genre: DataFrame, has_tag: DataFrame, rated: DataFrame):
    """Typed (nodes, edges) DataFrames of the sampled subgraph.

    nodes: node_type, node_key, label.   edges: edge_type, src, dst, rating.
    """
    ids = _id_list(sample_ids(nodes, has_genre, has_tag), "movie_id", N_MOVIES)
    genre_e, tag_e, rated_e = sample_edges(ids, has_genre, has_tag, rated)
    title = F.col("title")
    movie_n = nodes.where(F.col("movie_id").isin(ids)).select(
        F.lit("Movie").alias("node_type"), F.col("movie_id").cast("string").alias("node_key"),
        F.substring(F.when(title.isNull() | (title == ""), F.lit("?")).otherwise(title), 1, TITLE_CHARS)
        .alias("label"))
    genre_n = genre_e.select(F.lit("Genre").alias("node_type"), F.col("genre").alias("node_key"),
                             F.substring("genre", 1, NAME_CHARS).alias("label")).distinct()
    tag_n = tag_e.select(F.lit("Tag").alias("node_type"), F.col("tag").alias("node_key"),
                         F.substring("tag", 1, NAME_CHARS).alias("label")).distinct()
    user_n = rated_e.select(F.lit("User").alias("node_type"), F.col("user_id").cast("string").alias("node_key"),
                            F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("label")).distinct()
    node_df = movie_n.unionByName(genre_n).unionByName(tag_n).unionByName(user_n)
    edge_df = (
        genre_e.select(F.lit("HAS_GENRE").alias("edge_type"), F.col("movie_id").cast("string").alias("src"),
                       F.col("genre").alias("dst"), F.lit(None).cast("double").alias("rating"))
        .unionByName(tag_e.select(F.lit("HAS_TAG").alias("edge_type"), F.col("movie_id").cast("string").alias("src"),
                                  F.col("tag").alias("dst"), F.lit(None).cast("double").alias("rating")))
        .unionByName(rated_e.select(F.lit("RATED").alias("edge_type"), F.col("user_id").cast("string").alias("src"),
                                    F.col("movie_id").cast("string").alias("dst"), F.col("rating").cast("double")))
    )
    return node_df, edge_df
